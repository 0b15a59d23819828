"""Applying rules: coverage of examples by a clause or by a theory, and its metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.functions.scores import f1_column
from cinnabar.operators import bindings as b
from cinnabar.operators.staging import stage
from cinnabar.plans.model import Clause


def uncovered(theory: Sequence[Clause], rows: DataFrame, relations: b.Relations) -> DataFrame:
    """The examples (v0, ..., with or without label) that no clause covers, staged after each clause."""
    left = rows
    for clause in theory:
        left = stage(b.without_heads(left, b.heads(clause, left, relations), clause.head.predicate.arity), "uncovered")
    return left


def coverage(theory: Sequence[Clause], rows: DataFrame, relations: b.Relations) -> DataFrame:
    """rows with `covered`: whether any clause covers them."""
    key = [c for c in rows.columns if c != b.LABEL]
    found = None
    for clause in theory:
        one = b.heads(clause, rows.select(*key), relations)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.withColumn("covered", F.lit(False))
    marks = found.distinct().withColumn("_hit", F.lit(True))
    return rows.join(marks, key, "left").withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_hit").select(*rows.columns, "covered")


def metrics(theory: Sequence[Clause], rows: DataFrame, relations: b.Relations) -> DataFrame:
    """positives, negatives, covered_positives, covered_negatives, precision (0 if nothing is covered), recall, f1."""
    c = coverage(theory, rows, relations).agg(
        F.count_if(F.col(b.LABEL)).alias("positives"),
        F.count_if(~F.col(b.LABEL)).alias("negatives"),
        F.count_if(F.col(b.LABEL) & F.col("covered")).alias("covered_positives"),
        F.count_if(~F.col(b.LABEL) & F.col("covered")).alias("covered_negatives"),
    )
    precision = F.coalesce(F.try_divide(F.col("covered_positives"), F.col("covered_positives") + F.col("covered_negatives")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("covered_positives"), F.col("positives")), F.lit(0.0))
    return c.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1_column(F.col("precision"), F.col("recall")))
