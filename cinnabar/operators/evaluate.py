"""Counts of many candidate literals in one job.

All four counts of a candidate depend on its bound variables alone.  Bindings are counted by those variables, facts
by the columns they stand in, and the two small tables joined: with `pos` and `neg` bindings and `m` facts a key,
bp = sum(pos * m), bn = sum(neg * m), p = sum(pos), n = sum(neg).  The exploded join never exists, a hot key is one
row on either side, and candidates that share variables or columns share the counting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.operators.bindings import LABEL, Relations, condition, keys, matching, variables
from cinnabar.operators.staging import stage
from cinnabar.plans.model import Literal


@dataclass(frozen=True)
class Counts:
    literal: Literal
    bp: int
    bn: int
    p: int
    n: int

    @property
    def precision(self) -> float:
        """Of the bindings after the literal."""
        return self.bp / (self.bp + self.bn) if self.bp + self.bn else 0.0


def by_variables(bindings: DataFrame, names: Sequence[int]) -> DataFrame:
    return bindings.groupBy(*(f"v{v}" for v in names)).agg(F.count_if(F.col(LABEL)).alias("pos"), F.count_if(~F.col(LABEL)).alias("neg"))


def by_columns(literal: Literal, relations: Relations) -> DataFrame:
    facts = matching(literal, relations[literal.predicate].df)
    return facts.groupBy(*(f"c{i}" for i in keys(literal).values())).agg(F.count("*").alias("m"))


class FactCounts:
    """Facts counted by the columns that literals bind.  They do not change while rules are learned, so each count
    is made once, as a table, however many searches use it."""

    def __init__(self, relations: Relations):
        self.relations = relations
        self.made: dict[tuple, DataFrame] = {}

    def __call__(self, literal: Literal) -> DataFrame:
        first = keys(literal)
        shape = (literal.predicate, tuple(first.get(v, -1) for v in literal.terms))  # which positions are equal
        if shape not in self.made:
            self.made[shape] = stage(by_columns(literal, self.relations), "facts")
        return self.made[shape]


def counts_of(at: int, literal: Literal, counted: DataFrame, facts: DataFrame) -> DataFrame:
    both = counted.join(facts, condition(counted, facts, literal))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(
        F.lit(at).alias("literal_id"),
        zero(F.col("pos") * F.col("m")).alias("bp"),
        zero(F.col("neg") * F.col("m")).alias("bn"),
        zero("pos").alias("p"),
        zero("neg").alias("n"),
    )


def evaluate(bindings: DataFrame, literals: Sequence[Literal], relations: Relations, facts: FactCounts | None = None) -> DataFrame:
    """literal_id (index in literals), bp, bn, p, n: one row a literal.  `facts` keeps counts between calls."""
    shared: dict[tuple[int, ...], DataFrame] = {}
    out = None
    for at, literal in enumerate(literals):
        names = tuple(sorted(keys(literal)))
        if names not in shared:
            shared[names] = by_variables(bindings, names)
        one = counts_of(at, literal, shared[names], facts(literal) if facts else by_columns(literal, relations))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no literals")
    return out


def evaluate_by_rows(bindings: DataFrame, literal: Literal, relations: Relations) -> DataFrame:
    """The same counts from the exploded join, for comparison: bp, bn, p, n."""
    rows = bindings.withColumn("_row", F.monotonically_increasing_id())
    facts = matching(literal, relations[literal.predicate].df)
    hits = rows.join(facts, condition(rows, facts, literal)).groupBy("_row", LABEL).agg(F.count("*").alias("m"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    pos = F.col(LABEL).cast("bigint")
    return hits.agg(zero(F.col("m") * pos).alias("bp"), zero(F.col("m") * (1 - pos)).alias("bn"), zero(pos).alias("p"), zero(1 - pos).alias("n"))


def collect_counts(bindings: DataFrame, literals: Sequence[Literal], relations: Relations, facts: FactCounts | None = None, at_once: int = 50, timed=lambda what, f, *args: f(*args)) -> list[Counts]:
    """Counts in the literals' order; a job for each `at_once` of them bounds the plan.  timed(stage, f, ...) calls f."""
    out: list[Counts] = []
    for start in range(0, len(literals), at_once):
        part = literals[start : start + at_once]
        if facts:
            timed("facts", lambda part=part: [facts(x) for x in part])
        counted = timed("plan", evaluate, bindings, part, relations, facts)
        rows = {r["literal_id"]: r for r in timed("evaluate", counted.collect)}  # a row a literal
        out += [Counts(x, rows[i]["bp"], rows[i]["bn"], rows[i]["p"], rows[i]["n"]) for i, x in enumerate(part)]
    return out


def label_counts(bindings: DataFrame) -> tuple[int, int]:
    r = bindings.agg(F.count_if(F.col(LABEL)).alias("p"), F.count_if(~F.col(LABEL)).alias("n")).first()
    return r["p"], r["n"]


__all__ = ["Counts", "FactCounts", "by_columns", "by_variables", "collect_counts", "evaluate", "evaluate_by_rows", "label_counts", "variables"]
