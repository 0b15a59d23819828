"""Plumbing shared by the training-data operators: staging, skew-safe joins, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.operators.staging import drop, shared_dir, stage

__all__ = ["columns", "connected_components", "drop", "forest", "salted_join", "shared_dir", "slices", "stage", "table", "unused", "whole"]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows.  Spark bounds a batch's bytes, this the Python objects made of it."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def columns(df: DataFrame) -> list:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def whole(df: DataFrame, name: str = "doc"):
    """A row as one value, so that no column of the caller's can clash with the operator's."""
    return F.struct(*columns(df)).alias(name)


def unused(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _hashable(df: DataFrame) -> list:
    return [c for c, f in zip(columns(df), df.schema, strict=True) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 32, most: int = 20_000, staged: bool = False) -> DataFrame:
    """Equi-join where a key may hold a large share of left's rows, and few of right's.

    Up to `most` rows, right is broadcast, after a count.  Beyond, left's rows are dealt over salts and right's
    repeated for each, so that no task gets all of a hot key.  `staged` says that right is a table already; else it
    is made one, as it is read twice.  ``how`` may be inner, left, left_semi or left_anti; nulls match nothing.
    """
    right = right if staged else stage(right, "side")
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    salt = unused("_salt", left, right)
    spread = left.withColumn(salt, F.pmod(F.xxhash64(*_hashable(left)), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a side that looks small before it is repeated must not be broadcast for it
    return spread.join(copies.hint("merge"), [*on, salt], how).drop(salt)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges a-b, without the roots."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:  # minimum labels with pointer jumping; a few rounds for any shape
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def _contract(batches):
    """One partition's edges as the star forest that connects the same nodes; folds as it reads, so memory is
    bounded by the partition's nodes."""
    a = b = np.empty(0, np.int64)
    for pdf in batches:
        a, b = np.concatenate([a, pdf["a"].to_numpy()]), np.concatenate([b, pdf["b"].to_numpy()])
        if len(a) > 500_000:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
    yield pd.DataFrame({"a": a, "b": b})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b: bigint); component is the smallest node reachable.

    Each partition's edges shrink to a star forest first.  Then rounds of: take the least label among the
    neighbours, jump to the label's label.  Rounds are staged, joins are salted, and the driver sees only a
    count of the changes.  Ends after a number of rounds logarithmic in practice.
    """
    star = edges.where("a <> b").select("a", "b").mapInPandas(_contract, "a bigint, b bigint")
    links = stage(star.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "label")
    while True:
        near = salted_join(both, label.select(F.col("node").alias("v"), "component"), ["v"], staged=True).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        jump = salted_join(low, label.select(F.col("node").alias("at"), F.col("component").alias("far")), ["at"], staged=True)
        new = stage(jump.select("node", "was", F.least("at", "far").alias("component")), "label")
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
