"""Radix buckets of integers, and row numbers without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinnabar.operators.staging import stage


def bucket(value: Column, bits: int = 5) -> Column:
    """The low bits of an integer: value mod 2^bits, which lies in 0 .. 2^bits - 1 for negative values too."""
    return F.pmod(value, F.lit(1 << bits))


def histogram(df: DataFrame, column: str, bits: int = 5) -> DataFrame:
    """bucket, n."""
    return df.groupBy(bucket(F.col(column), bits).alias("bucket")).agg(F.count("*").alias("n"))


def radix_partition(df: DataFrame, column: str, bits: int = 5) -> DataFrame:
    """df with its bucket, dealt so that a bucket lies in one partition."""
    return df.withColumn("bucket", bucket(F.col(column), bits)).repartition(1 << bits, "bucket")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `row`, 0, 1, ... by the order.  Ranges are sorted in parallel and only their sizes are summed."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    fixed = stage(sorted_.select("*", at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), F.shiftright(at, 33).alias("_part")), "numbered")
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return fixed.join(F.broadcast(starts), "_part").withColumn("row", F.col("_start") + F.col("_at")).drop("_part", "_at", "_n", "_start")
