"""Scores of a candidate from its counts: P, N bindings before it, p, n covered by it, bp, bn bindings after it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcc(p: int, n: int, P: int, N: int) -> float:
    """Matthews correlation of covering with being positive; -1 if no positive is covered, 0 if all bindings are."""
    if p == 0:
        return -1.0
    if p == P and n == N:
        return 0.0
    root = math.sqrt(float(p + n) * (P + N - p - n) * N * P)
    return (p * (N - n) - n * (P - p)) / root if root else math.nan


def area(x: int, y: int) -> float:
    """Area under the entropy curve up to precision x / (x + y)."""
    if x == 0:
        return 0.0
    if y == 0:
        return 1.0
    r = x / (x + y)
    return ((1 - r) ** 2 * math.log2(1 - r) - r * r * math.log2(r)) * math.log(2) + r


def combine(m: float, a: float) -> float:
    """F2 of the two parts."""
    return 5 * a * m / (m + 4 * a)


def score(bp: int, bn: int, p: int, n: int, P: int, N: int) -> float | None:
    """None for a candidate that is never considered."""
    m, a = 1 + mcc(p, n, P, N), 1 + area(bp, bn) - area(P, N)
    if m == 0 or a == 0 or math.isnan(m) or math.isnan(a):
        return None
    return combine(m, a)


def f1(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def mcc_column(p: Column, n: Column, P: Column, N: Column) -> Column:
    p, n, P, N = (x.cast("double") for x in (p, n, P, N))
    root = F.sqrt((p + n) * (P + N - p - n) * N * P)
    return F.when(p == 0, -1.0).when((p == P) & (n == N), 0.0).when(root != 0, F.try_divide(p * (N - n) - n * (P - p), root))


def area_column(x: Column, y: Column) -> Column:
    r = F.try_divide(x.cast("double"), (x + y).cast("double"))
    inner = (F.pow(1 - r, F.lit(2)) * F.log2(1 - r) - r * r * F.log2(r)) * F.log(F.lit(2.0)) + r
    return F.when(x == 0, 0.0).when(y == 0, 1.0).otherwise(inner)


def score_column(bp: Column, bn: Column, p: Column, n: Column, P: Column, N: Column) -> Column:
    """Null for a candidate that is never considered."""
    m, a = 1 + mcc_column(p, n, P, N), 1 + area_column(bp, bn) - area_column(P, N)
    return F.when((m != 0) & (a != 0), F.try_divide(5 * a * m, m + 4 * a))


def f1_column(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
