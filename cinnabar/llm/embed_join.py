"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at a cosine of at least c lie within a squared distance of 2 - 2c.  After a random rotation the
dimensions are split into blocks; each block's budget is the part of that distance which its number of dimensions
bears to all.  A pair within the whole distance is within budget in at least one block, so a range join in each
block finds every pair.  The range join is a grid over a block's first coordinates with cells four radii wide: a
vector is at home in one cell and a probe only in those that its radius reaches, later cells in order, so that a pair
of cells meets once.  Within a cell vectors are sorted by the first coordinate, and only stretches within the radius
are compared, as matrix products over the whole block.  Candidates are verified where they meet, with the full
vectors, and counted in the first block in which they are within budget, so no pair is written out: a unit of work
returns each vector's number of links and a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import connected_components, forest, salted_join, slices, stage


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    blocks: int = 3
    #: Coordinates of a block that the grid has.
    axes: int = 3
    #: Vectors of a cell that one unit of work holds half of.
    chunk: int = 65536
    tile: int = 512
    seed: int = 5
    #: Room for rounding in the block distances, which only makes more candidates.
    slack: float = 1e-9


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def cuts(d: int, blocks: int) -> list[slice]:
    edge = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ rotation(x.shape[1], seed)


def width(table: DataFrame, embedding: str) -> str:
    """What holds the components exactly: 4 bytes for floats, 8 otherwise."""
    return "<f4" if table.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, key (digest of the components), vector (as bytes), null where it can't link; staged."""
    kind = width(table, embedding)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys, raws = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], np.float64)
                fine = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                if fine and not 1e-200 < (most := np.abs(x).max()) ** 2 < 1e200:
                    x = np.ldexp(x, -int(np.frexp(most)[1]))  # a power of two changes no cosine
                raws.append(x.astype(kind).tobytes() if fine else None)
                keys.append(hashlib.blake2b(raws[-1], digest_size=16).digest() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "vector"])

    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return stage(rows.mapInArrow(run, "vec_id bigint, key binary, vector binary"), "vectors")


def reached(y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their cells) for the home cells first, then for the later cells, axis by axis, that the radius reaches."""
    wide = 4 * radius
    home = np.floor(y / wide + 0.5).astype(np.int32)  # a cell is centred at the origin, where most vectors are
    low, high = y - radius < (home - 0.5) * wide, y + radius > (home + 0.5) * wide
    yield np.arange(len(y)), home
    for step in product((-1, 0, 1), repeat=y.shape[1]):
        if step <= (0,) * y.shape[1]:
            continue  # the pair meets in the later cell
        fits = np.ones(len(y), bool)
        for k, x in enumerate(step):
            fits &= low[:, k] if x < 0 else high[:, k] if x else True
        at = np.flatnonzero(fits)
        if len(at):
            yield at, home[at] + np.array(step, np.int32)


def deal(nodes: DataFrame, s: Settings, kind: str) -> DataFrame:
    """d, block, x, y, z, probe, node, n, vector: each node at home, and as a probe in the cells around that it reaches."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) // int(kind[2]) for r in raw])
            for d in np.unique(sizes):
                here = np.flatnonzero(sizes == d)
                y = rotated(np.frombuffer(b"".join(raw[i] for i in here), kind).astype(np.float64).reshape(len(here), d), s.seed)
                for b, cut in enumerate(cuts(d, s.blocks)):
                    radius = np.sqrt((2 - 2 * s.cosine) * (cut.stop - cut.start) / d + s.slack) + s.slack
                    for k, (rows, cell) in enumerate(reached(y[:, cut][:, : s.axes], radius)):
                        axes = [cell[:, i] if i < cell.shape[1] else np.zeros(len(rows), np.int32) for i in range(3)]
                        many, at = len(rows), pa.array(here[rows])
                        cols = [pa.array(np.full(many, d, np.int32)), pa.array(np.full(many, b, np.int32)), *map(pa.array, axes), pa.array(np.full(many, k > 0))]
                        yield pa.RecordBatch.from_arrays([*cols, batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)], ["d", "block", "x", "y", "z", "probe", "node", "n", "vector"])

    return nodes.select("node", "n", "vector").mapInArrow(run, "d int, block int, x int, y int, z int, probe boolean, node bigint, n bigint, vector binary")


def meet(left: tuple, right: tuple, block: int, s: Settings, square: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in left, j in right) at the cosine or above, first within budget in this block.

    Both sides are sorted by the block's first coordinate.
    """
    (x, y), (u, v) = left, right
    d = x.shape[1]
    parts = cuts(d, s.blocks)
    budget = [(2 - 2 * s.cosine) * (p.stop - p.start) / d + s.slack for p in parts]
    nx, nu = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", u, u))
    q = parts[block]
    a, b = y[:, q].astype(np.float32), v[:, q].astype(np.float32)
    first, other_first, radius = y[:, q.start], v[:, q.start], np.sqrt(budget[block]) + s.slack
    one, other = np.ones((len(a), 1), np.float32), np.ones((len(b), 1), np.float32)
    a = np.concatenate([-2 * a, np.square(a).sum(1, keepdims=True), one], 1)  # a . b is the squared block distance
    b = np.concatenate([b, other, np.square(b).sum(1, keepdims=True)], 1)
    for i0 in range(0, len(x), s.tile):
        lo = np.searchsorted(other_first, first[i0] - radius)
        hi = np.searchsorted(other_first, first[min(i0 + s.tile, len(x)) - 1] + radius, "right")
        for j0 in range(i0 if square else lo // s.tile * s.tile, hi, s.tile):
            near = a[i0 : i0 + s.tile] @ b[j0 : j0 + s.tile].T <= np.float32(budget[block] + 1e-5)
            if not near.any():
                continue
            if square and i0 == j0:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = i + i0, j + j0
            for k in range(0, len(i), 1 << 15):
                e, f = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                cos = np.einsum("ij,ij->i", x[e], u[f]) / (nx[e] * nu[f])
                e, f = e[cos >= s.cosine], f[cos >= s.cosine]
                gap = np.square(y[e] - v[f])
                mine = gap[:, q].sum(1) <= budget[block]
                for earlier in range(block):
                    mine &= gap[:, parts[earlier]].sum(1) > budget[earlier]
                if mine.any():
                    yield e[mine], f[mine]


def join(dealt: DataFrame, s: Settings, kind: str) -> DataFrame:
    """Rows of two sorts: (node, links) and (node, other) edges of spanning forests."""
    key = ["d", "block", "x", "y", "z"]
    sizes = stage(dealt.groupBy(*key).agg(F.sum((~F.col("probe")).cast("bigint")).alias("homes"), F.count("*").alias("all")).where("homes > 0 and `all` > 1"), "cells")
    chunks = F.ceil(F.col("all") / s.chunk).cast("int")
    at = salted_join(dealt, sizes, key, staged=True).withColumn("_n", chunks).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    units = at.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    units = units.select(*key, F.least("_i", "_j").alias("lo"), F.greatest("_i", "_j").alias("hi"), "probe", "node", "n", "vector", F.col("_i").alias("own"))

    def work(rows: list[tuple], block: int, lo: int, hi: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(r[10] for r in rows), kind).astype(np.float64).reshape(len(rows), -1)
        y = rotated(x, s.seed)
        order = np.argsort(y[:, cuts(x.shape[1], s.blocks)[block].start], kind="stable")
        x, y = x[order], y[order]
        node, n, probe, own = (np.array([r[k] for r in rows])[order] for k in (8, 9, 7, 11))
        links, ends = {}, [(np.empty(0, np.int64), np.empty(0, np.int64))]
        count = np.zeros(len(rows), np.int64)

        def against(p: np.ndarray, r: np.ndarray, square: bool) -> None:
            for i, j in meet((x[p], y[p]), (x[r], y[r]), block, s, square):
                i, j = p[i], r[j]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                ends.append(forest(node[i], node[j]))

        home_lo, home_hi = np.flatnonzero(~probe & (own == lo)), np.flatnonzero(~probe & (own == hi))
        probe_lo, probe_hi = np.flatnonzero(probe & (own == lo)), np.flatnonzero(probe & (own == hi))
        if lo == hi:
            against(home_lo, home_lo, True)
            against(home_lo, probe_lo, False)
        else:
            against(home_lo, home_hi, False)
            against(home_lo, probe_hi, False)
            against(home_hi, probe_lo, False)
        hit = np.flatnonzero(count)
        for k in hit:
            links[int(node[k])] = links.get(int(node[k]), 0) + int(count[k])
        a, b = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
        return (links, *forest(a, b)) if len(a) else (links, a, b)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, unit = [], None

        def done():
            links, a, b = work(held, unit[1], unit[5], unit[6])
            node = pa.array([*links, *a.tolist()], pa.int64())
            count = pa.array([*links.values(), *[None] * len(a)], pa.int64())
            return pa.RecordBatch.from_arrays([node, count, pa.array([*[None] * len(links), *b.tolist()], pa.int64())], ["node", "links", "other"])

        for batch in slices(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:7] != unit:
                    if len(held) > 1:
                        yield done()
                    held, unit = [], row[:7]
                held.append(row)
        if len(held) > 1:
            yield done()

    order = [*key, "lo", "hi"]
    return stage(units.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(run, "node bigint, links bigint, other bigint"), "met")


def near_duplicates(table: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:  # noqa: B008
    """vec_id, n_links, component_id, kept for every row.

    Vectors of one length link at a cosine of settings.cosine or more, in double precision, whatever their scale.  A vector that is null,
    empty, zero, or holds a null or a value that is not finite links with nothing and is its own component.  Equal
    vectors are one node that counts for all its rows, so repeated rows link with each other; a null vec_id takes
    part like any other but names no component and is kept.  An empty table gives no rows; other columns are ignored.
    """
    s = settings
    rows = vectors(table, vec_id, embedding)
    classes = stage(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()), "classes")
    kind = width(table, embedding)
    met = join(deal(classes, s, kind), s, kind)
    names = classes.select("node", F.coalesce("least", F.lit((1 << 63) - 1)).alias("least"))
    comps = connected_components(met.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = names.join(comps, "node", "left").withColumn("root", F.coalesce("component", "node"))
    root = grouped.groupBy("root").agg(F.min("least").alias("component"))
    counted = met.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    verdict = grouped.select("node", "root").join(root, "root").join(counted, "node", "left").select("node", "component", F.coalesce("links", F.lit(0)).alias("links"))
    final = classes.select("node", "key", "n").join(verdict, "node").select("key", "component", (F.col("links") + F.col("n") - 1).alias("n_links")).where("n_links > 0")
    out = salted_join(rows.select("vec_id", "key"), final, ["key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
