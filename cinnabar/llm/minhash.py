"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of Z mod 2^32 make the whole signature: shingles pass through the first once; coordinate k is the
minimum of the second over the first's values shifted circularly by k.  Equal word sequences are one node from the
start.  A node is compared first with the smallest node it shares a bucket with, which joins most of a group at one
comparison a member.  Then, in buckets that still hold several components, every pair across components whose sizes
and sketches allow a link is compared where it meets, once, and only the edges that connect components are written;
pairs within a component need no comparison.  There a bucket's largest component is dealt in chunks that meet only
chunks of the rest, so a group of any size is copied as often as the few strangers in its bucket need it.  Every link
is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import connected_components, drop, salted_join, slices, stage, whole


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85  # least Jaccard similarity
    #: A pair at the threshold misses all bands with probability (1 - 0.85^rows)^bands = 7e-7.
    bands: int = 30
    rows: int = 6
    #: A pair goes to verification if so many coordinates agree: 5.6 standard deviations below the threshold's mean.
    least_equal: float = 0.70
    chunk: int = 1024  # members of a bucket that one unit of work holds half of, by their sketches (in large ones up to eight times)
    set_chunk: int = 256  # and with their shingle sets, or up to eight times as many while no set of the bucket makes it more than
    set_codes: int = 1 << 18  # shingles
    hot: int = 1000  # a bucket with more nodes meets its facts in a salted join
    broadcast_ids: int = 1_000_000  # more ids than this meet the texts in a shuffle

    @property
    def size(self) -> int:
        return self.bands * self.rows


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


_hashes = _Hashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit codes of the word shingles; with fewer words, one code of the whole sequence; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    n = len(words) - w + 1
    code = np.full(n, w, np.uint64)
    for k in range(w):
        code = (code ^ word[k : k + n]) * _ODD
        code ^= code >> np.uint64(29)
    return np.unique(code)


def _second(x: np.ndarray, t: np.ndarray) -> None:
    """A permutation of Z mod 2^32, in place; t is scratch of the same shape."""
    for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(odd), out=x)
    np.right_shift(x, np.uint32(16), out=t)
    np.bitwise_xor(x, t, out=x)


def signature(codes: np.ndarray, size: int) -> np.ndarray:
    """min over shingles of second(first(shingle) + k) for k below size."""
    first = (((codes ^ (codes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)
    for k in range(0, len(first), 1024):
        x = shift[:, None] + first[None, k : k + 1024]
        _second(x, np.empty_like(x))
        np.minimum(out, x.min(1), out=out)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, key (of the word sequence), bands (8 bytes each), sketch (a byte a coordinate)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                key = xxhash.xxh3_128_digest(b" ".join(words))
                got = known.get(key)
                if got is None:
                    codes = shingles(words, s.words)
                    sig = signature(codes, s.size)
                    band = np.arange(s.bands, dtype=np.uint64)
                    for k in range(s.rows):
                        band = (band ^ sig[k :: s.rows].astype(np.uint64)) * _ODD
                        band ^= band >> np.uint64(31)
                    got = (len(codes), key, band.tobytes() if words else b"", sig.astype(np.uint8).tobytes() if words else b"")
                    if len(known) > 4096:
                        known.clear()
                    known[key] = got
                out.append(got)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["doc_id", "n_shingles", "key", "bands", "sketch"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, bands binary, sketch binary"), "fingerprints")


def band_entries(nodes: DataFrame, s: Settings) -> DataFrame:
    """bh, node: a row a band."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bh = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            node = np.repeat(batch.column(0).to_numpy(), s.bands)
            yield pa.RecordBatch.from_arrays([pa.array(bh), pa.array(node)], ["bh", "node"])

    return nodes.select("doc_id", "bands").mapInArrow(run, "bh bigint, node bigint")


def verify(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar.  texts: node, text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, shingles(x.encode().lower().split(), s.words))
                keep.append(similar(last[1], shingles(y.encode().lower().split(), s.words), s.percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    # a node in very many pairs makes a skewed partition, which adaptive execution splits
    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "similar")


def hot_join(left: DataFrame, right: DataFrame, hot: Column) -> DataFrame:
    """left with right's facts of its bucket (unique bh); buckets that are hot by a column of right, few, go salted."""
    few = stage(right.where(hot), "hot")
    cold = salted_join(left, few.select("bh"), ["bh"], "left_anti", staged=True).join(right.where(~hot), "bh")
    return salted_join(left, few, ["bh"], staged=True).unionByName(cold)


def facts(members: DataFrame, *most: str) -> DataFrame:
    """bh, main (its largest component), n_main, n_rest, and the greatest of further columns: of buckets with several
    components.  members: bh, node, comp."""
    sizes = members.groupBy("bh", "comp").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in most))
    each = sizes.groupBy("bh").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("comps"), *(F.max(c).alias(c) for c in most))
    return each.where("comps > 1").select("bh", "main", "n_main", (F.col("n") - F.col("n_main")).alias("n_rest"), *most)


def by_sketch(s: Settings) -> Callable[[Column], Column]:
    """Members of a chunk, by how many are dealt: half of them within bounds, so that few copies are dealt."""
    return lambda n: F.least(F.lit(8 * s.chunk), F.greatest(F.lit(s.chunk), F.ceil(n / 2)))


def by_set(s: Settings) -> Callable[[Column], Column]:
    """Members of a chunk, by the longest set of their bucket."""
    return lambda _: F.greatest(F.lit(s.set_chunk), F.least(F.lit(8 * s.set_chunk), F.floor(F.lit(s.set_codes) / F.col("longest"))))


def units(members: DataFrame, chunk: int | Callable[[Column], Column], *carried: str) -> DataFrame:
    """bh, lo, hi, first, then the carried columns, sorted by unit.  A unit is a pair of chunks of a bucket's members
    outside its largest component (lo, hi >= 0), or such a chunk and one of that component (lo >= 0, hi < 0).
    A bucket of one chunk in all is one unit.  members have the facts of their bucket; chunk may follow from them and
    from how many are dealt."""
    size = chunk if callable(chunk) else lambda _: F.lit(chunk)
    chunks = lambda n: F.ceil(F.col(n) / size(F.col(n))).cast("int")
    every = F.col("n_main") + F.col("n_rest")
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("first")))
    main = F.col("comp") == F.col("main")
    at = F.pmod(F.xxhash64("node"), F.when(main, chunks("n_main")).otherwise(chunks("n_rest"))).cast("int")
    rest = F.transform(F.sequence(F.lit(0), chunks("n_rest") - 1), lambda j: F.struct(F.least("_i", j).alias("lo"), F.greatest("_i", j).alias("hi"), (F.col("_i") <= j).alias("first")))
    to_main = F.transform(F.sequence(F.lit(1), chunks("n_main")), lambda j: F.struct(F.col("_i").alias("lo"), (-j).alias("hi"), F.lit(True).alias("first")))
    of_main = F.transform(F.sequence(F.lit(0), chunks("n_rest") - 1), lambda j: F.struct(j.alias("lo"), (-F.col("_i") - 1).alias("hi"), F.lit(False).alias("first")))
    dealt = members.withColumn("_i", at).withColumn("_u", F.explode(F.when(every <= size(every), one).when(main, of_main).otherwise(F.concat(rest, to_main))))
    unit = dealt.select("bh", "_u.lo", "_u.hi", "_u.first", *carried)
    return unit.repartition("bh", "lo", "hi").sortWithinPartitions("bh", "lo", "hi", "node")


def by_unit(batches) -> Iterator[list[tuple]]:
    """The rows of one unit after the other."""
    held: list[tuple] = []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def promising(rows: list[tuple], s: Settings) -> Iterator[tuple[tuple, list[tuple]]]:
    """A member and those it may link with across components, by size and sketch; a pair appears in the bucket of
    its first common band only.  rows: bh, lo, hi, first, node, comp, n, sketch, bands, ..."""
    square = rows[0][1] == rows[0][2]
    if square:  # the largest component's members stand last and are no left sides, as they meet only each other
        main = Counter(r[5] for r in rows).most_common(1)[0][0]
        left = [r for r in rows if r[5] != main]
        rows = left + [r for r in rows if r[5] == main]
    else:
        left = [r for r in rows if r[3]]
    right = rows if square else [r for r in rows if not r[3]]
    if not left or not right:
        return
    comp, n = np.array([r[5] for r in right]), np.array([r[6] for r in right])
    if len(left) + len(right) > 2 and (comp == comp[0]).all() and all(r[5] == comp[0] for r in left):
        return
    sketch = np.frombuffer(b"".join(r[7] for r in right), np.uint8).reshape(len(right), -1)
    bands = np.frombuffer(b"".join(r[8] for r in right), np.int64).reshape(len(right), -1)
    for k, r in enumerate(left):
        ok = (comp != r[5]) & (100 * np.minimum(n, r[6]) >= s.percent * np.maximum(n, r[6]))
        if square:
            ok[: k + 1] = False
        at = np.flatnonzero(ok)
        if len(at):
            at = at[(sketch[at] == np.frombuffer(r[7], np.uint8)).sum(1) >= s.least_equal * s.size]
        if len(at):
            own = np.frombuffer(r[8], np.int64)
            at = at[own[(bands[at] == own).argmax(1)] == r[0]]
        if len(at):
            yield r, [right[i] for i in at]


def flagged(members: DataFrame, s: Settings) -> DataFrame:
    """bh, node, longest (its set): the members of a bucket that may link across components there."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in by_unit(batches):
            some: set[tuple[int, int]] = set()
            for r, partners in promising(rows, s):
                some.add((r[4], r[6]))
                some.update((x[4], x[6]) for x in partners)
            if some:
                node, n = zip(*sorted(some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([rows[0][0]] * len(some), node, n)], ["bh", "node", "longest"])

    carried = ["node", "comp", "n", "sketch", "bands"]
    found = units(members, by_sketch(s), *carried).mapInArrow(run, "bh bigint, node bigint, longest bigint")
    return found.groupBy("bh", "node").agg(F.max("longest").alias("longest"))


class Shared:
    """How many shingles a row of a unit shares with others; rows hold their sets in column 9.  Against many others
    the sets are numbered once a unit, while that is small."""

    def __init__(self, rows: list[tuple], many: int = 32, most: int = 1_000_000):
        self.rows, self.many = rows, many if sum(len(r[9]) for r in rows) <= 8 * most else len(rows) + 1
        self.numbers: dict[int, np.ndarray] = {}

    def __call__(self, r: tuple, others: list[tuple]) -> np.ndarray:
        if len(others) < self.many:
            codes = np.frombuffer(r[9], np.uint64)
            return np.array([len(np.intersect1d(codes, np.frombuffer(x[9], np.uint64), assume_unique=True)) for x in others])
        if not self.numbers:
            flat, at = np.unique(np.frombuffer(b"".join(x[9] for x in self.rows), np.uint64), return_inverse=True)
            ends = np.cumsum([len(x[9]) // 8 for x in self.rows])[:-1]
            self.numbers = {id(x): part for x, part in zip(self.rows, np.split(at.astype(np.int32), ends), strict=True)}
            self.marks = np.zeros(len(flat), np.int32)
        own, sets = self.numbers[id(r)], [self.numbers[id(x)] for x in others]
        self.marks[own] = 1
        counts = np.add.reduceat(self.marks[np.concatenate(sets)], np.cumsum([0, *map(len, sets[:-1])]))  # no set is empty
        self.marks[own] = 0
        return counts


def link(members: DataFrame, s: Settings) -> DataFrame:
    """Edges that connect what is similar across components; members carry their full shingle sets in `codes`."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in by_unit(batches):
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            out, shared = [], Shared(rows)
            for r, partners in promising(rows, s):
                partners = [x for x in partners if find(r[5]) != find(x[5])]
                for x, both in zip(partners, shared(r, partners).tolist(), strict=True):
                    if both and 100 * both >= s.percent * ((len(r[9]) + len(x[9])) // 8 - both) and find(r[5]) != find(x[5]):
                        root[find(r[5])] = find(x[5])
                        out.append((r[4], x[4]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    carried = ["node", "comp", "n", "sketch", "bands", "codes"]
    return stage(units(members, by_set(s), *carried).mapInArrow(run, "a bigint, b bigint"), "across")


def shingle_sets(texts: DataFrame, s: Settings) -> DataFrame:
    """node, codes (the sorted set, 8 bytes a shingle)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [shingles(t.encode().lower().split(), s.words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["node", "codes"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, codes binary")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept for every row.

    Links join documents whose shingle sets have a Jaccard similarity of at least settings.percent.  Null, empty
    and blank texts have no shingles and no links.  Rows with one doc_id are one document to the links; a null
    doc_id is linked with nothing, has no component and is kept.  An empty table gives no rows; other columns are
    ignored.
    """
    s = settings
    full = fingerprints(docs, s, doc_id, text)
    prints = stage(full.select("doc_id", "n_shingles", "key"), "prints")
    named = prints.where("doc_id is not null and n_shingles > 0")
    classes = stage(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    nodes = stage(full.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), "key"), ["key", "doc_id"], "left_semi"), "nodes")
    drop(full)
    entries = band_entries(nodes, s)
    buckets = stage(entries.groupBy("bh").agg(F.count("*").alias("many"), F.min("node").alias("least")).where("many > 1"), "buckets")
    hot = F.col("many") > s.hot
    members = stage(hot_join(entries, buckets, hot), "members")  # only of buckets with several nodes
    candidates = stage(members.groupBy("node").agg(F.min("least").alias("least")), "candidates")
    wanted = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).cast("string").alias("text")).where("text is not null")
    texts = salted_join(wanted, candidates.select("node"), ["node"], "left_semi", salts=1, most=s.broadcast_ids, staged=True)
    kept_texts = [stage(texts, "texts")] if candidates.count() > s.broadcast_ids else []  # else read where they lie
    texts = kept_texts[0] if kept_texts else texts
    sketches = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "bands")
    sketches = stage(sketches.join(candidates, "node", "left_semi").dropDuplicates(["node", "sketch"]), "sketches")
    drop(nodes)
    # rows with one id and several texts make one document
    print_ = F.xxhash64("key")
    several = named.groupBy("doc_id").agg(F.min(print_).alias("lo"), F.max(print_).alias("hi")).where("lo <> hi").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    links = verify(candidates.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")), texts, s).unionByName(same)
    comps = connected_components(links)
    labelled = stage(members.join(comps, "node", "left").select("bh", "node", F.coalesce("component", "node").alias("comp")), "labelled")
    mixed = stage(facts(labelled), "mixed")
    drop(members, *kept_texts)
    large = F.col("n_main") + F.col("n_rest") > s.hot
    some = hot_join(labelled, mixed, large).join(sketches, "node")
    open_ = stage(flagged(some, s), "open")
    few = stage(open_.select("node").distinct(), "few")
    sets = stage(shingle_sets(salted_join(wanted, few, ["node"], "left_semi", salts=1, most=s.broadcast_ids, staged=True), s), "sets")
    apart = stage(open_.join(labelled.distinct(), ["bh", "node"]), "apart")
    drop(labelled)
    late = hot_join(apart.drop("longest"), stage(facts(apart, "longest"), "mixed"), large).join(sketches, "node").join(sets, "node")
    across = link(late, s)
    drop(sketches, sets)
    comps = connected_components(links.unionByName(across))
    small = classes.join(comps, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"), "copies", "rep")
    moved = small.where("copies > 1 or component <> rep").select("key", "component")
    out = salted_join(prints.select("doc_id", "n_shingles", "key"), moved, ["key"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The rows of docs that `near_duplicates` keeps, with their columns, whatever the names of others.

    Of rows with one id, one stays.  Null, empty and blank texts are near-duplicates of nothing and stay; rows
    without an id all stay.  An empty table gives no rows.
    """
    s = settings
    verdict = near_duplicates(docs, s, doc_id, text).where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    marked = stage(verdict.where("not kept or n > 1"), "verdict")
    rows = docs.select(whole(docs), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("print"))

    def part(ids: DataFrame, how: str) -> DataFrame:
        return salted_join(rows, ids.select("id"), ["id"], how, salts=1, most=s.broadcast_ids)

    several = part(marked.where("kept"), "left_semi").groupBy("id").agg(F.min_by("doc", "print").alias("doc"))
    return part(marked, "left_anti").select("doc.*").unionByName(several.select("doc.*"))
