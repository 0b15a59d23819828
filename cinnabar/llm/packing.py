"""Best-fit packing by large-item matching.

Only lengths matter for a packing, and there are at most `capacity` of them.  The driver therefore plans on the
histogram of lengths, which has the same size for any input: items above a third of the capacity are matched in
pairs (the largest with the largest that fits beside it, which leaves the fewest bins), then each smaller length,
in descending order, goes to the fullest bins that hold it.  A plan is a few thousand segments "so many items of
this length go to these bins at this offset"; each piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import slices, stage

#: Pieces of one length are ranked in so many independent parts.
PARTS = 64


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, first bin, items a bin, offset) and the number of bins, for lengths up to capacity.

    Items of a segment follow each other by rank: item r is in bin first + (r - rank) // a, at offset + (r - rank) % a * length.
    """
    left = {n: c for n, c in histogram.items() if c}
    done: dict[int, int] = defaultdict(int)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges of bins
    order: list[int] = []
    bins = 0

    def put(length: int, count: int, first: int, each: int, offset: int) -> None:
        segments.append((length, done[length], first, each, offset))
        done[length] += count
        left[length] -= count

    def free(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((lo, hi))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        for b in reversed(large):
            if b > a or a + b > capacity or not left[a] or not left[b]:
                continue
            if a == b:
                if pairs := left[a] // 2:
                    put(a, 2 * pairs, bins, 2, 0)
            elif pairs := min(left[a], left[b]):
                put(a, pairs, bins, 1, 0)
                put(b, pairs, bins, 1, a)
            free(capacity - a - b, bins, bins + pairs)
            bins += pairs
        if alone := left[a]:
            put(a, alone, bins, 1, 0)
            free(capacity - a, bins, bins + alone)
            bins += alone
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                fresh = -(-left[n] // (capacity // n))
                free(capacity, bins, bins + fresh)
                bins += fresh
                continue
            gap = order[at]
            lo, hi = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            each = gap // n
            if full := min(left[n] // each, hi - lo):
                put(n, full * each, lo, each, capacity - gap)
                free(gap - each * n, lo, lo + full)
                lo += full
            if lo < hi and left[n]:
                rest = left[n]
                put(n, rest, lo, each, capacity - gap)
                free(gap - rest * n, lo, lo + 1)
                lo += 1
            free(gap, lo, hi)
    return segments, bins


_tokenizers: dict[tuple[str, str], object] = {}


def _encoder(json_path: str, ranks_path: str, pattern: str):
    """A function text -> ids equal to the tokenizers file's.  tiktoken runs the same vocabulary five times as fast;
    the file's own library takes over for what tiktoken refuses."""
    if (json_path, ranks_path) not in _tokenizers:
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return np.array(fast.encode(text, allowed_special="all"), np.uint32)
            except ValueError:
                from tokenizers import Tokenizer  # heavy, and hardly ever needed

                slow = Tokenizer.from_file(json_path)
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _tokenizers[json_path, ranks_path] = encode
    return _tokenizers[json_path, ranks_path]


def pieces(docs: DataFrame, capacity: int, end: int, json_path: str, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenised documents, cut at the capacity: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        encode = _encoder(json_path, ranks_path, pattern)
        for batch in slices(batches):
            at, out = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    at.append(row)
                    out.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the matching and best fit find.

    A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A document is its ids and then
    `end`; a null or empty text is the end alone.  A longer document is cut so that all pieces but the first are
    full.  Repeated rows and null doc_ids are packed like any other row; an empty table gives no rows; other
    columns are ignored.  Full pieces are sequences by themselves.
    """
    # numbers are part of the table: made anew on each read they would follow the splits of that read
    numbered = pieces(docs, capacity, end, json_path, ranks_path, pattern, doc_id, text).withColumn("_id", F.monotonically_increasing_id())
    cut = stage(numbered.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(PARTS)).cast("int")), "pieces")
    short = cut.where(F.col("length") < capacity)
    held = np.zeros((capacity, PARTS), np.int64)
    for r in short.groupBy("length", "_part").count().collect():  # at most capacity * PARTS rows
        held[r["length"], r["_part"]] = r["count"]
    segments, bins = plan({n: int(c) for n, c in enumerate(held.sum(1))}, capacity)
    by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for n, *rest in segments:
        by_length[n].append(tuple(rest))
    lookup = {n: np.array(x).T for n, x in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast((lookup, np.cumsum(held, 1) - held))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        lookup, before = shared.value
        next_rank = before.copy()  # all pieces of a length and part come to one task, in the order of their numbers
        for batch in slices(batches):
            length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for row, (n, k) in enumerate(zip(length.tolist(), at.tolist(), strict=True)):
                rank = next_rank[n, k]
                next_rank[n, k] = rank + 1
                first_rank, first_bin, each, begin = lookup[n]
                i = first_rank.searchsorted(rank, "right") - 1
                r = rank - first_rank[i]
                sequence[row], offset[row] = first_bin[i] + r // each[i], begin[i] + r % each[i] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    # sorted, so that a task that runs again gives each piece the same place
    dealt = short.select(*columns, "_part", "_id").repartition("length", "_part").sortWithinPartitions("length", "_part", "_id").drop("_id")
    placed = dealt.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
    whole = cut.where(F.col("length") == capacity).select(*columns, (F.lit(bins) + F.col("_id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(whole)
