"""Byte-level BPE by a hierarchical-bitmap rank queue, and its inverse.

Each pre-token is a doubly linked list of symbols.  A pair of neighbours whose joined bytes are a vocabulary
entry waits in the bucket of that entry's rank.  Two levels of bitmaps say which buckets hold something, so
find-first-set gives the least rank in constant time, whatever the pre-token's length; entries whose pair has
changed meanwhile are stale and skipped.  A bucket is a heap of positions, as equal ranks merge leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import slices

#: Pre-tokens a worker remembers; a full memory is emptied, which costs time and never changes a result.
MEMORY = 1_000_000
#: Longer pre-tokens are not remembered.
REMEMBERED = 64


class RankQueueBPE:
    """encode(text) -> ids and decode(ids) -> bytes for the ranks of a tiktoken file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.joined = _Joined(self)
        self.known: dict[str, bytes] = {}  # pre-token -> its ids as unsigned 32-bit

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token.  They share one queue: no pair reaches over an end, so each merges as alone."""
        symbol = list(map(self.single.__getitem__, b"".join(tokens)))
        n, pair = len(symbol), self.joined.__getitem__
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(accumulate(map(len, tokens)))
        for end in ends:
            if end:
                after[end - 1] = n
            if end < n:
                before[end] = -1
        bucket: dict[int, list[int]] = {}
        for i in range(n - 1):
            if after[i] < n and (rank := pair(symbol[i] << 32 | symbol[i + 1])) >= 0:
                if rank in bucket:
                    bucket[rank].append(i)  # ascending, hence a heap
                else:
                    bucket[rank] = [i]
        low: dict[int, int] = {}  # 64 ranks a word
        high = 0  # a bit for each word that is not 0
        for rank in bucket:
            low[rank >> 6] = low.get(rank >> 6, 0) | 1 << (rank & 63)
            high |= 1 << (rank >> 6)
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            bit = (bits & -bits).bit_length() - 1
            rank = word << 6 | bit
            heap = bucket[rank]
            if len(heap) == 1:
                todo, heap[:] = iter(heap.copy()), []
            else:
                todo = _drain(heap)
            sooner = False
            for i in todo:
                j = after[i]
                if j >= n or symbol[i] < 0 or pair(symbol[i] << 32 | symbol[j]) != rank:
                    continue  # stale
                symbol[i], symbol[j] = rank, -1
                k = after[i] = after[j]
                h = before[i]
                if h >= 0 and (new := pair(symbol[h] << 32 | rank)) >= 0:
                    if bucket.get(new):
                        heappush(bucket[new], h)
                    else:
                        bucket[new] = [h]
                        low[new >> 6] = low.get(new >> 6, 0) | 1 << (new & 63)
                        high |= 1 << (new >> 6)
                    sooner = new < rank
                if k < n:
                    before[k] = i
                    if (new := pair(rank << 32 | symbol[k])) >= 0:
                        if bucket.get(new):
                            heappush(bucket[new], i)
                        else:
                            bucket[new] = [i]
                            low[new >> 6] = low.get(new >> 6, 0) | 1 << (new & 63)
                            high |= 1 << (new >> 6)
                        sooner = sooner or new < rank
                if sooner:
                    break
            if not heap:
                low[word] &= ~(1 << bit)
                if not low[word]:
                    high &= ~(1 << word)
        return [[x for x in symbol[a:b] if x >= 0] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; pre-tokens not yet known go through the queue together, about a MB at a time."""
        for start in range(0, len(texts), 256):
            if len(self.known) > MEMORY:
                self.known.clear()
            known, split, found, new = self.known, [self.split(t) for t in texts[start : start + 256]], [], set()
            for tokens in split:
                found.append(list(map(known.get, tokens)))
                if None in found[-1]:
                    new.update(x for x in tokens if x not in known)
                    found[-1] = None
            size, some = 0, []
            for x in new:
                some.append(x)
                size += len(x)
                if size > 1 << 20:
                    self.learn(some)
                    size, some = 0, []
            self.learn(some)
            for tokens, got in zip(split, found, strict=True):
                yield np.frombuffer(b"".join(map(known.__getitem__, tokens) if got is None else got), np.uint32)
            for x in new:
                if len(x) > REMEMBERED:
                    del known[x]

    def learn(self, tokens: list[str]) -> None:
        raw = [x.encode() for x in tokens]
        whole = [self.ranks.get(x) for x in raw]
        merged = iter(self.merge([x for x, w in zip(raw, whole, strict=True) if w is None]))
        for x, w in zip(tokens, whole, strict=True):
            self.known[x] = array("I", next(merged) if w is None else [w]).tobytes()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Joined(dict):
    """left << 32 | right -> rank of the joined bytes, -1 if none."""

    def __init__(self, codec: RankQueueBPE):
        super().__init__()
        self.codec = codec

    def __missing__(self, key: int) -> int:
        if len(self) > MEMORY:
            self.clear()
        names = self.codec.bytes
        rank = self[key] = self.codec.ranks.get(names[key >> 32] + names[key & 0xFFFFFFFF], -1)
        return rank


def _drain(heap: list[int]) -> Iterator[int]:
    """The positions of a bucket, leftmost first; those not taken stay."""
    while heap:
        yield heappop(heap)


_codecs: dict[tuple[str, str], RankQueueBPE] = {}


def codec(path: str, pattern: str) -> RankQueueBPE:
    """One codec a worker process, with its memory of pre-tokens."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = RankQueueBPE(path, pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Every text's tokens and its round trip: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids if asked).

    Null and empty texts have no tokens and the digests of nothing.  Repeated rows each give a row, a null
    doc_id stays null, and other columns are ignored.  path must be readable on every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        bpe = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            rows = []
            for got in map(np.ndarray.tolist, bpe.encode_many([t or "" for t in batch.column(1).to_pylist()])):
                rows.append((len(got), sha(",".join(map(bpe.names.__getitem__, got)).encode()), sha(bpe.decode(got)), *([got] if ids else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (3 + ids)
            out = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
