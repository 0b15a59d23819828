"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions
of a document's features in time linear in their number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.llm.common import slices, stage, whole

#: Fixed features come first, words are hashed behind them.
STATS, BINS = 14, 16
WORDS = 1 << 17
SIZE = STATS * BINS + WORDS
PUNCTUATION = ".,;:!?"
SYMBOLS = "#*$%&|<>@^~_=+{}[]\\/"


@dataclass(frozen=True)
class Settings:
    #: At most so many labelled documents are learned from, with so many features in all (four bytes each on the
    #: driver): those with the smallest hashes of doc_id, so the same on every run.
    sample: int = 10_000
    features: int = 20_000_000
    factors: int = 8
    epochs: int = 10
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-4
    threshold: float = 0.3
    folds: int = 5
    seed: int = 7


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # SIZE
    factor: np.ndarray  # SIZE x factors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factor[index] * value[:, None]
        return float(self.bias + self.weight[index] @ value + 0.5 * (np.square(v.sum(0)) - np.square(v).sum(0)).sum())


class _Hashed(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        at = self[word] = STATS * BINS + zlib.crc32(word) % WORDS
        return at


_hashed = _Hashed()


def _share(part: float, whole: float) -> int:
    """0 for none, then bins that double: up to 1/4096, ... up to 1/2, above."""
    return 0 if not part or not whole else max(1, min(BINS - 1, 14 + math.ceil(math.log2(part / whole))))


def _log(x: float) -> int:
    return min(BINS - 1, int(math.log2(x + 1)))


def extract(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features.  Words share a length of 1, whatever their number."""
    raw = text.encode()
    words = raw.lower().split()
    n, size = len(words), len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    stats = (
        _log(n),
        _log(size),
        min(BINS - 1, size // n) if n else 0,
        _share(sum(map(text.count, SYMBOLS)), size),
        _share(sum(map(text.count, "0123456789")), size),
        _share(sum(map(text.count, PUNCTUATION)), n),
        _share(n - len(distinct), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        min(BINS - 1, 16 * len(distinct) // (n + 1)),
        _log(n / len(lines)) if lines else 0,
        _log(max(map(len, words))) if n else 0,
        _share(sum(map(text.count, '"\'()')), size),
        _share(text.count("\n"), n + 1),
        0 if n_chars is None or n_chars < 0 else _log(n_chars),  # metadata
    )
    found = np.fromiter(set(map(_hashed.__getitem__, distinct)), np.int64)
    found.sort()
    index = np.concatenate([np.arange(STATS) * BINS + np.array(stats), found])
    value = np.ones(len(index), np.float32)
    value[STATS:] = 1 / math.sqrt(max(1, len(found)))
    return index, value


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> Machine:
    """Logistic loss, AdaGrad on mini-batches; without rows, a machine that says one half."""
    rng = np.random.default_rng(s.seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.01, (SIZE, s.factors)).astype(np.float32))
    if not rows:
        return m
    mean = min(max(float(np.mean([y for *_, y in rows])), 0.01), 0.99)
    m.bias = math.log(mean / (1 - mean))
    seen_w, seen_v = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, s.factors), 1e-4, np.float32)
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), s.batch):
            part = [rows[i] for i in order[k : k + s.batch]]
            index, value = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            starts = np.cumsum([0, *(len(p[0]) for p in part[:-1])])
            row = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            v = m.factor[index] * value[:, None]
            total = np.add.reduceat(v, starts)
            pairs = 0.5 * (np.square(total) - np.add.reduceat(np.square(v), starts)).sum(1)
            margin = m.bias + np.add.reduceat(m.weight[index] * value, starts) + pairs
            error = (1 / (1 + np.exp(-margin)) - np.array([p[2] for p in part])).astype(np.float32) / len(part)
            own, place = np.unique(index, return_inverse=True)
            step = error[row] * value
            grad_w = np.bincount(place, step, len(own)).astype(np.float32) + s.decay * m.weight[own]
            each = step[:, None] * (total[row] - v)
            grad_v = np.stack([np.bincount(place, each[:, f], len(own)) for f in range(s.factors)], 1).astype(np.float32) + s.decay * m.factor[own]
            seen_w[own] += np.square(grad_w)
            seen_v[own] += np.square(grad_v)
            m.weight[own] -= s.rate * grad_w / np.sqrt(seen_w[own])
            m.factor[own] -= 0.2 * s.rate * grad_v / np.sqrt(seen_v[own])
            m.bias -= s.rate * float(error.sum())
    return m


def _documents(docs: DataFrame, doc_id: str, text: str, n_chars: str) -> DataFrame:
    size = F.col(n_chars).cast("bigint") if n_chars in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), size.alias("n_chars"))


def fold(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality", n_chars: str = "n_chars") -> Machine:  # noqa: B008
    """Fit on at most settings.sample labelled documents outside fold 0.  Null ids and labels are skipped; several
    labels of a document are averaged, rows that repeat an id are one document."""
    truth = labels.where((fold(doc_id, settings.folds) != 0) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(label).alias("y"))
    rank = F.xxhash64("doc_id", F.lit(settings.seed))
    some = truth.withColumn("rank", rank).orderBy("rank", "doc_id").limit(settings.sample)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [extract(t or "", n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary())], ["doc_id", "y", "rank", "index"])

    kind = docs.schema[doc_id].dataType.simpleString()
    sample = _documents(docs, doc_id, text, n_chars).join(F.broadcast(some), "doc_id")  # settings.sample rows at most
    # rows with one id are one document
    each = sample.mapInArrow(run, f"doc_id {kind}, y double, rank bigint, index binary").groupBy("doc_id").agg(F.first("y").alias("y"), F.first("rank").alias("rank"), F.min_by("index", F.xxhash64("index")).alias("index"))
    each = stage(each, "sample")
    sizes = each.select("rank", F.length("index").alias("size")).toPandas().sort_values("rank")  # settings.sample rows at most
    fits = sizes["rank"][sizes["size"].cumsum() <= 4 * settings.features]
    rows = each.where(F.col("rank") <= (int(fits.iloc[-1]) if len(fits) else -(1 << 63))).toPandas().sort_values(["rank", "doc_id"])
    data = []
    for y, raw in zip(rows["y"], rows["index"], strict=True):
        index = np.frombuffer(raw, "<i4").astype(np.int64)
        value = np.ones(len(index), np.float32)
        value[STATS:] = 1 / math.sqrt(max(1, len(index) - STATS))
        data.append((index, value, y))
    return fit(data, settings)


def score(docs: DataFrame, machine: Machine, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts score by their statistics alone.  Repeated rows score alike.  A null doc_id is held out,
    as nothing is learned from it.  An empty table gives no rows; other columns but n_chars are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (factors + 1) floats
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            out = []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, m.margin(*extract(t or "", n)))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = _documents(docs, doc_id, text, n_chars).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", settings.folds) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine, settings: Settings = Settings(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:  # noqa: B008
    """The rows of docs that `score` predicts to be good, with their columns, whatever their names.

    Null and empty texts are judged by their statistics alone, repeated rows each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    size = F.col(n_chars).cast("bigint") if n_chars in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select(whole(docs), F.col(text).cast("string").alias("text"), size.alias("n_chars"))
    least = math.log(settings.threshold / (1 - settings.threshold))

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            good = [m.margin(*extract(t or "", n)) >= least for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["doc"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"]])).select("doc.*")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    return score(docs, learn(docs, labels, settings), settings)
