"""Quality rules per document, and a verdict per host from its documents' failures.

A document's rules are counted in one pass.  Hosts' failure rates are shrunk towards the corpus by a beta prior
fitted to the hosts themselves (method of moments), so a host with few documents is not judged by them alone; a
host whose shrunk rate is too high loses all its documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.llm.common import salted_join, slices, stage, whole

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30  # of the words, those in windows found twice or more
    max_symbols_per_10_words: int = 5
    max_dup_line_percent: int = 60
    #: A host is rejected above this shrunk failure rate.
    max_host_rate: float = 0.6


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more, its first place included.  Exact."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    found: dict[tuple[bytes, ...], int] = Counter(tuple(words[i : i + width]) for i in np.flatnonzero(hit))
    edge = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(hit):
        if found[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for batch in slices(batches):
            rows = [measure(t or "") for t in batch.column(2).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "host", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{n} bigint" for n in names))


def _failures(r: Rules) -> tuple[Column, Column]:
    """base_failed and rule_failed from the counts."""
    base = (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > r.max_symbols_per_10_words * F.col("n_words")) | (100 * F.col("n_dup_lines") > r.max_dup_line_percent * F.col("n_lines"))
    return base, base | soft


def judge(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:  # noqa: B008
    """Per row: doc_id, the five counts, base_failed, rule_failed, host_rate (shrunk), kept.

    base_failed: under min_words words, or too many words in repeated windows.  rule_failed: that, or too many
    symbols or repeated lines.  kept: neither the document nor its host failed.  A null or empty text has no words
    and fails; a null host is the host ''; repeated rows are judged and counted each; an empty table gives no rows.
    """
    r = rules
    measured = features(docs, doc_id, text, host)
    base, failed = _failures(r)
    rows = stage(measured.withColumn("base_failed", base).withColumn("rule_failed", failed), "rules")
    hosts = host_rates(rows)
    bad = hosts.where(F.col("host_rate") > r.max_host_rate).select("host", "host_rate")
    out = salted_join(rows, bad, ["host"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed", "host_rate", (~F.col("rule_failed") & F.col("host_rate").isNull()).alias("kept"))


def kept(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:  # noqa: B008
    """The rows of docs that `judge` keeps, with their columns, whatever their names.

    Null and empty texts fail and go; a null host is the host ''; repeated rows are judged each; an empty table gives
    no rows.  The texts are measured twice, for the hosts and for themselves, which costs less than writing them once more.
    """
    names = ["n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rows = docs.select(whole(docs), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            rows = [measure(t or "") for t in batch.column(2).to_pylist()]
            cols = [[r[k] for r in rows] for k in (0, 2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc", "host", *names])

    schema = T.StructType([rows.schema["doc"], rows.schema["host"], *(T.StructField(n, T.LongType()) for n in names)])
    _, failed = _failures(rules)
    hosts = host_rates(features(docs.select(F.lit(0).alias("_k"), F.col(text), F.col(host)), "_k", text, host).select("host", failed.alias("rule_failed")))
    bad = hosts.where(F.col("host_rate") > rules.max_host_rate).select("host")
    return salted_join(rows.mapInArrow(run, schema).where(~failed), bad, ["host"], "left_anti").select("doc.*")


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failed, host_rate: (failed + a) / (n + a + b), the beta prior (a, b) fitted to all hosts' rates.

    The fit takes the mean rate m and the rates' variance beyond binomial noise; without any such variance the
    prior is as strong as all documents together, and every host has the corpus rate.
    """
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("bigint")).alias("failed")), "hosts")
    rate = F.col("failed") / F.col("n")
    s = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not s["k"]:
        return hosts.withColumn("host_rate", F.lit(0.0))
    m = min(max(s["failed"] / s["n"], 1e-6), 1 - 1e-6)
    noise = m * (1 - m) * s["inverse"]
    extra = s["v"] - noise
    strength = min(max(m * (1 - m) / extra - 1, 1.0), float(s["n"])) if extra > 0 else float(s["n"])
    return hosts.withColumn("host_rate", (F.col("failed") + m * strength) / (F.col("n") + strength))
