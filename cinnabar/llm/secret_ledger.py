"""Secret scans over an incremental blob ledger.

A text is a blob under its SHA-256, however many documents or versions hold it.  The ledger is a table with a row
for each time a blob was scanned: the rules (with their versions) that ran and the spans they found.  A run compares
hashes with the ledger, scans only the pairs of blob and rule version that it lacks, each in one row that holds the
blob, appends what it found, and joins the ledger's spans back to every document that holds the blob.  Texts that are
known are not moved.  DataFrame functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.llm import native
from cinnabar.llm.common import salted_join, shared_dir, stage, whole


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    hint: str | None = None  # a literal that every match contains
    valid: str | None = None  # SQL on a match x, for what the pattern leaves open

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEY = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: The base rules; runs and lengths are matched whole, so a match that is too short is dropped and not retried.
BASE = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]++", valid=f"length(regexp_extract(x.t, r'^{_KEY.replace(chr(39), chr(92) + 'x27')}([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    Rule("access", "AKIA[A-Z0-9]++", hint="AKIA", valid="length(x.t) >= 20"),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{24,}+"),
)
#: Formats that providers publish.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge", "(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", hint="gh"),
    Rule("chat", "(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+", hint="xox"),
    Rule("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\\.eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+", hint="eyJ"),
)
SPANS = "array<struct<rule: string, kind: string, s: int, e: int>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """sha, rules (those run), spans.  blobs: sha, text, seen (names of rules that need not run)."""
    df = blobs
    for i, r in enumerate(rules):
        hint = ~F.array_contains("seen", r.name)
        if r.hint:
            hint = hint & F.col("text").contains(r.hint)
        df = df.withColumn(f"_f{i}", native.found("text", r.pattern, hint))
    for i, r in enumerate(rules):
        df = df.withColumn(f"_g{i}", native.gaps("text", r.pattern, f"_f{i}"))
    parts = []
    for i, r in enumerate(rules):
        df = df.withColumn(f"_m{i}", native.matches("text", f"_f{i}", f"_g{i}"))
        kept = f"filter(_m{i}, x -> {r.valid})" if r.valid else f"_m{i}"
        parts.append(f"transform({kept}, x -> named_struct('rule', '{r.name}', 'kind', '{r.kind}', 's', x.s, 'e', x.e))")
    names = F.array(*(F.lit(r.name) for r in rules))
    return df.select("sha", F.array_except(names, "seen").alias("rules"), F.expr(f"cast(concat({', '.join(parts)}) as {SPANS})").alias("spans"))


class Ledger:
    """The table at `path`, which may not exist yet.  Each run appends one batch, whose files appear as a whole."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return None
        return self.spark.read.schema(f"sha string, rules array<string>, spans {SPANS}").parquet(self.path)

    def update(self, texts: DataFrame, keys: DataFrame, rules: tuple[Rule, ...], broadcast: int = 400_000) -> None:
        """Scan what is new in texts (row, sha, text) and append it.  keys: row, sha of the same rows, staged; row is a
        string that need not be unique.  Up to `broadcast` new blobs are looked for where the texts lie."""
        names, none = F.array(*(F.lit(r.name) for r in rules)), F.expr("cast(array() as array<string>)")
        blobs = keys.groupBy("sha").agg(F.min("row").alias("row"))
        old = self.rows()
        if old is None:
            blobs = blobs.withColumn("seen", none)
        else:
            seen = old.select("sha", F.explode("rules").alias("r")).groupBy("sha").agg(F.collect_set("r").alias("seen"))
            blobs = blobs.join(seen, "sha", "left").withColumn("seen", F.coalesce("seen", none))
            blobs = blobs.where(F.size(F.array_except(names, F.col("seen"))) > 0)
        new = stage(blobs, "unseen")
        # a key has one row of new, and the texts of a blob are one row's; only copies of that very row repeat it
        some = salted_join(texts, new, ["sha", "row"], salts=1, most=broadcast, staged=True)
        scan_blobs(some, rules).dropDuplicates(["sha"]).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """sha, spans of the given rule versions, for blobs that have any."""
        names = F.array(*(F.lit(r.name) for r in rules))
        current = F.filter("spans", lambda x: F.array_contains(names, x["rule"]))
        some = self.rows().select("sha", current.alias("spans")).where(F.size("spans") > 0)
        # a few batches a blob; runs that overlap may have scanned it twice
        return some.groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def ordered(spans: str, rules: tuple[Rule, ...]) -> Column:
    """The spans by start, then by rule as listed."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    keyed = F.transform(F.col(spans), lambda x: F.struct(x["s"].alias("s"), F.array_position(kinds, x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, ledger_path: str | None = None, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Without a ledger_path the run starts an empty ledger in the shared folder.  Null texts count as empty; empty
    texts have no spans.  Rows that repeat a text share its scan, rows that repeat an id each get its findings, a
    null doc_id stays null.  An empty table gives no rows; other columns are ignored.
    """
    rules = (*base, *more)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    ledger, keys = _ledger(docs, ledger_path), stage(rows.select("doc_id", "row", "sha"), "paths")
    ledger.update(rows.select("row", "sha", "text"), keys, rules)
    out = salted_join(keys, ledger.findings(rules), ["sha"], "left")
    out = out.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))).withColumn("_all", ordered("spans", rules))
    kinds = F.array(*(F.lit(r.kind) for r in base))
    out = out.withColumn("_base", F.filter("_all", lambda x: F.array_contains(kinds, x["kind"])))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in base]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))


def _ledger(docs: DataFrame, path: str | None) -> Ledger:
    spark = docs.sparkSession
    return Ledger(spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def redact(docs: DataFrame, ledger_path: str | None = None, mark: str = "<secret>", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows with every span in `text` replaced by a mark (overlapping spans by one) and `size`, if there, set
    to the new length.

    Rows without findings pass unchanged, null and empty texts too.  Repeated rows are each redacted; a null doc_id
    stays null; an empty table gives no rows.  All other columns pass as they are, whatever their names.
    """
    rules = (*base, *more)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(whole(docs), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("row"), content.alias("text")).withColumn("sha", F.sha2("text", 256))
    ledger, keys = _ledger(docs, ledger_path), stage(rows.select("row", "sha"), "paths")
    ledger.update(rows.select("row", "sha", "text"), keys, rules)
    spans = ledger.findings(rules).select("sha", ordered("spans", rules).alias("spans"))
    both = salted_join(rows, spans, ["sha"], "left")
    new = """aggregate(spans, named_struct('at', 0, 'out', ''),
        (acc, x) -> named_struct(
            'at', greatest(acc.at, x.e),
            'out', case when x.s >= acc.at then concat(acc.out, substring(text, acc.at + 1, x.s - acc.at), '{mark}') else acc.out end),
        acc -> concat(acc.out, substring(text, acc.at + 1)))"""
    out = both.withColumn("new", F.when(F.col("spans").isNotNull(), F.expr(new.replace("{mark}", mark.replace("\\", "\\\\").replace("'", "\\'")))))
    put = {text: F.col("new").cast(docs.schema[text].dataType)}
    if size in docs.columns:
        put[size] = F.length("new").cast(docs.schema[size].dataType)
    changed = lambda c: F.coalesce(put[c], F.col("doc").getField(c)) if c in put else F.col("doc").getField(c)
    return out.select(*(changed(c).alias(c) for c in docs.columns))
