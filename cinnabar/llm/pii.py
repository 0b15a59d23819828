"""Personal data by bootstrapped contextual extraction.  DataFrame functions only.

Seeds are the entities that four base patterns find and validate.  Every seed, every decoy (a match with the form
of its kind that fails a check), every other match and every identifier-like word is an instance; the words around
it, with 0 for their digits, are lexical patterns: the two before, the one before and the one after, the two after.
Patterns and instances form a graph that is scored in turns.  A pattern's score is the share of its distinct instances
that are believed, or of all words that stand in its place in the corpus, whichever is less: a phrase that any word may
follow proves nothing.  An instance is believed if it is a seed or the noisy-or of its patterns is high.  Those newly
believed are the next turn's evidence for patterns with too few seeds, until a turn finds none.  Decoys count against a
pattern and are never taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.llm import native
from cinnabar.llm.common import salted_join, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that each start is tried once and nothing backtracks: a run of the first class is
#: entered only at its start or at the end of the last match.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
VALID = {
    "email": "true",
    "ip": r"forall(split(x.t, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))",
    "card": """length(translate(x.t, ' -', '')) between 16 and 19 and aggregate(
        transform(split(reverse(translate(x.t, ' -', '')), ''), (c, i) -> case when i % 2 = 0 then try_cast(c as int) when try_cast(c as int) > 4 then 2 * try_cast(c as int) - 9 else 2 * try_cast(c as int) end),
        0, (a, v) -> a + coalesce(v, 0)) % 10 = 0""",
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) between 8 and 15",
}
#: Matches that have the form of their kind and fail its check.
DECOY = {"email": "false", "ip": "true", "card": "length(translate(x.t, ' -', '')) between 16 and 19", "phone": "false"}
_WORD = r"[^\x20\x09-\x0D]"
#: A word with a digit or an at sign, tried only at its start.
OTHER = rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+"


@dataclass(frozen=True)
class Settings:
    least_seeds: int = 5  # distinct believed instances that a pattern needs
    least_pattern: float = 0.8
    least_instance: float = 0.9
    least_digits: int = 6  # of an identifier-like word without an at sign
    broadcast: int = 20_000  # more patterns than this meet the counts of all phrases in a shuffle


_GAP = r"[\x20\x09-\x0D]"
#: The two words at the start of a text; anchored and possessive, so it reads no further.
_TWO = rf"^{_GAP}*+({_WORD}++)?+(?:{_GAP}++({_WORD}++))?+"


def _word(text: str, k: int) -> str:
    return f"regexp_replace(lower(regexp_extract({text}, r'{_TWO}', {k})), '[0-9]', '0')"


def _patterns(x: str) -> str:
    """SQL: the patterns of a match; those with a word missing are left out."""
    near = f"reverse({x}.before)"
    words = f"named_struct('b1', reverse({_word(near, 1)}), 'b2', reverse({_word(near, 2)}), 'a1', {_word(x + '.after', 1)}, 'a2', {_word(x + '.after', 2)})"
    made = "filter(array(if(w.b1 <> '' and w.b2 <> '', concat('b ', w.b2, ' ', w.b1), ''), if(w.b1 <> '' and w.a1 <> '', concat('m ', w.b1, ' ', w.a1), ''), if(w.a1 <> '' and w.a2 <> '', concat('a ', w.a1, ' ', w.a2), '')), p -> p <> '')"
    return f"transform(array({words}), w -> {made})[0]"


def detect(docs: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """_row, doc_id, base (spans by kind), instances, staged.  Rows are numbered in the table, not on each read of it."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hints: dict[str, Column] = {
        "email": F.col("text").contains("@"),
        "ip": F.col("text").contains("."),
        "phone": F.col("text").contains("+"),
    }
    patterns = {**BASE, "other": OTHER}
    for k, p in patterns.items():
        df = df.withColumn(f"_f_{k}", native.found("text", p, hints.get(k)))
    for k, p in patterns.items():
        df = df.withColumn(f"_g_{k}", native.gaps("text", p, f"_f_{k}"))
    for k in patterns:
        df = df.withColumn(f"_m_{k}", native.matches("text", f"_f_{k}", f"_g_{k}"))
    df = df.drop("text", *(f"_{x}_{k}" for x in "fg" for k in patterns))
    for k in KINDS:
        df = df.withColumn(f"_v_{k}", F.expr(f"filter(_m_{k}, x -> {VALID[k]})"))

    def instance(kind: str, label: str) -> str:
        return (
            f"named_struct('kind', '{kind}', 'label', {label}, 's', x.s, 'e', x.e, 'name', lower(x.t), "
            f"'p', {_patterns('x')})"
        )

    like = f"(x.t like '%@%' or length(regexp_replace(x.t, '[^0-9]', '')) >= {s.least_digits})"
    free = " and ".join(f"not exists(_v_{k}, y -> y.s < x.e and x.s < y.e)" for k in KINDS)
    # a match of no kind is as open as any other word, if it lies in no seed
    parts = []
    for k in KINDS:
        seen = f"filter(_m_{k}, x -> {VALID[k]} or {DECOY[k]} or ({like} and {free}))"
        parts.append(f"transform({seen}, x -> {instance(k, f'case when {VALID[k]} then 1 when {DECOY[k]} then -1 else 0 end')})")
    overlap = " and ".join(f"not exists(_m_{k}, y -> y.s < x.e and x.s < y.e)" for k in KINDS)
    parts.append(f"transform(filter(_m_other, x -> {like} and {overlap}), x -> {instance('', '0')})")
    every = ", ".join(parts)
    spans = ", ".join(f"transform(_v_{k}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e))" for i, k in enumerate(KINDS))
    df = df.select("doc_id", F.expr(f"array_sort(concat({spans}))").alias("base"), F.expr(f"concat({every})").alias("instances"))
    return stage(df.withColumn("_row", F.monotonically_increasing_id()), "entities")


def fillers(docs: DataFrame, patterns: DataFrame, s: Settings, text: str) -> DataFrame:
    """pattern, fillers: how often any word stands in a pattern's place.  patterns (pattern) is staged."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.col(text).cast("string"), "[0-9]", "0")), f"{_GAP}+"), lambda w: w != "")
    phrase = lambda kind, k, gap: F.expr(f"transform(sequence(1, greatest(size(w) - 2, 0), 1), i -> concat('{kind} ', element_at(w, i + {k}), ' ', element_at(w, i + {k + gap})))")
    three = docs.select(words.alias("w")).where(F.size("w") > 2)
    every = three.select(F.explode(F.concat(phrase("b", 0, 1), phrase("m", 0, 2), phrase("a", 1, 1))).alias("pattern"))
    if patterns.count() <= s.broadcast:
        return every.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("fillers"))
    return every.groupBy("pattern").agg(F.count("*").alias("fillers")).join(patterns, "pattern", "left_semi")


def graph(docs: DataFrame, entities: DataFrame, s: Settings, text: str) -> DataFrame | None:
    """pattern, name, n, label, kind, fillers, staged: the edges of patterns that could come to count, None without any."""
    each = entities.select(F.explode("instances").alias("i")).select("i.kind", "i.label", "i.name", F.explode("i.p").alias("pattern"))
    edges = stage(each.groupBy("pattern", "name").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("label"), F.max("kind").alias("kind")), "edges")
    # without an open instance a pattern discovers nothing; without enough instances it never counts
    able = edges.groupBy("pattern").agg(F.count_if(F.col("low") >= 0).alias("names"), F.count_if((F.col("label") == 0) & (F.col("low") == 0)).alias("open"))
    able = stage(able.where((F.col("names") >= s.least_seeds) & (F.col("open") > 0)).select("pattern"), "patterns")
    if able.isEmpty():
        return None
    some = stage(salted_join(edges, able, ["pattern"], staged=True), "some")
    # a name is what it is in all of its places: a decoy in one is one in the others
    names = some.groupBy("name").agg(F.when(F.min("low") < 0, -1).otherwise(F.max("label")).alias("label"), F.max("kind").alias("kind"))
    counted = fillers(docs, able, s, text)
    return stage(salted_join(salted_join(some.select("pattern", "name", "n"), names, ["name"]), counted, ["pattern"], "left"), "graph")


def bootstrap(edges: DataFrame, s: Settings) -> DataFrame:
    """name, kind of the instances that the patterns discover; turns go on until none is new."""
    best = F.greatest(*(F.col(f"_{k}") for k in KINDS))
    kind = F.coalesce(*(F.when(F.col(f"_{k}") == best, F.lit(k)) for k in KINDS))
    found, many = None, 0
    while True:
        if found is None:
            rows = edges.withColumn("as", F.when(F.col("label") == 1, F.col("kind")))
        else:
            both = salted_join(edges, found.withColumnRenamed("kind", "taken"), ["name"], "left", staged=True)
            rows = both.withColumn("as", F.when(F.col("label") == 1, F.col("kind")).otherwise(F.col("taken")))
        believed = F.col("as").isNotNull()
        stats = rows.groupBy("pattern").agg(
            *(F.count_if(F.col("as") == k).alias(f"_{k}") for k in KINDS),
            F.count_if(believed).alias("believed"),
            F.count("*").alias("names"),
            F.sum(F.when(believed, F.col("n")).otherwise(0)).alias("believed_n"),
            F.greatest(F.max("fillers"), F.sum("n")).alias("places"),
        )
        score = F.least(F.col("believed") / (F.col("names") + 1), F.col("believed_n") / F.col("places"))
        strong = stats.select("pattern", "believed", score.alias("score"), kind.alias("as")).where((F.col("believed") >= s.least_seeds) & (F.col("score") >= s.least_pattern))
        vouched = salted_join(edges.where("label = 0").select("pattern", "name"), strong.drop("believed"), ["pattern"])
        belief = vouched.groupBy("name").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"), F.max_by("as", F.struct("score", "pattern")).alias("kind"))
        found = stage(belief.where(F.col("belief") >= s.least_instance).select("name", "kind"), "discovered")
        was, many = many, found.count()
        if many == was:  # what is believed only grows
            return found


def find(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and the digest are of the base spans; spans has them and the discovered ones, by kind as listed,
    then start (code points, end exclusive), and n_spans is their number.  Null texts count as empty and have no spans.  Repeated rows each get
    a row, but their instances count once; a null doc_id stays null.  An empty table gives no rows; other columns
    are ignored.
    """
    entities = detect(docs, settings, doc_id, text)
    edges = graph(docs, entities, settings, text)
    none = "cast(array() as array<struct<k: int, s: int, e: int>>)"
    order = F.array(*(F.lit(k) for k in KINDS))
    if edges is None:
        return _report(entities.withColumn("added", F.expr(none)), order)
    new = bootstrap(edges, settings)
    places = entities.select("_row", F.explode("instances").alias("i")).where("i.label = 0").select("_row", "i.name", "i.s", "i.e")
    added = salted_join(places, new, ["name"], staged=True).groupBy("_row").agg(F.collect_list(F.struct((F.array_position(order, F.col("kind")) - 1).cast("int").alias("k"), "s", "e")).alias("added"))
    out = entities.select("_row", "doc_id", "base").join(added, "_row", "left")
    return _report(out.withColumn("added", F.coalesce("added", F.expr(none))), order)


def _report(rows: DataFrame, order: Column) -> DataFrame:
    every = F.array_sort(F.concat("base", "added"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(order, x["k"] + 1), x["s"], x["e"])), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(every).cast("bigint").alias("n_spans"))
