"""The operators' queries with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinnabar.llm import bpe, embed_join, host_rules, html_wrapper, lbl, minhash, packing, pii, quality_fm, secret_ledger
from cinnabar.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan(table(spark, sf_dir, "documents"))


def op9_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_fm": op2_quality_fm,
    "op3_html_wrapper": op3_html_wrapper,
    "op4_bpe": op4_bpe,
    "op5_embed_join": op5_embed_join,
    "op6_packing": op6_packing,
    "op7_host_rules": op7_host_rules,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_lbl": op9_lbl,
    "op10_minhash": op10_minhash,
}
def _secrets_sql() -> str:
    """Matches with their places, from what lies between them; RE2 needs no possessive forms to stay linear."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + f"|{either('api')}_?{either('key')}"
    quote = "[\"'']?"
    assign = f"(?:{keys}){quote} *[:=] *{quote}([A-Za-z0-9+/_.=-]+)"
    rules = [
        ("assign", assign, f"length(regexp_extract(m, '{assign}', 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
        ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "true"),
        ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    ]
    parts = [
        f"""SELECT r, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
   SELECT r, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
   FROM (SELECT r, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(string_split_regex(t, '{p}')[:-2]) AS g, unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i FROM docs)
   WINDOW w AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {ok}"""
        for k, (kind, p, ok) in enumerate(rules)
    ]
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 spans AS ({' UNION ALL '.join(parts)}),
 named AS (SELECT r, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM spans),
 sums AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
   string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (r)"""


_WORD = r"[^\x20\x09-\x0D]"
_REACH = """reach(v, r) AS (SELECT v, v FROM nodes UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r),
 comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)"""

#: SQL that gives the same rows; the other operators train models, use tokenizers or score graphs.
ORACLES: dict[str, str] = {
    "op5_embed_join": f"""WITH RECURSIVE vecs AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 fine AS (SELECT v, e, sqrt(list_dot_product(e, e)) AS norm FROM vecs
   WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
 nodes AS (SELECT v FROM vecs),
 edges AS (SELECT x.v AS a, y.v AS b FROM fine x JOIN fine y ON x.v <> y.v AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
 links AS (SELECT a AS v, count(*) AS n FROM edges GROUP BY a),
 {_REACH}
SELECT v AS vec_id, coalesce(n, 0) AS n_links, component_id, v = component_id AS kept FROM comp LEFT JOIN links USING (v)""",
    "op7_host_rules": rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
 cut AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs),
 spans AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM cut)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM spans) WHERE n > 1),
 repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
 counts AS (SELECT r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM cut LEFT JOIN repeated USING (r)),
 base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
 judged AS (SELECT *, base_failed OR 10 * n_symbols > 5 * n_words OR 100 * n_dup_lines > 60 * n_lines AS rule_failed FROM base),
 hosts AS (SELECT host, count(*) AS n, count(*) FILTER (rule_failed) AS f FROM judged GROUP BY host),
 prior AS (SELECT least(greatest(sum(f) / sum(n)::DOUBLE, 1e-6), 1 - 1e-6) AS m, var_pop(f / n::DOUBLE) AS v, avg(1 / n::DOUBLE) AS i, sum(n)::DOUBLE AS n FROM hosts),
 strength AS (SELECT m, CASE WHEN v - m * (1 - m) * i > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * i) - 1, 1), n) ELSE n END AS s FROM prior),
 bad AS (SELECT host FROM hosts, strength WHERE (f + m * s) / (hosts.n + s) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed, NOT rule_failed AND host NOT IN (SELECT host FROM bad) AS kept FROM judged""",
    "op8_secret_ledger": _secrets_sql(),
    "op10_minhash": rf"""WITH RECURSIVE cut AS (SELECT doc_id AS v, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents),
 shingles AS (SELECT DISTINCT v, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT v, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cut WHERE len(w) > 0)),
 sizes AS (SELECT v, count(*) AS n FROM shingles GROUP BY v),
 nodes AS (SELECT v FROM cut),
 shared AS (SELECT x.v AS a, y.v AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.v <> y.v GROUP BY x.v, y.v),
 edges AS (SELECT a, b FROM shared JOIN sizes p ON p.v = a JOIN sizes q ON q.v = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
 {_REACH}
SELECT v AS doc_id, coalesce(n, 0) AS n_shingles, component_id, v = component_id AS kept FROM comp LEFT JOIN sizes USING (v)""",
}
