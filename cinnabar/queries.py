"""Queries for every operator of the engine, over the driver's tables, and the SQL that gives the same rows.

Relations and their domain types: placed(order 0, customer 1), line(order 0, part 4, supplier 5), cust_nation
(customer 1, nation 2), supp_nation(supplier 5, nation 2), in_region(nation 2, region 3), urgent(order 0), building
(customer 1).  Targets: hot_order(order, customer), an urgent order of a building customer; local_order(order), an
order with a line whose supplier is of the customer's nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.functions.scores import area_column, mcc_column, score_column
from cinnabar.operators import bindings as b
from cinnabar.operators import partitioning
from cinnabar.operators.evaluate import by_columns, by_variables, evaluate, label_counts
from cinnabar.operators.staging import stage
from cinnabar.plans import theory
from cinnabar.plans.candidates import enumerate_candidates
from cinnabar.plans.learner import Learner
from cinnabar.plans.model import Clause, Literal, Predicate
from cinnabar.plans.parser import parse_clause, parse_literal

BACKGROUND = (
    Predicate(0, "placed", (0, 1)),
    Predicate(1, "line", (0, 4, 5)),
    Predicate(2, "cust_nation", (1, 2)),
    Predicate(3, "supp_nation", (5, 2)),
    Predicate(4, "in_region", (2, 3)),
    Predicate(5, "urgent", (0,)),
    Predicate(6, "building", (1,)),
)
HOT_ORDER, LOCAL_ORDER = Predicate(7, "hot_order", (0, 1)), Predicate(8, "local_order", (0,))
NAMED = {p.name: p for p in (*BACKGROUND, HOT_ORDER, LOCAL_ORDER)}
LOCAL = "local_order(0) :- placed(0, 1), cust_nation(1, 2), line(0, 3, 4), supp_nation(4, 2)"
HOT = "hot_order(0, 1) :- urgent(0), building(1)"
URGENT = "hot_order(0, 1) :- urgent(0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relations(spark: SparkSession, sf_dir: str) -> dict[Predicate, b.Relation]:
    t = lambda name: table(spark, sf_dir, name)
    frames = {
        "placed": t("orders").select("o_orderkey", "o_custkey"),
        "line": t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"),
        "cust_nation": t("customer").select("c_custkey", "c_nationkey"),
        "supp_nation": t("supplier").select("s_suppkey", "s_nationkey"),
        "in_region": t("nation").select("n_nationkey", "n_regionkey"),
        "urgent": t("orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey"),
        "building": t("customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey"),
    }
    return {NAMED[n]: b.Relation.of(NAMED[n], df) for n, df in frames.items()}


def hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v0, v1, label."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    label = (F.col("o_orderpriority") == "1-URGENT") & (F.col("c_mktsegment") == "BUILDING")
    return b.examples(both.select("o_orderkey", "o_custkey", label.alias("label")), 2)


def local_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v0, label."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = b.examples(orders.withColumn("label", F.lit(True)), 1)
    return theory.coverage([clause(LOCAL)], rows, relations(spark, sf_dir)).select("v0", F.col("covered").alias("label"))


def literal(text: str) -> Literal:
    return parse_literal(text, NAMED)


def clause(text: str) -> Clause:
    return parse_clause(text, NAMED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_HOT = """hot AS (SELECT o_orderkey AS v0, o_custkey AS v1, (o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING') AS label
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
_LOCAL = """local_keys AS (SELECT DISTINCT o_orderkey AS v0 FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey)"""


# scans


@query("SELECT o_orderkey AS c0, o_custkey AS c1 FROM orders")
def scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir)[NAMED["placed"]].df


@query("SELECT l_orderkey AS c0, l_suppkey AS c1 FROM lineitem")
def scan_skip_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that are kept reach the scan."""
    return b.Relation.of(Predicate(0, "shipped", (0, 5)), table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"]).df


@query("SELECT o_orderkey AS v0, row_number() OVER (ORDER BY o_orderkey) <= 700 AS label FROM orders")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 700 rows by key are positive."""
    rows = partitioning.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("v0"), (F.col("row") < 700).alias("label"))


@query("SELECT c_custkey AS v0, row_number() OVER (ORDER BY c_custkey) <= 70 AS label FROM customer")
def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = partitioning.numbered(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return rows.select(F.col("c_custkey").alias("v0"), (F.col("row") < 70).alias("label"))


@query("SELECT count(*) AS n, 'placed' AS relation FROM orders UNION ALL SELECT count(*), 'line' FROM lineitem UNION ALL SELECT count(*), 'cust_nation' FROM customer UNION ALL SELECT count(*), 'supp_nation' FROM supplier UNION ALL SELECT count(*), 'in_region' FROM nation UNION ALL SELECT count(*), 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT count(*), 'building' FROM customer WHERE c_mktsegment = 'BUILDING'")
def relation_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for p, r in relations(spark, sf_dir).items():
        one = r.df.agg(F.count("*").alias("n")).withColumn("relation", F.lit(p.name))
        out = one if out is None else out.unionByName(one)
    return out


# projection, expressions and filters


@query("SELECT c1 AS customer, c0 AS \"order\" FROM (SELECT o_orderkey AS c0, o_custkey AS c1 FROM orders)")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relations(spark, sf_dir)[NAMED["placed"]].df
    return df.select(F.col("c1").alias("customer"), F.col("c0").alias("order"))


@query(f"WITH {_HOT} SELECT v0, v1 FROM hot WHERE label")
def filter_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_orders(spark, sf_dir).where("label").select("v0", "v1")


@query("SELECT l_orderkey AS c0, l_partkey AS c1, l_suppkey AS c2 FROM lineitem WHERE l_partkey = l_suppkey")
def filter_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated variable is an equality on the facts."""
    line = Predicate(1, "line", (0, 4, 4))
    facts = relations(spark, sf_dir)[NAMED["line"]].df
    return b.matching(Literal(line, (0, 1, 1)), facts)


@query("SELECT count(*) FILTER (c0 = c1) AS eq, count(*) FILTER (c0 <> c1) AS ne, count(*) FILTER (c0 < c1) AS lt, count(*) FILTER (c0 > c1) AS gt, count(*) FILTER (c0 <= c1) AS le, count(*) FILTER (c0 >= c1) AS ge FROM (SELECT l_partkey AS c0, l_suppkey AS c1 FROM lineitem)")
def compare_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relations(spark, sf_dir)[NAMED["line"]].df
    x, y = F.col("c1"), F.col("c2")
    ops: dict[str, Column] = {"eq": x == y, "ne": x != y, "lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}
    return df.agg(*(F.count_if(c).alias(n) for n, c in ops.items()))


@query("SELECT o_orderkey AS v0, l_partkey = l_suppkey AS same_part, c_nationkey = s_nationkey AS same_nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey")
def filter_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms as boolean columns of one projection over the join; no row goes."""
    df = _order_lines(spark, sf_dir)
    return df.select("v0", (F.col("v3") == F.col("v4")).alias("same_part"), (F.col("v2") == F.col("v5")).alias("same_nation"))


@query("SELECT o_orderkey AS v0, l_partkey AS v3, l_suppkey AS v4 FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey AND l_partkey > l_suppkey")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _order_lines(spark, sf_dir)
    return df.where((F.col("v2") == F.col("v5")) & (F.col("v3") > F.col("v4"))).select("v0", "v3", "v4")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v0 order, v1 customer, v2 its nation, v3 part, v4 supplier, v5 its nation."""
    r = relations(spark, sf_dir)
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("v0"))
    for text in ("placed(0, -1)", "cust_nation(1, -1)", "line(0, -1, -1)", "supp_nation(4, -1)"):
        df = b.extend(df, literal(text), r)
    return df


# joins


@query(f"WITH {_HOT} SELECT v0, v1, label, l_partkey AS v2, l_suppkey AS v3 FROM hot JOIN lineitem ON l_orderkey = v0")
def join_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.extend(hot_orders(spark, sf_dir), literal("line(0, -1, -1)"), relations(spark, sf_dir))


@query(f"WITH {_HOT} SELECT v0, v1, label FROM hot JOIN orders ON o_orderkey = v0 AND o_custkey = v1")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.extend(hot_orders(spark, sf_dir), literal("placed(0, 1)"), relations(spark, sf_dir))


@query(f"WITH {_HOT} SELECT v1 AS customer, l_suppkey AS supplier FROM hot JOIN lineitem ON l_orderkey = v0")
def join_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the projected columns of either side are read."""
    return join_single_key(spark, sf_dir).select(F.col("v1").alias("customer"), F.col("v3").alias("supplier"))


@query(f"WITH {_HOT} SELECT label, count(*) AS n FROM hot JOIN lineitem ON l_orderkey = v0 GROUP BY label")
def join_label_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the examples in one join, the label as a column."""
    return join_single_key(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_HOT} SELECT v0, v1, label, c_nationkey AS v2, n_regionkey AS v3 FROM hot JOIN customer ON c_custkey = v1 JOIN nation ON n_nationkey = c_nationkey")
def extend_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relations(spark, sf_dir)
    return b.extend(b.extend(hot_orders(spark, sf_dir), literal("cust_nation(1, -1)"), r), literal("in_region(2, -1)"), r)


@query("SELECT o_orderkey AS v0, o_custkey AS v1, c_nationkey AS v2 FROM orders JOIN customer ON c_custkey = o_custkey")
def extend_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hot_orders(spark, sf_dir).drop("label")
    return b.extend(rows, literal("cust_nation(1, -1)"), relations(spark, sf_dir))


@query(f"WITH {_HOT} SELECT v0, v1, label FROM hot WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v0)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.covered(hot_orders(spark, sf_dir), literal("line(0, -1, -1)"), relations(spark, sf_dir))


@query("SELECT l_orderkey AS v0, l_partkey AS v1, l_suppkey AS v2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output side is the larger one; Spark chooses what to build on."""
    r = relations(spark, sf_dir)
    rows = r[NAMED["line"]].df.toDF("v0", "v1", "v2")
    return b.covered(rows, literal("urgent(0)"), r)


@query(f"WITH {_HOT} SELECT v0, v1, label FROM hot WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v0)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.not_covered(hot_orders(spark, sf_dir), literal("line(0, -1, -1)"), relations(spark, sf_dir))


@query(f"WITH {_LOCAL} SELECT o_orderkey AS v0 FROM orders WHERE o_orderkey IN (SELECT v0 FROM local_keys)")
def coverage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of the body, a semi-join for its last literal, the heads, the examples with such a head."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("v0"))
    return b.covered_examples(clause(LOCAL), rows, relations(spark, sf_dir))


@query(f"WITH {_LOCAL} SELECT v0 FROM local_keys")
def distinct_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("v0"))
    return b.heads(clause(LOCAL), rows, relations(spark, sf_dir)).distinct()


@query("SELECT a.l_suppkey AS supplier, b.l_suppkey AS other, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY 1, 2")
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate twice in a body: line(0, 1, 2), line(0, 1, 3)."""
    r = relations(spark, sf_dir)
    rows = r[NAMED["line"]].df.toDF("v0", "v1", "v2")
    twice = b.extend(rows, literal("line(0, 1, -1)"), r)
    return twice.groupBy(F.col("v2").alias("supplier"), F.col("v3").alias("other")).agg(F.count("*").alias("n"))


# aggregation and scoring


@query(f"WITH {_HOT} SELECT CAST(count(*) FILTER (label) AS BIGINT) AS bp, count(*) FILTER (NOT label) AS bn, count(DISTINCT v0) FILTER (label) AS p, count(DISTINCT v0) FILTER (NOT label) AS n FROM hot JOIN lineitem ON l_orderkey = v0")
def count_single_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(hot_orders(spark, sf_dir), [literal("line(0, -1, -1)")], relations(spark, sf_dir)).drop("literal_id")


@query(f"WITH {_HOT} SELECT label, count(*) AS n FROM hot WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v0) GROUP BY label")
def count_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding rows with a match, from the two pre-aggregated sides."""
    x = literal("line(0, -1, -1)")
    rows, facts = by_variables(hot_orders(spark, sf_dir), [0]), by_columns(x, relations(spark, sf_dir))
    both = rows.join(facts, b.condition(rows, facts, x)).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return both.select(F.explode(F.create_map(F.lit(True), "p", F.lit(False), "n")).alias("label", "n"))


#: Candidates over hot_order's head, in order.
FIRST = [x for lits in enumerate_candidates(Clause.most_general(HOT_ORDER), BACKGROUND, None)[1].values() for x in lits]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """literal, bp, bn, p, n, mcc, auec, score for every first candidate of hot_order."""
    rows = stage(hot_orders(spark, sf_dir), "examples")
    names = spark.createDataFrame(list(enumerate(map(str, FIRST))), "literal_id int, literal string")
    counts = evaluate(rows, FIRST, relations(spark, sf_dir))
    c = counts.join(F.broadcast(names), "literal_id")  # a row a literal
    col = {x: F.col(x) for x in ("bp", "bn", "p", "n")} | dict(zip("PN", map(F.lit, label_counts(rows)), strict=True))
    return c.select(
        "literal", "bp", "bn", "p", "n",
        mcc_column(col["p"], col["n"], col["P"], col["N"]).alias("mcc"),
        (area_column(col["bp"], col["bn"]) - area_column(col["P"], col["N"])).alias("auec"),
        score_column(**col).alias("score"),
    )


def _scores_sql(rows: str, at: int | str = "") -> str:
    """Counts and scores of the candidates over a table of bindings, as tables whose names end in `at`; a branch of the
    counts is a candidate, from the exploded join."""
    sources = {
        "placed": "SELECT o_orderkey AS c0, o_custkey AS c1 FROM orders",
        "line": "SELECT l_orderkey AS c0, l_partkey AS c1, l_suppkey AS c2 FROM lineitem",
        "cust_nation": "SELECT c_custkey AS c0, c_nationkey AS c1 FROM customer",
        "urgent": "SELECT o_orderkey AS c0 FROM orders WHERE o_orderpriority = '1-URGENT'",
        "building": "SELECT c_custkey AS c0 FROM customer WHERE c_mktsegment = 'BUILDING'",
    }
    parts = []
    for x in FIRST:
        on = " AND ".join(f"h.v{x.terms[i]} = f.c{i}" for i in x.bound)
        parts.append(
            f"SELECT '{x}' AS literal, count(*) FILTER (label) AS bp, count(*) FILTER (NOT label) AS bn, "
            f"count(DISTINCT rid) FILTER (label) AS p, count(DISTINCT rid) FILTER (NOT label) AS n FROM h{at} h JOIN ({sources[x.predicate.name]}) f ON {on}"
        )
    return f"""h{at} AS (SELECT *, row_number() OVER () AS rid FROM {rows}), counts{at} AS ({' UNION ALL '.join(parts)}), total{at} AS (SELECT count(*) FILTER (label) AS P_, count(*) FILTER (NOT label) AS N_ FROM {rows}),
 parts{at} AS (SELECT literal, bp, bn, p, n, {_MCC} AS mcc, ({_area_sql('bp', 'bn')}) - ({_area_sql('P_', 'N_')}) AS auec FROM counts{at}, total{at}),
 scores{at} AS (SELECT *, CASE WHEN 1 + mcc <> 0 AND 1 + auec <> 0 THEN 5 * (1 + auec) * (1 + mcc) / ((1 + mcc) + 4 * (1 + auec)) END AS score FROM parts{at})"""


_MCC = "CASE WHEN p = 0 THEN -1.0 WHEN p = P_ AND n = N_ THEN 0.0 WHEN (p + n) * (P_ + N_ - p - n) > 0 THEN (p * (N_ - n) - n * (P_ - p)) / sqrt((p + n)::DOUBLE * (P_ + N_ - p - n) * N_ * P_) END"


def _area_sql(x: str, y: str) -> str:
    r = f"({x} / ({x} + {y})::DOUBLE)"
    return f"CASE WHEN {x} = 0 THEN 0.0 WHEN {y} = 0 THEN 1.0 ELSE ((1 - {r}) * (1 - {r}) * log2(1 - {r}) - {r} * {r} * log2({r})) * ln(2) + {r} END"


_SCORES = f"{_HOT}, {_scores_sql('hot')}"


@query(f"WITH {_SCORES} SELECT literal, bp, bn, p, n, round(score, 6) AS score FROM scores")
def eval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bp, bn, p, n and score of every first candidate of hot_order, in one job."""
    return scored(spark, sf_dir).select("literal", "bp", "bn", "p", "n", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT literal, round(mcc, 6) AS mcc FROM scores")
def score_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("literal", F.round("mcc", 6).alias("mcc"))


@query(f"WITH {_SCORES} SELECT literal, round(auec, 6) AS auec FROM scores")
def score_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("literal", F.round("auec", 6).alias("auec"))


@query(f"WITH {_SCORES} SELECT literal, round(score, 6) AS score FROM scores WHERE score IS NOT NULL ORDER BY round(score, 6) DESC, literal LIMIT 5")
def topk_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best."""
    return scored(spark, sf_dir).where("score is not null").select("literal", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "literal").limit(5)


@query(f"WITH {_SCORES} SELECT literal, round(score, 6) AS score FROM scores WHERE abs(score - (SELECT median(score) FROM scores)) < 0.00001")
def tied_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that tie, within 1e-5, with the one in the middle."""
    s = stage(scored(spark, sf_dir).select("literal", "score"), "scores")
    middle = F.broadcast(s.agg(F.median("score").alias("middle")))  # one row
    return s.join(middle, F.abs(F.col("score") - F.col("middle")) < 1e-5).select("literal", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_HOT}, c AS (SELECT label, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = v0 AND o_orderpriority = '1-URGENT') AS hit FROM hot),
 m AS (SELECT count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives, count(*) FILTER (label AND hit) AS covered_positives, count(*) FILTER (NOT label AND hit) AS covered_negatives FROM c),
 r AS (SELECT *, covered_positives / (covered_positives + covered_negatives)::DOUBLE AS pr, covered_positives / positives::DOUBLE AS re FROM m)
SELECT positives, negatives, covered_positives, covered_negatives, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM r"""
)
def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = theory.metrics([clause(URGENT)], hot_orders(spark, sf_dir), relations(spark, sf_dir))
    return m.select(*m.columns[:4], *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# sets of examples


@query(f"WITH {_HOT} SELECT v0, v1 FROM hot WHERE label AND v1 NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def uncovered_after_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positives that a rule leaves: hot_order(0, 1) :- of_low_nation(1)."""
    r = dict(relations(spark, sf_dir))
    low = Predicate(9, "of_low_nation", (1,))
    r[low] = b.Relation.of(low, table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey"))
    positives = hot_orders(spark, sf_dir).where("label").select("v0", "v1")
    return b.uncovered_examples(Clause.most_general(HOT_ORDER).add(Literal(low, (1,))), positives, r)


@query(f"WITH {_HOT} SELECT v0, v1, label, (EXISTS (SELECT 1 FROM orders WHERE o_orderkey = v0 AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = v0 AND l_partkey = v1)) AS covered FROM hot")
def theory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theory covers what any of its rules covers."""
    bought = Predicate(10, "bought", (0, 1))
    r = dict(relations(spark, sf_dir))
    r[bought] = b.Relation.of(bought, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    rules = [clause(URGENT), Clause.most_general(HOT_ORDER).add(Literal(bought, (0, 1)))]
    return theory.coverage(rules, hot_orders(spark, sf_dir), r)


@query(f"WITH {_LOCAL} SELECT o_orderkey AS v0, o_orderkey IN (SELECT v0 FROM local_keys) AS label FROM orders")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives, made apart, as one labelled table."""
    r, key = relations(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("v0"))
    found = stage(b.heads(clause(LOCAL), key, r).distinct(), "heads")
    yes, no = b.with_heads(key, found, 1), b.without_heads(key, found, 1)
    return yes.withColumn("label", F.lit(True)).unionByName(no.withColumn("label", F.lit(False)))


# partitioning


@query("SELECT o_custkey % 32 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def radix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.histogram(relations(spark, sf_dir)[NAMED["placed"]].df, "c1")


@query("SELECT o_orderkey AS c0, o_custkey AS c1, o_custkey % 32 AS bucket FROM orders")
def radix_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.radix_partition(relations(spark, sf_dir)[NAMED["placed"]].df, "c1")


# the search


def _learned_sql() -> str:
    """The two literals that a greedy search takes: the best of all rows, then the best of those that it leaves."""
    unary = "(CASE (SELECT literal FROM best) WHEN 'urgent(0)' THEN v0 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') WHEN 'building(1)' THEN v1 IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') END)"
    chosen = lambda k: f"(SELECT literal FROM scores{k} WHERE score IS NOT NULL ORDER BY score DESC, literal LIMIT 1)"
    return f"{_SCORES}, best AS {chosen('')}, left_over AS (SELECT * FROM hot WHERE {unary}), {_scores_sql('left_over', 2)}, next AS {chosen(2)}"


@query(f"WITH {_learned_sql()} SELECT 0 AS rule, 'hot_order(0, 1) :-  ' || (SELECT literal FROM best) || ', ' || (SELECT literal FROM next) AS clause, 2 AS literals")
def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that the learner finds for hot_order."""
    r = relations(spark, sf_dir)
    return Learner(hot_orders(spark, sf_dir), HOT_ORDER, BACKGROUND, r).learn().rules_df(spark)


@query(
    f"""WITH {_HOT}, marked AS (SELECT label, v0 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND v1 IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS covered FROM hot),
 c AS (SELECT count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives, count(*) FILTER (label AND covered) AS covered_positives, count(*) FILTER (NOT label AND covered) AS covered_negatives FROM marked),
 r AS (SELECT *, covered_positives / (covered_positives + covered_negatives)::DOUBLE AS precision, covered_positives / positives::DOUBLE AS recall FROM c)
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r"""
)
def learned_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, precision and recall of the learned rules."""
    r, rows = relations(spark, sf_dir), hot_orders(spark, sf_dir)
    return theory.metrics(Learner(rows, HOT_ORDER, BACKGROUND, r).learn().clauses, rows, r)
