"""Binding tables, counting, partitioning and theories against plain Python."""

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from cinnabar.functions.scores import area, area_column, f1, f1_column, mcc, mcc_column, score, score_column
from cinnabar.operators import bindings as b
from cinnabar.operators import partitioning
from cinnabar.operators.evaluate import FactCounts, by_variables, collect_counts, evaluate_by_rows, label_counts
from cinnabar.plans import theory
from cinnabar.plans.model import UNBOUND, Clause, Literal, Predicate

E, Q, H = Predicate(0, "edge", (0, 0)), Predicate(1, "mark", (0,)), Predicate(2, "head", (0,))


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(60)]  # with duplicates and loops
    marks = [(i,) for i in range(0, 12, 3)] + [(0,)]
    heads = [(i, i % 2 == 0) for i in range(15)] + [(1, False)]
    return {
        "edges": edges,
        "marks": marks,
        "heads": heads,
        "relations": {E: b.Relation.of(E, spark.createDataFrame(edges, "a int, b int")), Q: b.Relation.of(Q, spark.createDataFrame(marks, "a long"))},
        "examples": b.examples(spark.createDataFrame(heads, "x int, label boolean"), 1),
    }


def test_extend_is_a_bag_join(world):
    got = rows(b.extend(world["examples"], Literal(E, (0, UNBOUND)), world["relations"]))
    assert got == Counter((x, y, lab) for (x, lab), (a, y) in product(world["heads"], world["edges"]) if a == x)


def test_extend_with_a_repeated_variable_and_without_labels(world):
    got = rows(b.extend(world["examples"].drop("label"), Literal(E, (0, 0)), world["relations"]))
    assert got == Counter((x,) for (x, _), (a, c) in product(world["heads"], world["edges"]) if a == c == x)


def test_extend_needs_a_bound_position(world):
    with pytest.raises(ValueError):
        b.extend(world["examples"], Literal(E, (UNBOUND, UNBOUND)), world["relations"])


def test_semi_and_anti_join_split_the_rows(world):
    x = Literal(E, (UNBOUND, 0))
    yes, no = rows(b.covered(world["examples"], x, world["relations"])), rows(b.not_covered(world["examples"], x, world["relations"]))
    into = {c for _, c in world["edges"]}
    assert yes == Counter(h for h in world["heads"] if h[0] in into)
    assert yes + no == Counter(world["heads"])


def literals():
    return [Literal(E, t) for t in product((UNBOUND, 0, 1), repeat=2) if t != (UNBOUND, UNBOUND)] + [Literal(Q, (0,)), Literal(Q, (1,))]


def test_factorised_counts_equal_the_exploded_join(world):
    two = b.extend(world["examples"], Literal(E, (0, UNBOUND)), world["relations"])
    for c in collect_counts(two, literals(), world["relations"], at_once=4):
        one = evaluate_by_rows(two, c.literal, world["relations"]).first()
        assert (c.bp, c.bn, c.p, c.n) == tuple(one), c.literal


def test_kept_fact_counts_give_the_same_and_are_made_once(world):
    two = b.extend(world["examples"], Literal(E, (0, UNBOUND)), world["relations"])
    facts = FactCounts(world["relations"])
    want = collect_counts(two, literals(), world["relations"])
    assert collect_counts(two, literals(), world["relations"], facts) == want
    made = dict(facts.made)
    assert len(made) == 5  # edge by either column, by both, by both equal; mark
    assert collect_counts(two, literals(), world["relations"], facts) == want and facts.made == made


def test_counts_without_any_match_are_zero(spark, world):
    far = b.examples(spark.createDataFrame([(100, True), (101, False)], "x int, label boolean"), 1)
    (c,) = collect_counts(far, [Literal(Q, (0,))], world["relations"])
    assert (c.bp, c.bn, c.p, c.n, c.precision) == (0, 0, 0, 0, 0.0)
    assert label_counts(far) == (1, 1)


def test_nulls_are_dropped_and_arity_is_checked(spark):
    df = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert b.Relation.of(E, df).df.count() == 1
    with pytest.raises(ValueError):
        b.Relation.of(Q, df)


def clause(*body):
    c = Clause.most_general(H)
    for x in body:
        c = c.add(x)
    return c


def test_coverage_of_a_theory_is_that_of_any_rule(world):
    through = clause(Literal(E, (0, UNBOUND)), Literal(Q, (1,)))
    loop = clause(Literal(E, (0, 0)))
    marks, edges = {m for (m,) in world["marks"]}, world["edges"]
    first = {a for a, c in edges if c in marks}
    either = first | {a for a, c in edges if a == c}
    r = world["relations"]
    assert rows(b.covered_examples(through, world["examples"], r)) == Counter(h for h in world["heads"] if h[0] in first)
    assert rows(b.uncovered_examples(through, world["examples"], r)) == Counter(h for h in world["heads"] if h[0] not in first)
    assert rows(theory.uncovered([through, loop], world["examples"], r)) == Counter(h for h in world["heads"] if h[0] not in either)
    assert rows(theory.coverage([through, loop], world["examples"], r)) == Counter((x, lab, x in either) for x, lab in world["heads"])
    m = theory.metrics([through, loop], world["examples"], r).first()
    assert m["covered_positives"] == sum(lab and x in either for x, lab in world["heads"])
    none = theory.metrics([], world["examples"], r).first()
    assert (none["covered_positives"], none["precision"], none["recall"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize("bits", [1, 3, 7, 12])
@pytest.mark.parametrize("values", [list(range(100)), [0] * 40, [0, 1] * 20, [-5, 7, 4095, 4096]])
def test_radix_buckets(spark, bits, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r["bucket"]: r["n"] for r in partitioning.histogram(df, "v", bits).collect()}
    assert got == Counter(v % 2**bits for v in values)


def test_radix_partition_keeps_a_bucket_together(spark):
    df = partitioning.radix_partition(spark.range(200).withColumnRenamed("id", "v"), "v", 3)
    assert df.select("bucket", F.spark_partition_id().alias("p")).distinct().groupBy("bucket").count().where("count > 1").isEmpty()


def test_numbered_is_a_global_row_number(spark):
    values = random.Random(1).sample(range(10_000), 500)
    got = partitioning.numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v").orderBy("row").collect()
    assert [(r["v"], r["row"]) for r in got] == list(zip(sorted(values), range(500), strict=True))


def test_score_columns_equal_the_numbers(spark):
    cases = [(bp, bn, p, n, 20, 30) for bp, bn, p, n in [(0, 0, 0, 0), (5, 0, 5, 0), (20, 30, 20, 30), (40, 10, 12, 6), (3, 9, 1, 30), (7, 7, 7, 7)]] + [(5, 0, 3, 0, 5, 0)]
    df = spark.createDataFrame(cases, "bp long, bn long, p long, n long, tp long, tn long")
    c = {k: F.col(v) for k, v in {"bp": "bp", "bn": "bn", "p": "p", "n": "n", "P": "tp", "N": "tn"}.items()}
    got = df.select(mcc_column(c["p"], c["n"], c["P"], c["N"]), area_column(c["bp"], c["bn"]), score_column(**c), f1_column(c["p"] / 20, c["n"] / 30)).collect()
    for row, (bp, bn, p, n, P, N) in zip(got, cases, strict=True):
        m = mcc(p, n, P, N)
        assert row[0] is None if m != m else row[0] == pytest.approx(m)
        assert row[1] == pytest.approx(area(bp, bn))
        want = score(bp, bn, p, n, P, N)
        assert row[2] is None if want is None else row[2] == pytest.approx(want)
        assert row[3] == pytest.approx(f1(p / 20, n / 30))


def test_a_hot_key_is_one_row_on_either_side(spark):
    df = b.examples(spark.createDataFrame([(7, True)] * 500 + [(8, False)], "x int, label boolean"), 1)
    assert by_variables(df, [0]).count() == 2
