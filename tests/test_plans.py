"""Parser, literals, candidates, scores and selection: the driver's part, without Spark."""

import math

import pytest

from cinnabar.functions.scores import area, f1, mcc, score
from cinnabar.operators.evaluate import Counts
from cinnabar.plans.candidates import DuplicateTest, Search, enumerate_candidates, instances, options
from cinnabar.plans.learner import uncovered_target
from cinnabar.plans.model import UNBOUND, Clause, Literal, Predicate
from cinnabar.plans.parser import parse_clause, parse_literal
from cinnabar.plans.selection import Selector, need_regrow

# Predicates, in the order of their enumeration, and four growing clauses.
TYPES = {"p_0": (0,), "p_1": (0, 1), "p_5": (0, 0), "p_2": (1, 0, 2), "p_3": (0, 0, 1), "p_4": (1, 0, 1)}
PREDICATES = {name: Predicate(int(name[-1]), name, types) for name, types in TYPES.items()}
BACKGROUND = list(PREDICATES.values())
CLAUSES = ["p_5(0, 1) :-", "p_5(0, 1) :- p_5(0, 2)", "p_5(0, 1) :- p_5(0, 2), p_5(2, 1)", "p_5(0, 1) :- p_5(0, 2), p_5(2, 1), p_5(0, 3)"]
# The literals that the growing clauses must give, without and with literals that covered nothing, and
# those that a duplicate test takes out of either.
ALL = """p_0(0) p_0(1) p_0(2) p_0(3) p_1(0,-1) p_1(1,-1) p_1(2,-1) p_1(3,-1) p_2(-1,0,-1) p_2(-1,1,-1) p_2(-1,2,-1) p_2(-1,3,-1)
p_3(-1,0,-1) p_3(-1,1,-1) p_3(-1,2,-1) p_3(-1,3,-1) p_3(0,-1,-1) p_3(0,0,-1) p_3(0,1,-1) p_3(0,2,-1) p_3(0,3,-1) p_3(1,-1,-1)
p_3(1,0,-1) p_3(1,1,-1) p_3(1,2,-1) p_3(1,3,-1) p_3(2,-1,-1) p_3(2,0,-1) p_3(2,1,-1) p_3(2,2,-1) p_3(2,3,-1) p_3(3,-1,-1)
p_3(3,0,-1) p_3(3,1,-1) p_3(3,2,-1) p_3(3,3,-1) p_4(-1,0,-1) p_4(-1,1,-1) p_4(-1,2,-1) p_4(-1,3,-1) p_5(-1,0) p_5(-1,1) p_5(-1,2)
p_5(-1,3) p_5(0,-1) p_5(0,0) p_5(0,2) p_5(0,3) p_5(1,-1) p_5(1,0) p_5(1,1) p_5(1,2) p_5(1,3) p_5(2,-1) p_5(2,0) p_5(2,2) p_5(2,3)
p_5(3,-1) p_5(3,0) p_5(3,1) p_5(3,2) p_5(3,3)"""
ALL_DEAD = """p_0(0) p_0(1) p_0(2) p_0(3) p_1(1,-1) p_1(2,-1) p_1(3,-1) p_2(-1,0,-1) p_2(-1,1,-1) p_2(-1,2,-1) p_2(-1,3,-1) p_3(-1,1,-1)
p_3(-1,2,-1) p_3(-1,3,-1) p_3(0,0,-1) p_3(0,1,-1) p_3(1,-1,-1) p_3(1,0,-1) p_3(1,1,-1) p_3(1,2,-1) p_3(1,3,-1) p_3(2,1,-1)
p_3(2,2,-1) p_3(3,-1,-1) p_3(3,1,-1) p_3(3,2,-1) p_3(3,3,-1) p_4(-1,0,-1) p_4(-1,1,-1) p_4(-1,2,-1) p_4(-1,3,-1) p_5(-1,0) p_5(-1,1)
p_5(-1,2) p_5(-1,3) p_5(0,-1) p_5(0,0) p_5(0,2) p_5(0,3) p_5(1,-1) p_5(1,0) p_5(1,1) p_5(1,2) p_5(1,3) p_5(2,0) p_5(2,2) p_5(3,-1)
p_5(3,0) p_5(3,1) p_5(3,2) p_5(3,3)"""
TAKEN = "p_5(-1,1) p_5(-1,2) p_5(-1,3) p_5(0,-1) p_5(0,2) p_5(0,3) p_5(2,-1) p_5(2,3) p_5(3,-1) p_5(3,1) p_5(3,2) p_5(3,3)"


def lit(text):
    return parse_literal(text, PREDICATES)


def lits(text, without=""):
    return sorted(str(lit(x)) for x in text.split() if x not in without.split())


def grow(dead):
    last = None
    for i, text in enumerate(CLAUSES):
        found, left = enumerate_candidates(parse_clause(text, PREDICATES), BACKGROUND, last)
        found.dead = set(dead.get(i, ()))
        last = found
    return sorted(str(x) for v in found.generated.values() for x in v), sorted(str(x) for v in left.values() for x in v)


def test_growing_clauses():
    every, left = grow({})
    assert every == lits(ALL) and len(every) == 62
    assert left == lits(ALL, TAKEN) and len(left) == 50


def test_growing_clauses_with_dead_literals():
    every, left = grow({0: map(lit, ["p_1(0,-1)", "p_3(-1,0,-1)", "p_3(0,-1,-1)"]), 1: map(lit, ["p_3(2,-1,-1)", "p_5(2,-1)"])})
    assert every == lits(ALL_DEAD) and len(every) == 51
    assert left == lits(ALL_DEAD, TAKEN) and len(left) == 41


# Literals that do and that don't repeat a clause's.
@pytest.mark.parametrize(
    ("clause", "yes", "no"),
    [
        ("p_0(0) :- p_1(0, 1)", ["p_1(0,-1)"], ["p_1(-1,1)"]),
        ("p_0(0) :- p_1(0, 1), p_2(1, 0, 2)", ["p_2(1,0,-1)"], ["p_2(1,-1,2)", "p_1(0,-1)"]),
        ("p_5(0, 1) :- p_5(0, 2), p_5(2, 1), p_5(0, 3)", ["p_5(0,-1)", "p_5(3,1)", "p_5(3,-1)"], ["p_5(1,2)"]),
    ],
)
def test_duplicates(clause, yes, no):
    c = parse_clause(clause, PREDICATES)
    for text in yes + no:
        assert DuplicateTest(c, lit(text).predicate)(lit(text)) == (text in yes), text


def test_generator_includes_the_unbound_literal():
    got = instances(PREDICATES["p_5"], options(PREDICATES["p_5"], [(0, 0), (1, 1)]))
    assert [x.terms for x in got] == [(0, 0), (0, UNBOUND), (UNBOUND, 0), (UNBOUND, UNBOUND)]


def test_key_variables_are_barred_from_new_literals():
    keyed = Predicate(0, "k", (0, 0), key=0)
    clause = Clause.most_general(Predicate(1, "h", (0,))).add(Literal(keyed, (0, UNBOUND))).add(Literal(keyed, (1, UNBOUND)))
    found, _ = enumerate_candidates(clause, [keyed], Search())
    assert {x.terms for x in found.generated[keyed]} == {(2, 2), (2, UNBOUND), (UNBOUND, 2)}


@pytest.mark.parametrize("text", ["p_5(0, 1) :-  p_5(0, 2), p_5(2, 1)", "p_0(0) :-  p_1(0, 1), p_2(1, 0, 2)"])
def test_clause_round_trip(text):
    assert str(parse_clause(text, PREDICATES)) == text
    assert str(parse_clause(text.replace(" ", "\n "), PREDICATES)) == text


@pytest.mark.parametrize("text", ["p_9(0)", "p_0()", "p_0(0, 1)", "p_0(a)", "p_0(-2)", "p_0(0"])
def test_bad_literals(text):
    with pytest.raises(ValueError):
        lit(text)


@pytest.mark.parametrize("text", ["p_0(0)", "p_0(1) :- p_1(0, 1)", "p_0(0) :- p_1(0, 2)", "p_0(0) :- p_1(0, -1)", "p_0(0) :- p_1(0, 1) p_0(0)"])
def test_bad_clauses(text):
    with pytest.raises(ValueError):
        parse_clause(text, PREDICATES)


def test_literals_are_values():
    a, b = lit("p_3(0, 2, -1)"), lit("p_3(0, 2, 3)")
    assert b.unbind(3) == a and a != b and len({a, b, b.unbind(3)}) == 2
    assert lit("p_3(0, 1, 2)").join_key == 2 and lit("p_3(0, 1, -1)").join_key == 0


def test_uncovered_target_keeps_the_float():
    assert [uncovered_target(n, 0.8) for n in (100, 88, 901, 8972, 4)] == [19, 17, 180, 1794, 0]


def test_scores():
    # measured on a public 180-row example
    assert score(8713, 8497, 871, 877, 871, 877) == pytest.approx(1.002196, abs=1e-6)
    assert score(180, 193, 180, 193, 871, 877) == pytest.approx(0.982549, abs=1e-6)
    assert score(2847, 2704, 626, 668, 871, 877) == pytest.approx(0.964083, abs=1e-6)
    assert score(0, 0, 0, 0, 871, 877) is None
    assert mcc(0, 5, 10, 10) == -1 and mcc(10, 10, 10, 10) == 0 and math.isnan(mcc(1, 0, 2, 0))
    assert area(0, 3) == 0 and area(3, 0) == 1 and f1(0, 0) == 0


def counts(text, bp, bn, p, n):
    return Counts(lit(text), bp, bn, p, n)


def test_the_heap_drops_all_that_tie_with_the_least():
    s = Selector(parse_clause("p_5(0, 1) :-", PREDICATES), 100, 100, 100, keep=2, consider_random=False)
    for c in (counts("p_0(0)", 50, 40, 50, 40), counts("p_0(1)", 50, 40, 50, 40), counts("p_1(0,-1)", 90, 1, 90, 1)):
        s.insert(c)
    assert [str(x.counts.literal) for x in s.top] == ["p_1(0, -1)"]


def test_ties_come_with_the_best_last_and_the_rest_is_saved():
    s = Selector(parse_clause("p_5(0, 1) :-", PREDICATES), 100, 100, 100, consider_random=False)
    for c in (counts("p_0(0)", 90, 1, 90, 1), counts("p_1(0,-1)", 90, 1, 90, 1), counts("p_0(1)", 50, 40, 50, 40)):
        s.insert(c)
    found, random = s.best(lambda *_: True)
    assert len(found) == 2 and not random
    assert [str(x.counts.literal) for x in s.next_best()] == ["p_0(1)"] and s.next_best() == []


def test_a_bridge_needs_gain_over_the_regular_literal():
    s = Selector(parse_clause("p_5(0, 1) :-", PREDICATES), 100, 100, 100)
    s.insert(counts("p_1(0,-1)", 200, 190, 100, 100))  # no gain, a new variable, all covered
    s.insert(counts("p_0(0)", 20, 5, 20, 5))
    found, random = s.best(lambda *_: True)
    assert random and str(found[0].counts.literal) == "p_1(0, -1)"
    found, random = s.best(lambda *_: False)
    assert not random


def test_regrow():
    c = Clause.most_general(PREDICATES["p_5"]).add(lit("p_1(0,-1)"), random=True)
    assert need_regrow(c, lit("p_0(0)"), 3) and not need_regrow(c, lit("p_0(0)"), 0)
    assert not need_regrow(c, Literal(PREDICATES["p_4"], (2, 0, UNBOUND)), 3)
    assert c.last_unbound() == lit("p_1(0,-1)")
