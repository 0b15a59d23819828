"""Candidate literals of a clause, and the test for clauses that are equivalent without them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import product

from cinnabar.plans.model import UNBOUND, Clause, Literal, Predicate

Assignment = dict[int, int]


@dataclass
class Search:
    """What one literal search generated, and which of it covered no positive binding."""

    generated: dict[Predicate, list[Literal]] = field(default_factory=dict)
    dead: set[Literal] = field(default_factory=set)

    def alive(self, predicate: Predicate) -> list[Literal]:
        return [x for x in self.generated.get(predicate, ()) if x not in self.dead]


def options(predicate: Predicate, variables: Iterable[tuple[int, int]], barred: frozenset[int] = frozenset()) -> list[list[int]]:
    """For each position the variables (id, type) of its type, then UNBOUND."""
    known = [v for v in variables if v[0] not in barred]
    return [[v for v, kind in known if kind == t] + [UNBOUND] for t in predicate.types]


def instances(predicate: Predicate, choices: Sequence[Sequence[int]], base: Literal | None = None) -> list[Literal]:
    """All literals that fill the positions by choice; positions bound in base keep their variable."""
    if base is not None:
        choices = [[v] if v != UNBOUND else c for v, c in zip(base.terms, choices, strict=True)]
    return [Literal(predicate, terms) for terms in product(*choices)]


def enumerate_candidates(clause: Clause, background: Sequence[Predicate], last: Search | None) -> tuple[Search, dict[Predicate, list[Literal]]]:
    """(everything generated, the candidates left after pruning), by predicate in background order.

    Without a body, the candidates are all literals over the head's variables, or those of an earlier search for
    the same head that covered something.  With one, they are built from the last literal's new variables alone,
    from earlier candidates with some unbound positions bound to them, and from the earlier candidates themselves.
    """
    if not clause.body:
        if last is not None and last.generated:
            kept = {p: last.alive(p) for p in last.generated}
        else:
            kept = {}
            for p in background:
                every = [x for x in instances(p, options(p, list(enumerate(clause.types)))) if x.bound and x != clause.head]
                if every:
                    kept[p] = every
        return Search(kept), {p: list(x) for p, x in kept.items()}

    before = clause.width_before_last
    new = [(v, clause.types[v]) for v in sorted({v for v in clause.body[-1].terms if v >= before})]
    same: dict[Predicate, list[Literal]] = {}
    for literal in clause.body:
        same.setdefault(literal.predicate, []).append(literal)
    found, left = Search(), {}
    for p in background:
        keys = frozenset(x.terms[p.key] for x in same.get(p, ())) if p.key >= 0 else frozenset()
        choices = options(p, new, keys)
        every = [x for x in instances(p, choices) if x.bound]
        for old in last.alive(p) if last is not None else ():
            every += [x for x in instances(p, choices, old) if x != old]
            if old != clause.body[-1]:
                every.append(old)
        found.generated[p] = every
        test = DuplicateTest(clause, p) if p in same else None
        left[p] = [x for x in every if test is None or not test(x)]
    return found, left


class DuplicateTest:
    """Is a literal replaceable: does the clause with it in place of a body literal of its predicate say the same?

    Both directions are homomorphisms into rows made of the clause's own variables, with the head's variables
    fixed.  A variable that occurs twice in one literal and has no value before it takes the value of its first
    place; its other places are not compared.
    """

    def __init__(self, clause: Clause, predicate: Predicate):
        self.clause = clause
        self.own = [x for x in clause.body if x.predicate == predicate]
        self.rows = [x.terms for x in self.own]
        others: dict[Predicate, list[Literal]] = {}
        for x in clause.body:
            if x.predicate != predicate:
                others.setdefault(x.predicate, []).append(x)
        head = clause.head
        as_row = head.predicate in others
        rest: list[Assignment] = [{} if as_row else {v: v for v in head.terms}]
        for p, literals in others.items():
            rows = [x.terms for x in literals] + [head.terms] * (p == head.predicate)
            for literal in literals:
                rest = extend(rest, literal, rows)
        self.rest = rest

    def __call__(self, literal: Literal) -> bool:
        fresh = tuple(self.clause.width + i if v == UNBOUND else v for i, v in enumerate(literal.terms))
        for k in range(len(self.own)):
            there = self.rest
            for x in self.own[:k] + self.own[k + 1 :]:
                there = extend(there, x, self.rows)
            if not any(fits(a, literal, row) for a in there for row in self.rows):
                continue
            rows = [*self.rows[:k], *self.rows[k + 1 :], fresh]
            back = self.rest
            for x in self.own[:-1]:
                back = extend(back, x, rows)
            if any(fits(a, self.own[-1], row) for a in back for row in rows):
                return True
        return False


def fits(a: Assignment, literal: Literal, row: tuple[int, ...]) -> bool:
    return all(v == UNBOUND or a.get(v, value) == value for v, value in zip(literal.terms, row, strict=True))


def extend(assignments: list[Assignment], literal: Literal, rows: Sequence[tuple[int, ...]]) -> list[Assignment]:
    out = []
    for row in rows:
        for a in assignments:
            if fits(a, literal, row):
                b = dict(a)
                for v, value in zip(literal.terms, row, strict=True):
                    b.setdefault(v, value)
                out.append(b)
    return out
