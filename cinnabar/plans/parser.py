"""Text of literals and clauses: ``p(0, -1)`` and ``h(0, 1) :- p(0, 2), q(2, 1)``.  White space means nothing."""

from __future__ import annotations

import re
from collections.abc import Mapping

from cinnabar.plans.model import UNBOUND, Clause, Literal, Predicate

_LITERAL = re.compile(r"(\w+)\((-?\d+(?:,-?\d+)*)\)")


def parse_literal(text: str, predicates: Mapping[str, Predicate]) -> Literal:
    m = _LITERAL.fullmatch(re.sub(r"\s", "", text))
    if not m:
        raise ValueError(f"not a literal: {text!r}")
    if m[1] not in predicates:
        raise ValueError(f"unknown predicate {m[1]!r}")
    terms = tuple(map(int, m[2].split(",")))
    if min(terms) < UNBOUND:
        raise ValueError(f"not a variable in {text!r}")
    return Literal(predicates[m[1]], terms)


def parse_clause(text: str, predicates: Mapping[str, Predicate]) -> Clause:
    """A clause; body variables must be known or the next fresh one, as the learner would number them."""
    head, sep, body = re.sub(r"\s", "", text).partition(":-")
    if not sep:
        raise ValueError(f"no ':-' in {text!r}")
    first = parse_literal(head, predicates)
    if first.terms != tuple(range(first.predicate.arity)):
        raise ValueError(f"head variables must be 0, 1, ... in {text!r}")
    clause = Clause.most_general(first.predicate)
    parts = _LITERAL.findall(body)
    if ",".join(f"{n}({t})" for n, t in parts) != body:
        raise ValueError(f"not a list of literals: {body!r}")
    for name, terms in parts:
        literal = parse_literal(f"{name}({terms})", predicates)
        if literal.unbound:
            raise ValueError(f"{literal} has unbound positions")
        added = clause.add(literal.unbind(clause.width))
        if added.body[-1] != literal:
            raise ValueError(f"{literal} skips a variable number")
        clause = added
    return clause
