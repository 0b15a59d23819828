"""Predicates, literals and clauses.

A variable is its id; UNBOUND marks a position that no variable holds yet.  A clause knows the domain type of each
of its variables; only positions of one domain type can be joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

UNBOUND = -1


@dataclass(frozen=True)
class Predicate:
    id: int
    name: str
    types: tuple[int, ...]
    key: int = -1

    @property
    def arity(self) -> int:
        return len(self.types)


@dataclass(frozen=True)
class Literal:
    predicate: Predicate
    terms: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.terms) != self.predicate.arity:
            raise ValueError(f"{self.predicate.name} takes {self.predicate.arity} terms, not {len(self.terms)}")

    @property
    def bound(self) -> tuple[int, ...]:
        """Positions that hold a variable."""
        return tuple(i for i, v in enumerate(self.terms) if v != UNBOUND)

    @property
    def unbound(self) -> tuple[int, ...]:
        return tuple(i for i, v in enumerate(self.terms) if v == UNBOUND)

    @property
    def join_key(self) -> int:
        """The bound position of the largest domain type; the leftmost of several."""
        if not self.bound:
            raise ValueError(f"{self} has no bound position")
        return max(self.bound, key=lambda i: (self.predicate.types[i], -i))

    def unbind(self, first: int) -> Literal:
        """Variables from `first` on become unbound."""
        return Literal(self.predicate, tuple(UNBOUND if v >= first else v for v in self.terms))

    def __str__(self) -> str:
        return f"{self.predicate.name}({', '.join(map(str, self.terms))})"


@dataclass(frozen=True)
class Clause:
    head: Literal
    body: tuple[Literal, ...] = ()
    types: tuple[int, ...] = ()  # of each variable
    random: tuple[bool, ...] = field(default=(), compare=False)  # of each body literal

    @staticmethod
    def most_general(target: Predicate) -> Clause:
        return Clause(Literal(target, tuple(range(target.arity))), (), target.types)

    @property
    def width(self) -> int:
        """The number of variables."""
        return len(self.types)

    @property
    def width_before_last(self) -> int:
        """The number of variables without the last body literal."""
        if not self.body:
            return self.width
        known = {v for lit in (self.head, *self.body[:-1]) for v in lit.terms}
        return max(known) + 1

    def add(self, literal: Literal, random: bool = False) -> Clause:
        """Append a literal; each unbound position gets the next fresh variable."""
        types, terms = list(self.types), []
        for i, v in enumerate(literal.terms):
            if v == UNBOUND:
                terms.append(len(types))
                types.append(literal.predicate.types[i])
            elif v >= self.width or types[v] != literal.predicate.types[i]:
                raise ValueError(f"{literal} does not fit {self}")
            else:
                terms.append(v)
        return Clause(self.head, (*self.body, Literal(literal.predicate, tuple(terms))), tuple(types), (*self.random, random))

    def last_unbound(self) -> Literal:
        """The last body literal as it was before it bound its new variables."""
        return self.body[-1].unbind(self.width_before_last)

    def __str__(self) -> str:
        return f"{self.head} :-  {', '.join(map(str, self.body))}"
