"""Binding tables and the joins that extend, test and count them.

A relation has columns c0, c1, ...; a binding table has v0, v1, ... and, for examples, a boolean label.  Rows are
bags: a duplicate fact multiplies bindings, but a binding with several matches is covered once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.plans.model import Clause, Literal, Predicate

LABEL = "label"


@dataclass(frozen=True)
class Relation:
    predicate: Predicate
    df: DataFrame

    @staticmethod
    def of(predicate: Predicate, df: DataFrame, columns: Sequence[str] | None = None) -> Relation:
        """The relation of a DataFrame's columns, in order, as c0, c1, ...: whole numbers as bigint, strings and doubles
        as they are, all else is refused.  Rows with a null are no facts and are left out, since nulls join with nothing."""
        names = list(columns or df.columns)
        if len(names) != predicate.arity:
            raise ValueError(f"{predicate.name} has {predicate.arity} columns, not {len(names)}")
        return Relation(predicate, df.select(*(_value(df, c).alias(f"c{i}") for i, c in enumerate(names))).dropna())


def _value(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    if kind in ("string", "double"):
        return F.col(f"`{name}`")
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{name} is {kind}; facts hold whole numbers, strings and doubles")
    return F.col(f"`{name}`").cast("bigint")


Relations = Mapping[Predicate, Relation]


def examples(df: DataFrame, arity: int) -> DataFrame:
    """Labelled examples as the binding table of the most general clause; df has the head's columns, then label."""
    cols = df.columns
    cast = (_value(df, c).alias(f"v{i}") for i, c in enumerate(cols[:arity]))
    return df.select(*cast, F.col(f"`{cols[arity]}`").cast("boolean").alias(LABEL)).dropna()


def variables(bindings: DataFrame) -> list[str]:
    return [c for c in bindings.columns if c != LABEL]


def matching(literal: Literal, facts: DataFrame) -> DataFrame:
    """The facts in which positions that hold the same variable are equal; columns of their own, so that a relation
    can be joined several times."""
    facts = facts.select(*(F.col(c).alias(c) for c in facts.columns))
    first: dict[int, int] = {}
    for i in literal.bound:
        at = first.setdefault(literal.terms[i], i)
        if at != i:
            facts = facts.where(F.col(f"c{at}") == F.col(f"c{i}"))
    return facts


def keys(literal: Literal) -> dict[int, int]:
    """Bound variable -> its first position."""
    out: dict[int, int] = {}
    for i in literal.bound:
        out.setdefault(literal.terms[i], i)
    return out


def condition(bindings: DataFrame, facts: DataFrame, literal: Literal) -> Column:
    on = None
    for v, i in keys(literal).items():
        equal = bindings[f"v{v}"] == facts[f"c{i}"]
        on = equal if on is None else on & equal
    if on is None:
        raise ValueError(f"{literal} has no bound position, which would be a cross join")
    return on


def extend(bindings: DataFrame, literal: Literal, relations: Relations) -> DataFrame:
    """Join a literal: a row for each matching fact, and a new variable for each unbound position.

    Works for labelled and unlabelled bindings alike; Spark chooses the side to build."""
    width = len(variables(bindings))
    facts = matching(literal, relations[literal.predicate].df)
    joined = bindings.join(facts, condition(bindings, facts, literal))
    new = [facts[f"c{i}"].alias(f"v{width + k}") for k, i in enumerate(literal.unbound)]
    kept = [bindings[c] for c in variables(bindings)]
    return joined.select(*kept, *new, *([bindings[LABEL]] if LABEL in bindings.columns else []))


def covered(bindings: DataFrame, literal: Literal, relations: Relations) -> DataFrame:
    """The binding rows with at least one matching fact."""
    facts = matching(literal, relations[literal.predicate].df)
    return bindings.join(facts, condition(bindings, facts, literal), "left_semi")


def not_covered(bindings: DataFrame, literal: Literal, relations: Relations) -> DataFrame:
    facts = matching(literal, relations[literal.predicate].df)
    return bindings.join(facts, condition(bindings, facts, literal), "left_anti")


def body(clause: Clause, start: DataFrame, relations: Relations) -> DataFrame:
    """Bindings of all body literals but the last, from examples."""
    out = start
    for literal in clause.body[:-1]:
        # the clause's literals name their new variables; unbound, they extend
        out = extend(out, literal.unbind(len(variables(out))), relations)
    return out


def heads(clause: Clause, start: DataFrame, relations: Relations) -> DataFrame:
    """The heads that the clause covers among the examples: the last literal needs no more than a semi-join."""
    if not clause.body:
        raise ValueError("a clause without a body covers everything")
    before = body(clause, start, relations)
    got = covered(before, clause.body[-1].unbind(len(variables(before))), relations)
    return got.select(*(f"v{i}" for i in range(clause.head.predicate.arity)))


def _same(left: DataFrame, right: DataFrame, arity: int) -> Column:
    on = F.lit(True)
    for i in range(arity):
        on = on & (left[f"v{i}"] == right[f"h{i}"])
    return on


def _heads_as(right: DataFrame, arity: int) -> DataFrame:
    return right.select(*(F.col(f"v{i}").alias(f"h{i}") for i in range(arity)))


def with_heads(rows: DataFrame, found: DataFrame, arity: int) -> DataFrame:
    """Examples whose head is among those found."""
    h = _heads_as(found, arity)
    return rows.join(h, _same(rows, h, arity), "left_semi")


def without_heads(rows: DataFrame, found: DataFrame, arity: int) -> DataFrame:
    """Examples whose head is not among those found; a bag, duplicates stay."""
    h = _heads_as(found, arity)
    return rows.join(h, _same(rows, h, arity), "left_anti")


def covered_examples(clause: Clause, rows: DataFrame, relations: Relations) -> DataFrame:
    return with_heads(rows, heads(clause, rows, relations), clause.head.predicate.arity)


def uncovered_examples(clause: Clause, rows: DataFrame, relations: Relations) -> DataFrame:
    return without_heads(rows, heads(clause, rows, relations), clause.head.predicate.arity)
