"""Pattern matches with their places, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An empty list of matches: start, end (code points, end exclusive), the match, and the text before and after it.
NONE = "cast(array() as array<struct<s: int, e: int, t: string, before: string, after: string>>)"


def matches(text: str, found: str, gaps: str) -> Column:
    """Places of the matches in column `found`, from the text between them in column `gaps`."""
    step = f"""named_struct(
        'at', acc.at + length(x.g) + length(x.m),
        'out', concat(acc.out, array(named_struct('s', acc.at + length(x.g), 'e', acc.at + length(x.g) + length(x.m), 't', x.m, 'before', x.g, 'after', x.h))))"""
    return F.expr(f"""case when size({found}) = 0 then {NONE} else aggregate(
        zip_with(zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> named_struct('m', m, 'g', g)), slice({gaps}, 2, size({found})),
            (a, h) -> named_struct('m', a.m, 'g', a.g, 'h', h)),
        named_struct('at', 0, 'out', {NONE}), (acc, x) -> {step}, acc -> acc.out) end""")


def found(text: str, pattern: str, hint: Column | None = None) -> Column:
    """All matches of the pattern; hint, where given, says cheaply whether there can be any."""
    every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    return every if hint is None else F.when(hint, every).otherwise(none)


def gaps(text: str, pattern: str, found_col: str) -> Column:
    """The text before, between and after the matches; empty where there is none."""
    return F.when(F.size(found_col) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.expr("cast(array() as array<string>)"))
