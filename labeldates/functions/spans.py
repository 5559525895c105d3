"""Regular-expression matches with their positions, as columns.

Spark has no function that gives positions in code points. ``split`` gives the text between matches and
``regexp_extract_all`` the matches and groups, so a match starts at the sum of the lengths before it. Every pattern here
is non-empty and gets the ``(?U)`` flag, without which Java's ``\\s`` and ``\\d`` know ASCII only.

A row whose text does not match pays for one search: the walk stands behind ``rlike``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flagged(pattern: str, any_case: bool = False) -> str:
    return ("(?iU)" if any_case else "(?U)") + pattern


def span_type(groups: int) -> str:
    return "array<struct<start:int,end:int" + "".join(f",g{k}:string" for k in range(1, groups + 1)) + ">>"


def spans(text: Column, pattern: str, groups: int = 0, any_case: bool = False) -> Column:
    """All matches from left to right: ``start``, ``end`` (code points, from 0, end exclusive) and the groups."""
    p = flagged(pattern, any_case)
    parts = [F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hit")]
    parts += [F.regexp_extract_all(text, F.lit(p), F.lit(k)).alias(f"g{k}") for k in range(1, groups + 1)]
    none = F.array().cast(span_type(groups))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), *[m[f"g{k}"].alias(f"g{k}") for k in range(1, groups + 1)]))).alias("out"))

    walked = F.aggregate(F.filter(F.arrays_zip(*parts), lambda m: m["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(p), walked).otherwise(none)


def cut(text: Column, start: Column | int, end: Column | int) -> Column:
    """``text[start:end]`` with ``start`` not below 0."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def around(text: Column, span: Column, width: int) -> Column:
    """A match with ``width`` characters on each side."""
    return cut(text, span["start"] - width, span["end"] + width)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a word occurs, in any case."""
    up = F.upper(text)
    found = F.lit(False)
    for w in words:
        found = found | (F.instr(up, w.upper()) > 0)
    return found


def has_exact(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | (F.instr(text, w) > 0)
    return found


def drop_overlaps(candidates: Column, kind: str) -> Column:
    """Sort structs whose first fields are ``start`` and ``end``, and keep each that starts where the last kept one ended
    or later. At an equal start the shorter comes first and wins."""
    none = F.array().cast(kind)
    return F.aggregate(
        F.array_sort(candidates), F.struct(F.lit(-1).alias("last"), none.alias("out")),
        lambda acc, c: F.when(c["start"] >= acc["last"], F.struct(c["end"].alias("last"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: lambda bodies have no common-subexpression elimination."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first(array: Column) -> Column:
    """The first element, null if there is none."""
    return F.get(array, F.lit(0))


def first_of(texts: Column, kind: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of the first text for which it is not null; later ones are not tried."""
    return F.aggregate(texts, F.lit(None).cast(kind), lambda acc, t: F.coalesce(acc, f(t)))
