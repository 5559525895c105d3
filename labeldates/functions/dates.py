"""Validity of partial dates, two-digit years, month names, and which end of a date is the year."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Policy
from .spans import bind

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
MONTH = "(" + "|".join(MONTHS) + ")"


# Decimal digits of other scripts, which the patterns match too, and their ASCII forms: a table made by rule.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def as_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.translate(text, OTHER_DIGITS, ASCII_DIGITS).try_cast("int"))


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.get(F.array(*map(F.lit, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), m - 1) + F.when(leap & (m == 2), 1).otherwise(0)


def valid(y: Column, m: Column, d: Column, policy: Policy = DEFAULT) -> Column:
    """A day of the calendar in a plausible year; integer arithmetic, so nothing throws."""
    return F.coalesce(y.between(policy.year_min, policy.year_max) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m)), F.lit(False))


def two_digit_year(yy: Column) -> Column:
    return yy + 2000


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name's first three letters, null for anything else."""
    at = F.instr(F.lit(" ".join(MONTHS)), F.upper(name))
    return F.when((F.length(name) == 3) & (at > 0) & (at % 4 == 1), ((at + 3) / 4).cast("int"))


def year_prior(y: Column, policy: Policy = DEFAULT) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in policy.year_prior for x in (k, v)])
    return F.coalesce(F.try_element_at(table, y), F.lit(policy.prior_floor))


def day_first_is_likelier(y_if_first: Column, y_if_last: Column, policy: Policy = DEFAULT) -> Column:
    return year_prior(y_if_last, policy) >= policy.flip_ratio * year_prior(y_if_first, policy)


# The order of a date's parts, where the label says it.
YEAR_FIRST = r"[연년][.\-\s]?월[.\-\s]?일"
DAY_FIRST = r"일[.\-\s]?월[.\-\s]?[연년]"
YEAR_FIRST_EN = r"(?:YY|YYYY)\s*[./\-]?\s*MM\s*[./\-]?\s*DD"
DAY_FIRST_EN = r"DD\s*[./\-]?\s*MM\s*[./\-]?\s*(?:YY|AA|JJ)"


def order_hint(text: Column) -> Column:
    """``ymd`` or ``dmy`` if the text states just one of them, else null."""
    ymd = text.rlike("(?U)" + YEAR_FIRST) | text.rlike("(?iU)" + YEAR_FIRST_EN)
    dmy = text.rlike("(?U)" + DAY_FIRST) | text.rlike("(?iU)" + DAY_FIRST_EN)
    return F.when(ymd & ~dmy, F.lit("ymd")).when(dmy & ~ymd, F.lit("dmy"))


def date_struct(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def resolve_two_digit(a: Column, m: Column, c: Column, hint: Column, policy: Policy = DEFAULT) -> Column:
    """``a m c`` with two-digit ends as year-month-day or day-month-year; null if neither is a date.

    Where both are: what the label says, else the order of the likelier year by the flip ratio, else year first.
    """
    first, last = two_digit_year(a), two_digit_year(c)
    flip = (hint.eqNullSafe(F.lit("dmy"))) | (hint.isNull() & day_first_is_likelier(first, last, policy))
    as_ymd, as_dmy = date_struct(first, m, c), date_struct(last, m, a)
    both = F.struct(valid(first, m, c, policy).alias("ymd"), valid(last, m, a, policy).alias("dmy"))
    return bind(both, lambda ok: F.when(ok["ymd"] & ok["dmy"], F.when(flip, as_dmy).otherwise(as_ymd)).when(ok["ymd"], as_ymd).when(ok["dmy"], as_dmy))


def text_of(y: Column, m: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day and all three as the four output strings, ``NONE`` for what is not there."""
    pad = lambda x, n: F.when(x.isNull(), F.lit("NONE")).otherwise(F.lpad(x.cast("string"), n, "0"))
    ys, ms, ds = pad(y, 4), pad(m, 2), pad(d, 2)
    return ys, ms, ds, F.when(y.isNull() & m.isNull() & d.isNull(), F.lit("NONE")).otherwise(F.concat_ws("-", ys, ms, ds))
