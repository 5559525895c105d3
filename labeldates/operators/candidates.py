"""Full dates in a text: every notation's matches as candidates, overlaps resolved.

A notation is a pattern, which groups hold year, month and day, and a rule that makes a date of them. The patterns are
fixed values of the grammar; ``d`` stands for a digit, ``SEP`` for a real separator, ``GAP`` for a separator with white
space around it or white space alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Policy
from ..functions import dates
from ..functions.dates import MONTH, as_int, month_number, valid
from ..functions.spans import bind, cut, drop_overlaps, first, spans

KIND = "array<struct<start:int,end:int,y:int,m:int,d:int>>"

NO_DIGIT_BEFORE, NO_DIGIT_AFTER = r"(?<!\d)", r"(?!\d)"
SEP = r"\s*[.\-/,]\s*"
GAP = rf"(?:{SEP}|\s+)"
LOOSE = r"[\s,\-/.]*"
D2, D4, D12 = r"(\d{2})", r"(\d{4})", r"(\d{1,2})"


@dataclass(frozen=True)
class Notation:
    name: str
    pattern: str
    order: str  # which part each group is: y, m, d; w is a month's name, s a separator that matters
    any_case: bool = False


def _bounded(*parts: str) -> str:
    return NO_DIGIT_BEFORE + "".join(parts) + NO_DIGIT_AFTER


YMD = Notation("ymd", _bounded(D4, GAP, "?", D12, SEP, D12), "ymd")
YMD_LOOSE_DAY = Notation("ymd_loose_day", _bounded(D4, SEP, D12, GAP, "?", D12), "ymd")
Y2_MD = Notation("y2_md", _bounded(D2, SEP, D12, SEP, D12), "amc")
Y2_MD_LOOSE_DAY = Notation("y2_md_loose_day", _bounded(D2, SEP, D12, GAP, D12), "amc")
KOREAN = Notation("korean", D4 + r"\s*년\s*" + D12 + r"\s*월\s*" + D12 + r"\s*일", "ymd")
D_MON_Y4 = Notation("d_mon_y4", _bounded(D12, LOOSE, MONTH, LOOSE, D4), "dwy", True)
MON_D_Y4 = Notation("mon_d_y4", _bounded(MONTH, LOOSE, D12, LOOSE, D4), "wdy", True)
Y4_MON_D = Notation("y4_mon_d", _bounded(D4, LOOSE, MONTH, LOOSE, D12), "ywd", True)
D_MON_Y2 = Notation("d_mon_y2", _bounded(D12, LOOSE, MONTH, LOOSE, D2), "dwy", True)
MON_D_Y2 = Notation("mon_d_y2", _bounded(MONTH, LOOSE, D12, f"({LOOSE})", D2), "wdsy", True)
Y2_MON_D = Notation("y2_mon_d", _bounded(D2, LOOSE, MONTH, LOOSE, D12), "ywd", True)
DM_Y4 = Notation("dm_y4", _bounded(D12, GAP, D12, GAP, D4), "dmy")
DDMMYY = Notation("ddmmyy", _bounded(D2, D2, D2), "dmy")
DDMMYYYY = Notation("ddmmyyyy", _bounded(D2, D2, D4), "dmy")
Y4_M_D_SPACED = Notation("y4_m_d_spaced", _bounded(D4, r"\s+", D12, r"\s+", D12), "ymd")
MONTH_DAY = NO_DIGIT_BEFORE + r"(0?[1-9]|1[0-2])[./](0?[1-9]|[12]\d|3[01])(?!\d)(?!\s*(?:g|kg|mg|%|kcal|℃|도|°|[Cc]\)?))"

# Keywords. Fixed values.
CONSUME = ("소비기한",)
DISTRIBUTION = ("유통기한",)
EXPIRY_EN = ("EXP",)
MADE = ("제조일자", "제조년월일", "제조일", "제조", "PROD", "PRD", "MFG", "MFD", "PR0D", "PR0", "PRO:", "PRO.", "PRO ")
KEYWORDS = (*CONSUME, *DISTRIBUTION, *MADE, *EXPIRY_EN)
ENGLISH_DUE = r"(?:BEST\s*[.\-]?\s*(?:BEFORE|BY|IF\s*USED\s*BY)|BBE(?![A-Z])|SELL?\s*[.\-]?\s*BY|USE\s*[.\-]?\s*BY|CONSUME\s*[.\-]?\s*BY)"


def _part(s: Column, n: Notation, part: str) -> Column:
    return s[f"g{n.order.index(part) + 1}"]


def _numbers(s: Column, n: Notation, two_digits: bool) -> tuple[Column, Column, Column]:
    y = as_int(_part(s, n, "y"))
    m = month_number(_part(s, n, "w")) if "w" in n.order else as_int(_part(s, n, "m"))
    return dates.two_digit_year(y) if two_digits else y, m, as_int(_part(s, n, "d"))


def _kept(found: Column) -> Column:
    """Placed dates without those that are null."""
    placed = F.transform(found, lambda x: F.when(x["date"].isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["date"]["y"].alias("y"), x["date"]["m"].alias("m"), x["date"]["d"].alias("d"))))
    return F.filter(placed, lambda x: x.isNotNull())


def _by(text: Column, n: Notation, make) -> Column:
    found = spans(text, n.pattern, len(n.order), n.any_case)
    return _kept(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), make(s).alias("date"))))


def plain(text: Column, n: Notation, policy: Policy = DEFAULT, two_digits: bool = False) -> Column:
    """Candidates of a notation whose groups say which part is which."""

    def make(s: Column) -> Column:
        fine = F.lit(True)
        if n is MON_D_Y2:  # "Nov 2021" is a month and a year
            joined = as_int(F.concat(_part(s, n, "d"), _part(s, n, "y")))
            fine = ~((F.length(_part(s, n, "s")) == 0) & joined.between(policy.year_min, policy.year_max))
        return bind(dates.date_struct(*_numbers(s, n, two_digits)), lambda x: F.when(valid(x["y"], x["m"], x["d"], policy) & fine, x))

    return _by(text, n, make)


def ambiguous(text: Column, n: Notation, hint: Column, policy: Policy = DEFAULT) -> Column:
    """Candidates with a two-digit number at either end."""
    return _by(text, n, lambda s: dates.resolve_two_digit(as_int(_part(s, n, "a")), as_int(_part(s, n, "m")), as_int(_part(s, n, "c")), hint, policy))


def year_month_name_day(text: Column, hint: Column, policy: Policy = DEFAULT) -> Column:
    """``yy MON dd``, which also reads as ``dd MON yy``: dropped where that is a date, unless the label says year first
    or the year is the likelier one by the flip ratio."""

    def make(s: Column) -> Column:
        y, m, d = _numbers(s, Y2_MON_D, True)
        other = valid(d + 2000, m, y - 2000, policy) & ~hint.eqNullSafe(F.lit("ymd")) & ~dates.day_first_is_likelier(d + 2000, y, policy)
        return F.when(valid(y, m, d, policy) & ~other, dates.date_struct(y, m, d))

    return _by(text, Y2_MON_D, make)


def keyword_places(text: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    """Start and end of every occurrence of every word, case as it is: ``array<struct<start,end>>``.

    One search finds the places where any word begins (its first character, the rest looked ahead at); the words are then
    told apart there.
    """
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append("".join("\\" + c if not c.isalnum() and c != " " else c for c in w[1:]))
    places = spans(text, "(?:" + "|".join(f"{c}(?:{'|'.join(f'(?={r})' for r in rs)})" for c, rs in rest.items()) + ")")
    told = F.transform(places, lambda p: F.transform(F.filter(F.array(*map(F.lit, words)), lambda w: F.substring(text, p["start"] + 1, F.length(w)) == w), lambda w: F.struct(p["start"].alias("start"), (p["start"] + F.length(w)).alias("end"))))
    return F.flatten(told)


def windows(text: Column, places: Column, width: int) -> Column:
    """Distinct stretches of the text ``width`` characters around the places."""
    return F.array_distinct(F.transform(places, lambda p: F.struct(F.greatest(p["start"] - width, F.lit(0)).alias("start"), F.least(p["end"] + width, F.length(text)).alias("end"))))


def near_keywords(text: Column, policy: Policy = DEFAULT) -> Column:
    """Dates without separators, looked for only close to a keyword. The pattern sees the stretch alone, not what stands
    beyond its ends."""
    places = F.concat(keyword_places(text), F.transform(spans(text, ENGLISH_DUE, 0, True), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def within(w: Column) -> Column:
        part = cut(text, w["start"], w["end"])
        found = F.concat(plain(part, DDMMYY, policy, True), plain(part, DDMMYYYY, policy), plain(part, Y4_M_D_SPACED, policy))
        return F.transform(found, lambda c: F.struct((c["start"] + w["start"]).alias("start"), (c["end"] + w["start"]).alias("end"), c["y"].alias("y"), c["m"].alias("m"), c["d"].alias("d")))

    looks = text.rlike(r"(?U)\d{6}|\d{4}\s+\d{1,2}\s+\d")
    return F.when(looks, F.flatten(F.transform(windows(text, places, policy.compact_window), within))).otherwise(F.array().cast(KIND))


def full_dates(text: Column, policy: Policy = DEFAULT) -> Column:
    """All candidates, in text order, without overlaps."""
    hint = dates.order_hint(text)
    none = F.array().cast(KIND)
    numeric = F.concat(*[plain(text, n, policy) for n in (YMD, YMD_LOOSE_DAY, DM_Y4)], *[ambiguous(text, n, hint, policy) for n in (Y2_MD, Y2_MD_LOOSE_DAY)], near_keywords(text, policy))
    named = F.concat(*[plain(text, n, policy) for n in (D_MON_Y4, MON_D_Y4, Y4_MON_D)], *[plain(text, n, policy, True) for n in (D_MON_Y2, MON_D_Y2)], year_month_name_day(text, hint, policy))
    # A search for what a group of notations cannot do without spares the others their own.
    every = F.concat(numeric, F.when(F.instr(text, "년") > 0, plain(text, KOREAN, policy)).otherwise(none), F.when(text.rlike("(?i)" + MONTH), named).otherwise(none))
    return F.when(text.rlike(r"(?U)\d"), drop_overlaps(every, KIND)).otherwise(none)


def month_and_day(text: Column, policy: Policy = DEFAULT) -> Column:
    """The first month and day without a year close to an expiry keyword, by keyword, then place; null if there is none."""
    ordered = F.concat(*[keyword_places(text, (w,)) for w in (*CONSUME, *DISTRIBUTION, *EXPIRY_EN)])
    pattern = "(?U)" + MONTH_DAY

    def within(p: Column) -> Column:
        part = cut(text, p["start"] - policy.month_day_window, p["end"] + policy.month_day_window)
        return F.when(part.rlike(pattern), F.struct(as_int(F.regexp_extract(part, pattern, 1)).alias("m"), as_int(F.regexp_extract(part, pattern, 2)).alias("d")))

    found = first(F.filter(F.transform(ordered, within), lambda x: x.isNotNull()))
    # A stretch can end inside a number, so the pattern itself may fail on the whole text.
    return F.when(text.rlike(r"(?U)\d[./]\d"), found)
