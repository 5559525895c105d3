"""The layered reader: the base answer on the normalized text, and further readings only where it has none."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Policy
from ..functions import dates, textnorm
from ..functions.dates import MONTH, as_int, month_number, valid
from ..functions.spans import around, bind, cut, first, first_of, flagged, has_any, has_exact, spans
from . import candidates as cand
from . import choose

DATE = "struct<y:int,m:int,d:int>"

# Words. Fixed values.
DUE = ("소비기한", "유통기한", "까지", "유효기간", "품질유지기한", "EXP", "BEST", "USE BY")
OTHER_NUMBERS = ("전화", "고객", "상담", "번호", "로트", "LOT", "바코드", "품목", "제조번호")
OTHER_DECIMALS = (
    "로 ", "길 ", "번지", "호실", "고객", "상담", "문의", "전화", "번호", "품목보고", "영양", "열량", "나트륨", "탄수화물", "단백질", "지방", "당류", "내용량", "중량", "보관", "온도", "실온", "냉장", "냉동",
)
# Patterns. Fixed values of the grammar.
EDGE, EDGE_END = r"(?<![\d.\-/:])", r"(?![\d.\-/:])"
MARKER = r"EXP|BEST\s*BEFORE(?:\s*END)?|BBE|USE\s*BY|소비기한|유통기한"
END_MARK = r"BEFORE\s*END|\bFIN\b|FIN\s*DE|말일"
MONTH_YEAR = r"(?<![\d.\-/])(\d{1,2})(?:\s*[.\-/]\s*|\s+)(\d{4})" + EDGE_END
MONTH_YEAR_2 = EDGE + r"(\d{2})\s*[.\-/]\s*(\d{2})" + EDGE_END
GLUED_D_MON_Y = r"(?<![A-Za-z0-9])(\d{1,2})" + MONTH + r"(\d{2})(?![A-Za-z0-9])"
EIGHT, SIX = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)"
SPACED_Y4 = EDGE + r"(\d{4})\s+(\d{1,2})\s+(\d{1,2})" + EDGE_END
SPACED_D_MY4 = EDGE + r"(\d{1,2})\s+(\d{2})(\d{4})" + EDGE_END
SPACED_2 = EDGE + r"(?<![\d.\-/:]\s)(\d{2})\s+(\d{2})\s+(\d{2})(?![\d.\-/:%])"
MON_Y4 = r"(?<![A-Za-z])" + MONTH + r"(?:\s*[.,/\-]\s*|\s+)(\d{4})(?!\d)"
Y4_M = r"(?<!\d)(\d{4})[.\-/:](\d{1,2})(?!\d)(?!\s*[.\-/:]\s*\d)"
M_Y4 = r"(?<!\d)(\d{1,2})[.\-/](\d{4})(?!\d)"
LONE_MONTH_DAY = r"(?<![\d.])(0?[1-9]|1[0-2])[./](0?[1-9]|[12]\d|3[01])(?![\d.])(?!\s*(?:g|kg|mg|ml|L|%|kcal|℃|도|°|[Cc]\)|원|명|인분))"


def _dated(found: Column, make) -> Column:
    """The first match that ``make`` turns into a date."""
    return first(F.filter(F.transform(found, make), lambda x: x.isNotNull()))


def _month_year(y: Column, m: Column, policy: Policy, ok: Column) -> Column:
    return F.when(y.between(policy.year_min, policy.year_max) & m.between(1, 12) & ok, dates.date_struct(y, m, F.lit(None)))


def _in_context(text: Column, s: Column, crop: Column, policy: Policy) -> Column:
    context = around(text, s, policy.context)
    return ~has_any(context, OTHER_NUMBERS) & (crop | has_any(context, DUE))


def month_year_at_marker(text: Column, policy: Policy = DEFAULT) -> Column:
    """Month and year right after a due marker, no longer number in between; or, after a mark that means the end of a
    month, ``MM-YY``."""
    marker = flagged(MARKER, True)

    def at_marker(s: Column) -> Column:
        before = cut(text, s["start"] - policy.context, s["start"])
        close = before.rlike(marker) & ~F.element_at(F.split(before, marker, -1), -1).rlike(r"(?U)\d{3}")
        return _month_year(as_int(s["g2"]), as_int(s["g1"]), policy, close)

    mark = flagged(END_MARK, True)
    gap = F.get(F.split(text, mark, 2), F.lit(0))
    end = F.length(gap) + F.length(F.regexp_extract(text, mark, 0))
    rest = F.substring(text, end + 1, F.length(text))
    low, high = policy.year_min - 2000, policy.year_max - 2000

    def after_end(s: Column) -> Column:
        m, yy = as_int(s["g1"]), as_int(s["g2"])
        return F.when(m.between(1, 12) & yy.between(low, high) & (s["start"] <= policy.end_hint_reach), dates.date_struct(yy + 2000, m, F.lit(None)))

    return F.coalesce(_dated(spans(text, MONTH_YEAR, 2), at_marker), F.when(text.rlike(mark), _dated(spans(rest, MONTH_YEAR_2, 2), after_end)))


def glued_day_month_year(text: Column, policy: Policy = DEFAULT) -> Column:
    def make(s: Column) -> Column:
        y, m, d = as_int(s["g3"]) + 2000, month_number(s["g2"]), as_int(s["g1"])
        return F.when(valid(y, m, d, policy), dates.date_struct(y, m, d))

    return _dated(spans(text, GLUED_D_MON_Y, 3, True), make)


def glued_numbers(text: Column, crop: Column, policy: Policy = DEFAULT) -> Column:
    """``YYYYMMDD``, then ``YYMMDD``."""

    def make(plus: int):
        def of(s: Column) -> Column:
            y, m, d = as_int(s["g1"]) + plus, as_int(s["g2"]), as_int(s["g3"])
            return F.when(valid(y, m, d, policy) & _in_context(text, s, crop, policy), dates.date_struct(y, m, d))

        return of

    return F.coalesce(_dated(spans(text, EIGHT, 3), make(0)), _dated(spans(text, SIX, 3), make(2000)))


def spaced_year_first(text: Column, crop: Column, policy: Policy = DEFAULT) -> Column:
    def make(s: Column) -> Column:
        y, m, d = (as_int(s[f"g{k}"]) for k in (1, 2, 3))
        return F.when(valid(y, m, d, policy) & _in_context(text, s, crop, policy), dates.date_struct(y, m, d))

    return _dated(spans(text, SPACED_Y4, 3), make)


def spaced_two_digits(text: Column, policy: Policy = DEFAULT) -> Column:
    """Three numbers of two digits, or a day and a glued month and year; for text of a date region only."""
    anywhere = F.lit(True)

    def long(s: Column) -> Column:
        d, m, y = (as_int(s[f"g{k}"]) for k in (1, 2, 3))
        return F.when(valid(y, m, d, policy) & _in_context(text, s, anywhere, policy), dates.date_struct(y, m, d))

    def short(s: Column) -> Column:
        a, m, c = (as_int(s[f"g{k}"]) for k in (1, 2, 3))
        return F.when(_in_context(text, s, anywhere, policy), dates.resolve_two_digit(a, m, c, dates.order_hint(text), policy))

    return F.coalesce(_dated(spans(text, SPACED_D_MY4, 3), long), _dated(spans(text, SPACED_2, 3), short))


def month_year(text: Column, crop: Column, policy: Policy = DEFAULT) -> Column:
    """Month and year alone: by name, year first, month first."""

    def make(y: str, m: str, number):
        return lambda s: _month_year(as_int(s[y]), number(s[m]), policy, _in_context(text, s, crop, policy))

    return F.coalesce(
        _dated(spans(text, MON_Y4, 2, True), make("g2", "g1", month_number)), _dated(spans(text, Y4_M, 2), make("g1", "g2", as_int)), _dated(spans(text, M_Y4, 2), make("g2", "g1", as_int)),
    )


def lone_month_day(text: Column, policy: Policy = DEFAULT) -> Column:
    """The best month and day without a year: near a due word, right before 까지, late in the text."""

    def make(s: Column) -> Column:
        before, after = cut(text, s["start"] - policy.context, s["start"]), cut(text, s["end"], s["end"] + policy.context)
        context = F.concat(before, after)
        score = F.when(has_exact(context, DUE), 2.0).otherwise(0.0) + F.when(F.instr(F.substring(after, 1, 6), choose.UNTIL) > 0, 1.5).otherwise(0.0)
        score = score + s["start"] / F.greatest(F.length(text), F.lit(1)) * 0.5
        return F.when(~has_exact(context, OTHER_DECIMALS), F.struct(score.alias("score"), (-s["start"]).alias("at"), as_int(s["g1"]).alias("m"), as_int(s["g2"]).alias("d")))

    best = F.array_max(F.filter(F.transform(spans(text, LONE_MONTH_DAY, 2), make), lambda x: x.isNotNull()))
    return bind(best, lambda x: F.when(x.isNotNull(), dates.date_struct(F.lit(None), x["m"], x["d"])))


def _via(date: Column, via: str) -> Column:
    none = F.lit(None).cast("string")
    return bind(date, lambda x: F.when(x.isNotNull(), F.struct(x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d"), none.alias("kind"), none.alias("raw"), F.lit(via).alias("via"))))


@lru_cache(maxsize=32)
def _steps(application: str, out: str, rescue: bool, policy: Policy) -> tuple[tuple[tuple[str, Column], ...], Column]:
    """The columns that lead from ``text`` and ``crop`` to the answer, each built on those before it, and the answer.

    Building them takes thousands of calls into the JVM, so they are kept for an application's later queries.
    """
    name = lambda x: f"__{out}_{x}"
    c = lambda x: F.col(name(x))
    texts = F.array_distinct(F.array(c("fixed"), c("alias"), c("text")))
    readings = [
        (lambda t: glued_day_month_year(t, policy), "gap_fill_compact_dmy"), (lambda t: glued_numbers(t, c("crop"), policy), "gap_fill_compact_numeric"), (lambda t: spaced_year_first(t, c("crop"), policy), "gap_fill_space_ymd"),
        (lambda t: F.when(c("crop"), spaced_two_digits(t, policy)), "gap_fill_space_2y"), (lambda t: month_year(t, c("crop"), policy), "gap_fill_month_year"),
    ]
    if rescue:
        readings.append((lambda t: lone_month_day(t, policy), "partial_rescue"))
    open_ = c("early").isNull()
    steps = (
        ("alias", textnorm.aliased(c("text"))), ("dates", cand.full_dates(c("alias"), policy)), ("base", choose.base_answer(c("alias"), c("dates"), policy)),
        ("early", F.coalesce(c("base"), _via(month_year_at_marker(c("alias"), policy), "gap_fill_month_year_strong"))), ("fixed", F.when(open_, textnorm.repaired(c("alias")))),
        ("more", F.when(c("fixed") != c("alias"), cand.full_dates(c("fixed"), policy))), ("again", F.when(open_ & (c("fixed") != c("alias")), choose.base_answer(c("fixed"), c("more"), policy))),
    )
    later = F.coalesce(*[_via(first_of(texts, DATE, f), via) for f, via in readings])
    repaired = F.when(c("again").isNotNull(), c("again").withField("via", F.lit("ocr_normalized")))
    answer = F.when(~open_, c("early")).otherwise(F.coalesce(repaired, F.when(c("fixed").rlike(r"(?U)\d"), later)))
    return tuple((name(n), x) for n, x in steps), answer


def read_dates(df: DataFrame, text: str = "text", crop: str | Column | bool = False, rescue: bool = True, out: str = "answer", policy: Policy = DEFAULT) -> DataFrame:
    """``df`` with a struct column ``out``: ``y, m, d, kind, raw, via``; null where the text prints no date.

    ``crop`` (a column's name, a column or a constant) says that a detector has already found the text to be a date
    region: due words are then not asked for. ``rescue`` allows a lone month and day. The steps are columns of their own,
    so that each is computed once and later ones only for rows without an answer; no row moves.
    """
    is_crop = F.lit(crop) if isinstance(crop, bool) else F.coalesce(F.col(crop) if isinstance(crop, str) else crop, F.lit(False))
    steps, answer = _steps(df.sparkSession.sparkContext.applicationId, out, rescue, policy)
    step = df.withColumns({f"__{out}_text": F.coalesce(F.col(text).cast("string"), F.lit("")), f"__{out}_crop": is_crop})
    for name, column in steps:
        step = step.withColumn(name, column)
    # A filter on the answer would be pushed below it, with a copy of the whole reading for each mention, and those of
    # copies again. No filter on what a generator makes is pushed below the generator; one on other columns still is.
    return step.select(*[F.col(f"`{x}`") for x in df.columns if x != out], F.explode(F.array(answer)).alias(out))


def submission(df: DataFrame, key: str = "image_id", answer: str = "answer") -> DataFrame:
    """The five output columns, all strings, ``NONE`` for what is not printed."""
    y, m, d, full = dates.text_of(F.col(answer)["y"], F.col(answer)["m"], F.col(answer)["d"])
    return df.select(F.col(key).cast("string").alias("image_id"), y.alias("year"), m.alias("month"), d.alias("day"), full.alias("final_date"))
