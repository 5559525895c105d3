"""Label texts from dates: every notation that the reader knows, for queries and tests.

A template names parts in braces: ``{Y}`` 2026, ``{y}`` 26, ``{M}`` and ``{D}`` two digits, ``{m}`` and ``{d}`` without a
leading zero, ``{MON}`` three letters in capitals. A second date's parts carry a 2: ``{Y2}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import MONTHS

PARTS = {
    "Y": lambda d: F.lpad(F.year(d).cast("string"), 4, "0"), "y": lambda d: F.lpad((F.year(d) % 100).cast("string"), 2, "0"),
    "M": lambda d: F.lpad(F.month(d).cast("string"), 2, "0"), "D": lambda d: F.lpad(F.dayofmonth(d).cast("string"), 2, "0"),
    "m": lambda d: F.month(d).cast("string"), "d": lambda d: F.dayofmonth(d).cast("string"), "MON": lambda d: F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1),
}


def label(template: str, day: Column, other: Column | None = None, **more: Column) -> Column:
    """The text of a template; further parts by name."""
    out = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece.startswith("{"):
            out.append(F.lit(piece))
            continue
        name = piece[1:-1]
        if name in more:
            out.append(more[name].cast("string"))
        elif name.endswith("2") and other is not None:
            out.append(PARTS[name[:-1]](other))
        else:
            out.append(PARTS[name](day))
    return F.concat(*[x for x in out])


# Notations that give a date back as it is. ``crop`` marks those read only from a date region.
FULL = {
    "c1_ymd": "{Y}.{M}.{D}", "c1_ymd_space_first": "{Y} {M}.{D}", "c1_ymd_slash": "유통기한 {Y}/{m}/{d}", "c2_loose_day": "{Y}.{M}{D}", "c5_korean": "{Y}년 {m}월 {d}일까지", "c6_d_mon_y4": "{d} {MON} {Y}", "c7_mon_d_y4": "BEST BY {MON} {D}, {Y}",
    "c8_y4_mon_d": "{Y}/{MON}/{D}", "c10_mon_d_y2": "{MON} {D} {y}", "c12_dm_y4": "{D}/{M}/{Y}", "c12_dm_y4_spaced": "{D} {M} {Y}", "c13_ddmmyy": "EXP {D}{M}{y}", "c14_ddmmyyyy": "EXP {D}{M}{Y}", "c15_y4_m_d_spaced": "USE BY {Y} {M} {D}",
    "n1_alias": "사용기한:{Y}.{M}.{D}", "n2_maker_words": "제조번호:20006 사용기한:{Y}.{M}.{D}", "n3_clock_time": "HS 19:06 {Y}:{M}.{D}", "n4_full_width": "소비기한　{Y}．{M}．{D}", "k17_phrase": "Best.Before {Y}-{M}-{D}",
}
CROP = {"l5_glued_8": "{Y}{M}{D}", "l6_spaced": "{Y} {M} {D}", "l7_d_my4": "{D} {M}{Y}"}
MONTH_YEAR = {"l2_at_marker": "LOT 502337-04 EXP {M}/{Y}", "l2_before_end": "Best before end: {M}-{y}", "l8_named": "소비기한 {MON} {Y}"}
