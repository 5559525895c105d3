"""Text normalization, all as columns.

``aliased`` makes terms uniform and blanks what looks like a date or a keyword but is none. ``repaired`` undoes confusions
of a text recognizer inside tokens that look like dates.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import bind

WIDE_SPACE = "　"


def unify_terms(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("사용기한"), F.lit("소비기한")), F.lit("품질유지기한"), F.lit("소비기한"))


def blank_maker_words(text: Column) -> Column:
    """Compounds of 제조 that name no date, as as many wide spaces."""
    blanked = F.regexp_replace(F.regexp_replace(text, "제조(?:번호|회사|공장|업체)", WIDE_SPACE * 4), "제조(?:원|국|사)", WIDE_SPACE * 3)
    return F.when(F.instr(text, "제조") > 0, blanked).otherwise(text)


def blank_clock_times(text: Column) -> Column:
    """Times that stand by themselves, as as many spaces."""
    before, after = r"(?U)(?<![\d.\-/:])", r"(?![\d.\-/:])"
    blanked = F.regexp_replace(F.regexp_replace(text, before + r"\d\d:\d\d" + after, " " * 5), before + r"\d:\d\d" + after, " " * 4)
    return F.when(F.instr(text, ":") > 0, blanked).otherwise(text)


def aliased(text: Column) -> Column:
    return bind(bind(unify_terms(text), blank_maker_words), blank_clock_times)


@lru_cache(maxsize=1)
def _compatibility() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility or canonical form of one character, that form, and those with a longer one."""
    one_from, one_to, many = [], [], {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or (n := unicodedata.normalize("NFKC", c)) == c:
            continue
        if len(n) == 1:
            one_from.append(c)
            one_to.append(n)
        else:
            many[c] = n
    return "".join(one_from), "".join(one_to), many


def compatibility_form(text: Column) -> Column:
    """Unicode NFKC character by character: every character's own form, by a table made from the Unicode data of the
    running Python. Sequences of combining characters are not composed."""
    one_from, one_to, many = _compatibility()
    ranges, start = [], None
    codes = sorted(map(ord, [*one_from, *many]))
    for a, b in zip(codes, [*codes[1:], 0], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append((start, a))
            start = None
    odd = "[" + "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]"
    long = "".join(many)
    out = F.translate(text, one_from, one_to)
    # The longer forms as one string, each followed by a line feed, found by the position of its character.
    forms = F.split(F.lit("\n".join(many.values())), "\n")
    spread = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(F.instr(F.lit(long), c) > 0, F.get(forms, F.instr(F.lit(long), c) - 1)).otherwise(c)), "")
    # Most texts have nothing but ASCII and Hangul: one cheap search tells.
    return F.when(~text.rlike("[^\\x00-\\x7F가-힣]"), text).when(~text.rlike(odd), text).otherwise(F.when(out.rlike(odd), spread).otherwise(out))


# Characters that a recognizer takes for digits, and below each its digit. Fixed values.
CONFUSED_FROM = "OoDQCUlIi|!][Zz그고EASsbGTBqg"
CONFUSED_TO = "000000111111122223455667899"
_ANY = "[0-9" + "".join("\\" + c if c in "|!][" else c for c in CONFUSED_FROM) + "]"
DATE_LIKE = rf"(?U)(?<![A-Za-z가-힣]){_ANY}{{1,4}}(?:[.\-/:,~\s]+{_ANY}{{1,4}}){{1,2}}(?![A-Za-z])"


def digits_for_confusions(text: Column) -> Column:
    gaps, hits = F.split(text, DATE_LIKE, -1), F.regexp_extract_all(text, F.lit(DATE_LIKE), F.lit(0))
    fixed = F.transform(hits, lambda h: F.translate(h, CONFUSED_FROM, CONFUSED_TO))
    woven = F.array_join(F.zip_with(gaps, fixed, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
    return F.when(text.rlike(DATE_LIKE), woven).otherwise(text)


def dots_for_colons(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<=\d)[:~](?=\d{1,2}(?!\d))", ".")


def repaired(text: Column) -> Column:
    return bind(bind(compatibility_form(text), digits_for_confusions), dots_for_colons)


def padded(text: Column, width: int) -> Column:
    """Trimmed; all-digit values filled with zeros to ``width``, longer ones left as they are."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike(r"^[0-9]+$"), F.lpad(t, F.greatest(F.length(t), F.lit(width)), F.lit("0"))).otherwise(t)


def file_stem(path: Column) -> Column:
    """The name of a file without its folder and last extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
