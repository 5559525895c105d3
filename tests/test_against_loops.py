"""The base answer as columns against the same rules written as plain loops over ``re`` matches, on random label texts.

The patterns and word lists are shared; positions, validity, overlaps, windows, kinds and the choice are written twice.
"""

import calendar
import datetime as dt
import random
import re
import unicodedata

from pyspark.sql import functions as F

from labeldates.config import DEFAULT
from labeldates.functions import dates, textnorm
from labeldates.operators import candidates as cand
from labeldates.operators import choose, layers

PRIOR = dict(DEFAULT.year_prior)
PHRASE = re.compile(cand.ENGLISH_DUE, re.I)
EXPIRY = (*cand.CONSUME, *cand.EXPIRY_EN, *cand.DISTRIBUTION)


def is_date(y, m, d):
    return 2015 <= y <= 2035 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]


def likelier(first, last):
    return PRIOR.get(last, 0.002) >= 6 * PRIOR.get(first, 0.002)


def hint_of(t):
    ymd = re.search(dates.YEAR_FIRST, t) or re.search(dates.YEAR_FIRST_EN, t, re.I)
    dmy = re.search(dates.DAY_FIRST, t) or re.search(dates.DAY_FIRST_EN, t, re.I)
    return None if bool(ymd) == bool(dmy) else "ymd" if ymd else "dmy"


def matches(t, n):
    for m in re.finditer(n.pattern, t, re.I if n.any_case else 0):
        part = dict(zip(n.order, m.groups(), strict=True))
        if "w" in part:
            part["m"] = str(dates.MONTHS.index(part["w"].upper()) + 1)
        yield m.start(), m.end(), part


def found(t):
    hint, out = hint_of(t), set()

    def add(a, b, *date):
        if is_date(*date):
            out.add((a, b, *date))

    for n, plus in [(n, 0) for n in (cand.YMD, cand.YMD_LOOSE_DAY, cand.KOREAN, cand.D_MON_Y4, cand.MON_D_Y4, cand.Y4_MON_D, cand.DM_Y4)] + [(cand.D_MON_Y2, 2000), (cand.MON_D_Y2, 2000)]:
        for a, b, p in matches(t, n):
            if n is cand.MON_D_Y2 and p["s"] == "" and 2015 <= int(p["d"] + p["y"]) <= 2035:
                continue
            add(a, b, int(p["y"]) + plus, int(p["m"]), int(p["d"]))
    for n in (cand.Y2_MD, cand.Y2_MD_LOOSE_DAY):
        for a, b, p in matches(t, n):
            x, m, z = int(p["a"]), int(p["m"]), int(p["c"])
            ways = [w for w in ((2000 + x, m, z), (2000 + z, m, x)) if is_date(*w)]
            if len(ways) == 2 and (hint == "dmy" or (hint is None and likelier(2000 + x, 2000 + z))):
                ways.reverse()
            if ways:
                add(a, b, *ways[0])
    for a, b, p in matches(t, cand.Y2_MON_D):
        y, m, d = int(p["y"]), int(p["m"]), int(p["d"])
        if not (is_date(2000 + d, m, y) and hint != "ymd" and not likelier(2000 + d, 2000 + y)):
            add(a, b, 2000 + y, m, d)
    places = [(i, i + len(w)) for w in cand.KEYWORDS for i in range(len(t)) if t.startswith(w, i)] + [m.span() for m in PHRASE.finditer(t)]
    for a, b in places:
        low = max(0, a - 30)
        for n, plus in ((cand.DDMMYY, 2000), (cand.DDMMYYYY, 0), (cand.Y4_M_D_SPACED, 0)):
            for s, e, p in matches(t[low : b + 30], n):
                add(low + s, low + e, int(p["y"]) + plus, int(p["m"]), int(p["d"]))
    kept = []
    for c in sorted(out):
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


def distances(t, c):
    before, after = t[max(0, c[0] - 20) : c[0]].upper(), t[c[1] : c[1] + 20].upper()
    back = lambda words: [len(before) - before.rfind(w) for w in words if w in before]
    on = lambda words: [after.find(w) for w in words if w in after]
    phrase = [m.start() for m in PHRASE.finditer(after)][:1]
    least = lambda x: min(x, default=None)
    return least(back(EXPIRY) + [len(before) - m.start() for m in PHRASE.finditer(before)]), least(back(cand.MADE)), least(on(EXPIRY) + phrase), least(on(cand.MADE))


def kind(t, c):
    e0, m0, e1, m1 = distances(t, c)
    if e0 is not None or m0 is not None:
        return "EXP" if m0 is None or (e0 is not None and e0 < m0) else "MFG"
    if e1 is not None or m1 is not None:
        return "EXP" if m1 is None or (e1 is not None and e1 <= m1) else "MFG"
    return "UNKNOWN"


def later(day, n, unit):
    if unit in "일주":
        return day + dt.timedelta(days=n * (7 if unit == "주" else 1))
    months = day.year * 12 + day.month - 1 + n * (12 if unit == "년" else 1)
    y, m = divmod(months, 12)
    return dt.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))


def answer(t):
    every = found(t)
    if every:
        for c in every:
            if "까지" in t[c[1] : c[1] + 5]:
                return c[2:]
        if re.search("(?<!로)부터", t) and "까지" in t:
            return max(c[2:] for c in every)
        kinds = {c: kind(t, c) for c in every}
        expiry = [c for c in every if kinds[c] == "EXP"]
        if expiry:
            return ([c for c in expiry if distances(t, c)[0] is not None] or expiry)[0][2:]
        if m := re.search(choose.RELATIVE, t):
            base = min(every, key=lambda c: abs(c[0] - m.start()))
            try:
                day = later(dt.date(*base[2:]), int(m[1]), m[2])
            except (ValueError, OverflowError):  # past the calendar: no date, and nothing else is tried
                return None, None, None
            return day.year, day.month, day.day
        if unknown := [c[2:] for c in every if kinds[c] == "UNKNOWN"]:
            return max(unknown)
    for w in (*cand.CONSUME, *cand.DISTRIBUTION, *cand.EXPIRY_EN):
        for i in range(len(t)):
            if t.startswith(w, i) and (m := re.search(cand.MONTH_DAY, t[max(0, i - 40) : i + len(w) + 40])):
                return None, int(m[1]), int(m[2])
    return None


def test_base_answers(spark):
    rng = random.Random(21)
    pieces = [
        "소비기한", "유통기한", "EXP", "exp", "제조", "제조일자", "제조일로부터 ", "PROD", "PRO:", "MFG", "Best Before", "BEST.BY", "SEL BY", "BBE", "까지", "부터", "개월", "년", "일", "(일.월.년)", "DD/MM/YY", "LOT", "g", "℃", "😀", "　",
        " ", " ", ".", ".", "-", "/", ",", ":", "2021", "2026", "1999", "21", "26", "24", "12", "11", "31", "02", "3", "7", "0", "MAR", "Nov", "2026.01.02", "24.12.21", "27/03/2022", "2025년 7월 9일", "050926", "27032022", "2020 06 03", "02.18",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = df.withColumn("c", cand.full_dates(F.col("t"))).withColumn("a", choose.base_answer(F.col("t"), F.col("c"))).collect()
    wrong = []
    for r in rows:
        t = texts[r["i"]]
        got = None if r["a"] is None else (r["a"]["y"], r["a"]["m"], r["a"]["d"])
        if [tuple(c) for c in r["c"]] != found(t) or got != answer(t):
            wrong.append((t, [tuple(c) for c in r["c"]], found(t), got, answer(t)))
    assert not wrong, wrong[:5]
    assert sum(r["a"] is not None for r in rows) > 500


# --- the layers

def aliased(t):
    t = t.replace("사용기한", "소비기한").replace("품질유지기한", "소비기한")
    t = re.sub("제조(?:번호|원|회사|국|사|공장|업체)", lambda m: "　" * len(m[0]), t)
    return re.sub(r"(?<![\d.\-/:])\d{1,2}:\d{2}(?![\d.\-/:])", lambda m: " " * len(m[0]), t)


def repaired(t):
    table = {"O": "0", "o": "0", "D": "0", "Q": "0", "C": "0", "U": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "]": "1", "[": "1", "Z": "2", "z": "2", "그": "2", "고": "2", "E": "3", "A": "4", "S": "5", "s": "5", "b": "6", "G": "6", "T": "7", "B": "8", "q": "9", "g": "9"}
    t = re.sub(textnorm.DATE_LIKE.removeprefix("(?U)"), lambda m: "".join(table.get(c, c) for c in m[0]), unicodedata.normalize("NFKC", t))
    return re.sub(r"(?<=\d)[:~](?=\d{1,2}(?!\d))", ".", t)


def has(t, words):
    return any(w.upper() in t.upper() for w in words)


def fits(t, m, crop):
    near = t[max(0, m.start() - 25) : m.end() + 25]
    return not has(near, layers.OTHER_NUMBERS) and (crop or has(near, layers.DUE))


def marked(t, crop):
    for m in re.finditer(layers.MONTH_YEAR, t):
        before = t[max(0, m.start() - 25) : m.start()]
        marks = list(re.finditer(layers.MARKER, before, re.I))
        if marks and 1 <= int(m[1]) <= 12 and 2015 <= int(m[2]) <= 2035 and not re.search(r"\d{3}", before[marks[-1].end() :]):
            return int(m[2]), int(m[1]), None
    if end := re.search(layers.END_MARK, t, re.I):
        for m in re.compile(layers.MONTH_YEAR_2).finditer(t, end.end()):
            if 1 <= int(m[1]) <= 12 and 15 <= int(m[2]) <= 35 and m.start() - end.end() <= 60:
                return 2000 + int(m[2]), int(m[1]), None


def by_pattern(*specs, anchored=True):
    """Of each pattern in turn the first match that is a date: how its groups make year, month, day."""
    def of(t, crop):
        for pattern, flags, make in specs:
            for m in re.finditer(pattern, t, flags):
                date = make(m, t)
                if date and (is_date(*date) if date[2] is not None else 2015 <= date[0] <= 2035 and 1 <= date[1] <= 12) and (not anchored or fits(t, m, crop)):
                    return date
    return of


def three(m, t):
    x, mo, z = (int(g) for g in m.groups())
    ways = [w for w in ((2000 + x, mo, z), (2000 + z, mo, x)) if is_date(*w)]
    if len(ways) == 2 and (hint_of(t) == "dmy" or (hint_of(t) is None and likelier(2000 + x, 2000 + z))):
        ways.reverse()
    return ways[0] if ways else None


def number(name):
    return dates.MONTHS.index(name.upper()) + 1


def lone(t, crop):
    best = None
    for m in re.finditer(layers.LONE_MONTH_DAY, t):
        before, after = t[max(0, m.start() - 25) : m.start()], t[m.end() : m.end() + 25]
        if any(w in before + after for w in layers.OTHER_DECIMALS):
            continue
        score = 2.0 * any(w in before + after for w in layers.DUE) + 1.5 * ("까지" in after[:6]) + m.start() / max(1, len(t)) * 0.5
        if best is None or score > best[0]:
            best = score, (None, int(m[1]), int(m[2]))
    return best and best[1]


LAYERS = [
    by_pattern((layers.GLUED_D_MON_Y, re.I, lambda m, t: (2000 + int(m[3]), number(m[2]), int(m[1]))), anchored=False),
    by_pattern((layers.EIGHT, 0, lambda m, t: tuple(map(int, m.groups()))), (layers.SIX, 0, lambda m, t: (2000 + int(m[1]), int(m[2]), int(m[3])))),
    by_pattern((layers.SPACED_Y4, 0, lambda m, t: tuple(map(int, m.groups())))),
    lambda t, crop: by_pattern((layers.SPACED_D_MY4, 0, lambda m, t: (int(m[3]), int(m[2]), int(m[1]))), (layers.SPACED_2, 0, three))(t, True) if crop else None,
    by_pattern((layers.MON_Y4, re.I, lambda m, t: (int(m[2]), number(m[1]), None)), (layers.Y4_M, 0, lambda m, t: (int(m[1]), int(m[2]), None)), (layers.M_Y4, 0, lambda m, t: (int(m[2]), int(m[1]), None))),
    lone,
]


def layered(t, crop):
    alias = aliased(t)
    if got := answer(alias) or marked(alias, crop):
        return got
    fixed = repaired(alias)
    if fixed != alias and (got := answer(fixed)):
        return got
    return next((got for f in LAYERS for x in (fixed, alias, t) if (got := f(x, crop))), None)


def test_layers(spark):
    rng = random.Random(22)
    pieces = [
        "소비기한", "사용기한", "품질유지기한:", "제조번호", "제조국", "EXP", "Best Before End", "BBE", "USE BY", "fin de", "말일", "까지", "유효기간", "LOT", "로트", "전화", "보관", "로 ", "ml", "g", "%", "℃", "(년월일)", "㎎", "　", "２０２６", "：",
        " ", " ", " ", ".", "-", "/", ":", "~", "2O26", "O3", "I1", "2B", "그5", "202B.01.2", "20260516", "261030", "30APR21", "MAY", "OCT.2021", "MAY 2023", "2027:10", "09/2026", "07-21", "30 12 23", "19 102022", "2020 06 03", "02.18", "12/31", "2.8", "19:06", "1:30", "2026", "11", "7", "45", "S", "b", "OI",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for crop in (False, True):
        rows = layers.read_dates(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4), text="t", crop=crop).collect()
        wrong = []
        for r in rows:
            want, a = layered(texts[r["i"]], crop), r["answer"]
            if (a and (a["y"], a["m"], a["d"])) != want:
                wrong.append((texts[r["i"]], a, want))
        assert not wrong, (len(wrong), wrong[:6])
        assert len({r["answer"]["via"] for r in rows if r["answer"]}) >= (8 if crop else 7)
