import random
import re

from pyspark.sql import functions as F

from labeldates.functions.spans import drop_overlaps, spans
from labeldates.operators.candidates import KIND

PATTERNS = [(r"(?<!\d)(\d{2})\s*[./]\s*(\d{1,2})(?!\d)", 2), (r"(\d{4})\s+(\d{1,2})", 2), (r"소비기한|EXP", 0), (r"(?<![A-Za-z])([A-Z]{3})(?!\d)", 1)]


def test_spans_agree_with_python(spark):
    rng = random.Random(3)
    alphabet = list("0123456789./ ABCEXP한소비기한년월😀　") + ["소비기한", "EXP", "12.3", "2026 1"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[spans(F.col("t"), p, n).alias(f"s{k}") for k, (p, n) in enumerate(PATTERNS)]).collect()
    for r in rows:
        for k, (p, n) in enumerate(PATTERNS):
            want = [(m.start(), m.end(), *m.groups()) for m in re.finditer(p, texts[r["i"]])]
            got = [(s["start"], s["end"], *[s[f"g{j}"] for j in range(1, n + 1)]) for s in r[f"s{k}"]]
            assert got == want, (texts[r["i"]], p)


def test_overlaps(spark):
    c = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("start", "end", "y", "m", "d"), strict=True)])
    given = F.array(c(5, 9, 2, 2, 2), c(0, 6, 2020, 1, 1), c(0, 5, 2021, 1, 1), c(4, 8, 1, 1, 1), c(9, 12, 3, 3, 3))
    kept = spark.range(1).select(drop_overlaps(given, KIND).alias("k")).first()["k"]
    assert [(k["start"], k["end"]) for k in kept] == [(0, 5), (5, 9), (9, 12)]  # shorter first, touching ones stay
