import datetime as dt
import random

from pyspark.sql import functions as F

from labeldates.config import Policy
from labeldates.functions import textnorm
from labeldates.operators import choose
from labeldates.operators.layers import read_dates, submission
from labeldates.plans import notation

# text, full date read from the whole label, full date read from a date region (None: the same)
CASES = [
    ("소비기한 26.09.11까지", "2026-09-11", None), ("유통기한 2026.09.11", "2026-09-11", None), ("사용기한: 2026.09", "2026-09-NONE", None), ("EXP.DATE 09/2026", "2026-09-NONE", None), ("제조일자 2024.09.11 제조일로부터 24개월", "2026-09-11", None),
    ("LOT 260911 소비기한 2026.12.31", "2026-12-31", None), ("품목보고번호 20240911234567 소비기한 2026.09.11", "2026-09-11", None), ("開封 2026.9", "NONE", "2026-09-NONE"), ("개봉 후 12M 이내 사용", "NONE", None), ("소비기한 상단 표기일까지", "NONE", None),
    ("소비기한 260911", "2026-09-11", None), ("소비기한 2O26.O9.I1", "2026-09-11", None), ("2026 08.04", "2026-08-04", None), ("202505,19", "2025-05-19", None), ("25. 10.14", "2025-10-14", None), ("OCT19-2021", "2021-10-19", None),
    ("20/05/2026", "2026-05-20", None), ("EXP 050926", "2026-09-05", None), ("05/08/25", "2025-08-05", None), ("FEB/21/21", "2021-02-21", None), ("17 JUL 21", "2021-07-17", None), ("소비기한 Nov 2021", "2021-11-NONE", None),
    ("1AN:14/09/2020 EXP:14/09/2021", "2021-09-14", None), ("Prod date: 13/03/2020 Best before: 06/11/2020", "2020-11-06", None), ("LOT 502337-04 EXP 02/2023", "2023-02-NONE", None), ("BEST 1V 30APR21", "2021-04-30", None),
    ("HS 19:06 2026:04.27", "2026-04-27", None), ("제조 2020.11.27 제조일로부터 5년까지", "2025-11-27", None), ("EXP 2026.11", "2026-01-01", None), ("소비기한 251226", "2026-12-25", None), ("21MAR23", "2021-03-23", None), ("20MAR24", "2020-03-24", None), ("25MAR24", "2024-03-25", None),
    ("소비기한 2O26.O3.24", "NONE-03-24", None), ("소비기한 2O26.O3.2O", "NONE-03-02", None), ("유통기한 1995.03.04", "NONE-03-04", None), ("1995.03.04", "NONE", None), ("보관 1-30℃ 백삼로 9-2 2.8g 47%", "NONE", None), ("30 12 23", "NONE", "2023-12-30"), ("MAY 2023 L0148", "NONE", "2023-05-NONE"),
    ("19 102022", "NONE", "2022-10-19"), ("U0B01366 20260516 04124150", "NONE", "2026-05-16"), ("2020 06 03", "NONE", "2020-06-03"), ("Best before end / fin de: 07-21", "2021-07-NONE", None), ("제조 2020.11.27 제조일로부터 99999년까지", "NONE", None), ("2025.09.22 부터 2025.12.21 까지", "2025-12-21", None),
    ("제조번호:20006 사용기한:2023.03.15", "2023-03-15", None), ("20290224까지 #23", "2029-02-24", None), ("2024.02.30 까지", "NONE", None), ("2024.02.29 까지", "2024-02-29", None), ("", "NONE", None), ("소비기한", "NONE", None), (None, "NONE", None),
]


def read(spark, texts, **how):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "image_id int, text string")
    got = {int(r["image_id"]): r["final_date"] for r in submission(read_dates(rows, **how)).collect()}
    return [got[i] for i in range(len(texts))]


def test_cases(spark):
    texts = [t for t, _, _ in CASES]
    for crop in (False, True):
        want = [c if crop and c else w for _, w, c in CASES]
        got = read(spark, texts, crop=crop)
        wrong = [(t, w, g) for t, w, g in zip(texts, want, got, strict=True) if w != g]
        # whole-label answers that need no anchor may only become fuller in a date region
        assert not [x for x in wrong if not crop or x[1] != "NONE"], wrong


def test_notations_give_dates_back(spark):
    rng = random.Random(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(0, 5000)) for _ in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    safe = {k: v for k, v in notation.FULL.items()}
    long = df.select("day", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), notation.label(t, F.col("day")).alias("text")) for k, t in safe.items()])).alias("x")).select("day", "x.*")
    wrong = read_dates(long).where("not (answer.y <=> year(day) and answer.m <=> month(day) and answer.d <=> day(day))").collect()
    assert not wrong


def test_partitions_and_extra_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(i, t, "x", True) for i, (t, _, _) in enumerate(CASES)], "image_id int, text string, answer string, `odd.name` boolean")
    ways = [sorted(map(tuple, submission(read_dates(rows.repartition(n))).collect())) for n in (1, 3, 8)]
    assert ways[0] == ways[1] == ways[2]
    assert read_dates(rows).columns == ["image_id", "text", "odd.name", "answer"]
    assert read_dates(rows.limit(0)).count() == 0


def test_policies(spark):
    assert read(spark, ["유통기한 2026.09.11 제조 2025.01.02"], policy=Policy(distribution_date_counts=False)) != ["NONE"]
    assert read(spark, ["제조일자 2024.09.11 제조일로부터 24개월"], policy=Policy(relative_as_none=True)) == ["NONE"]
    assert read(spark, ["24.12.21"], policy=Policy(flip_ratio=1e9)) == ["2024-12-21"]
    assert read(spark, ["24.12.21"]) == ["2021-12-24"]
    assert read(spark, ["03/04 까지"], rescue=False) == ["NONE"]


def test_via_and_raw(spark):
    rows = spark.createDataFrame([("EXP 2026.11",), ("2O26.O9.I1",), ("유통기한 MAY 2023",), ("02/18 까지",)], "text string")
    got = {r["text"]: r["answer"] for r in read_dates(rows).collect()}
    assert (got["EXP 2026.11"]["raw"], got["EXP 2026.11"]["kind"]) == ("2026.11", "EXP")
    assert got["2O26.O9.I1"]["via"] == "ocr_normalized"
    assert got["유통기한 MAY 2023"]["via"] == "gap_fill_month_year"
    assert got["02/18 까지"]["via"] == "partial_rescue"


def test_normalization(spark):
    given = [("12:30 2021:05", "      2021:05"), ("제조국 한국", "　　　 한국"), ("품질유지기한", "소비기한"), ("2021.06:14", "2021.06:14")]
    df = spark.createDataFrame(given, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", textnorm.aliased(F.col("t")).alias("got")).collect())
    forms = spark.createDataFrame([("２０２６．０９　㎎ ℃ ⑪",)], "t string").select(textnorm.compatibility_form(F.col("t")).alias("x")).first()["x"]
    assert forms == "2026.09 mg °C 11"
    repaired = spark.createDataFrame([("2026.09:21",), ("그5.10.고2까지",), ("20I6 and Odd words",)], "t string").select(textnorm.repaired(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in repaired] == ["2026.09.21", "25.10.22까지", "20I6 and Odd words"]


def test_diagnosis(spark):
    row = spark.createDataFrame([("제조일자 2025.01.02 별도 표기 소비기한 2026.01.01",)], "t string").select(choose.diagnosis(F.col("t")).alias("e")).first()["e"]
    assert [c["kind"] for c in row["candidates"]] == ["MFG", "EXP"] and row["has_reference_phrase"] and not row["has_relative_expr"] and row["result"]["y"] == 2026
