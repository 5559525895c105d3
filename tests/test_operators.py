import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from labeldates.operators import cascade, evaluation, geometry, quality, sampling
from labeldates.operators.choose import ANSWER

PREDICTION = "image_id string, year string, month string, day string"


def test_scores(spark):
    labels = spark.createDataFrame([("3345", "2026", "1", "02", "A", "완료"), ("cust_0001", "NONE", "02", "18", "D", "완료"), ("1234567", None, "03", "04", "G", "완료"), ("9", "2026", "01", "01", "A", "보류"), ("10", "NONE", "NONE", "NONE", "F", "완료")], PREDICTION + ", batch string, status string")
    predictions = spark.createDataFrame([("003345", "2026", "01", "2"), ("cust_0001", "NONE", "02", "18"), ("1234567", None, "03", "04"), ("x", "1", "1", "1")], PREDICTION)
    p, t = evaluation.normalized(predictions), evaluation.done(evaluation.normalized(labels, evaluation.BLANK_LABEL))
    rows = {r["image_id"]: r for r in evaluation.scored(t, p, ("batch",)).collect()}
    assert rows["003345"]["exact"] and rows["cust_0001"]["exact"] and rows["cust_0001"]["covered"]
    assert not rows["1234567"]["ok_year"] and rows["1234567"]["partial"] == pytest.approx(2 / 3)  # a blank label is never right
    assert rows["000010"]["exact"] and not rows["000010"]["covered"]  # NONE against a missing prediction
    assert {r["grp"] for r in evaluation.by_group(evaluation.scored(t, p, ("batch",))).collect()} == {"all", "A-C", "D+E"}
    assert evaluation.restricted(t, p).count() == 4 and evaluation.restricted(t, p, True).count() == 3
    assert evaluation.summary_dict(evaluation.scored(t.limit(0), p))["n"] == 0


def test_sign_test(spark):
    assert evaluation.sign_test(9, 0) == 2 / 2**9 and evaluation.sign_test(0, 0) == 1
    pairs = [(u, d) for u in range(0, 12) for d in range(0, 12)]
    rows = spark.createDataFrame(pairs, "u long, d long").withColumn("p", evaluation.sign_test_column(F.col("u"), F.col("d"))).collect()
    for r in rows:
        n, k = r["u"] + r["d"], min(r["u"], r["d"])
        want = 1.0 if n == 0 else float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n)))
        assert r["p"] == pytest.approx(want) and evaluation.sign_test(r["u"], r["d"]) == pytest.approx(want)


def test_bootstrap_is_stable(spark):
    rows = spark.createDataFrame([(str(i), 0.5, 0.5 + (i % 3) / 10) for i in range(60)], "image_id string, before double, after double")
    a, b = (evaluation.bootstrap(rows.repartition(n), rounds=100).first() for n in (1, 5))
    assert a["low"] == pytest.approx(b["low"]) and a["low"] < 0.1 < a["high"] and a["mean"] == pytest.approx(0.1, abs=0.02)


def answers(spark, rows):
    return spark.createDataFrame(rows, f"image_id string, stage int, answer {ANSWER}")


def test_cascade(spark):
    full = lambda raw, via=None: (2026, 1, 2, "EXP", raw, via)
    sound, weak, fixed = full("2026.01.02"), full("2026.1.2"), full("2026.01.02", "ocr_normalized")
    two, one = (2026, 1, None, None, None, "x"), (None, None, 2, None, None, "x")
    rows = [("sound2", 1, two), ("sound2", 2, sound), ("weakstrong", 1, weak), ("weakstrong", 3, sound), ("weakonly", 2, fixed), ("weakonly", 3, two), ("weakonly", 4, weak), ("fuller", 1, one), ("fuller", 2, two), ("fuller", 3, two), ("nothing", 1, None), ("nothing", 2, (None, None, None, None, None, None))]
    best = {r["image_id"]: r for r in cascade.best_answers(answers(spark, rows)).collect()}
    assert {k: (v["stage"], v["weak"]) for k, v in best.items()} == {"sound2": (2, False), "weakstrong": (3, False), "weakonly": (2, True), "fuller": (2, False)}
    assert cascade.stages(fast=True) == (1,) and cascade.stages(fallback=False) == (1, 2, 3, 4)
    late = cascade.deadline(100, lambda: 0, lambda: 30, 100)
    assert not late(9) and late(10)


def test_stage_loop_equals_ranking(spark):
    rng = random.Random(8)
    said = ["EXP 2026.01.02", "소비기한 2026.1.2", "EXP 02/2026", "소비기한 02.03", "nothing", "2O26.O9.I1"]
    texts = [(str(i), s, rng.choice(said)) for i in range(40) for s in range(1, 7)]
    df = spark.createDataFrame(texts, "image_id string, stage int, text string")
    loop = cascade.run_stages(df.select("image_id").distinct(), lambda open_, stage: df.where(F.col("stage") == stage).join(open_, "image_id", "left_semi"))
    crop = F.col("stage") <= 4
    from labeldates.operators.layers import read_dates

    whole = cascade.best_answers(read_dates(df, crop=crop).select("image_id", "stage", "answer"))
    assert sorted(map(str, loop.collect())) == sorted(map(str, whole.collect()))


def test_regions(spark):
    rows = [("a", "full", 0.0, 0.0, 1.0, 1.0, 0.3), ("a", "full", 2.0, 0.0, 3.0, 1.0, 0.9), ("a", "full", 4.0, 0.0, 5.0, 1.0, 0.5), ("b", "date", 1.0, 2.0, 3.0, 4.0, 0.5), ("b", "due", 0.0, 3.0, 2.0, 9.0, 0.5), ("c", "code", 0.0, 0.0, 1.0, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "image_id string, cls string, x1 double, y1 double, x2 double, y2 double, conf double")
    got = sorted((r["image_id"], r["n"], r["x1"], r["x2"], r["y2"]) for r in cascade.regions(df).collect())
    assert got == [("a", 1, 2.0, 3.0, 1.0), ("a", 2, 4.0, 5.0, 1.0), ("b", 1, 0.0, 3.0, 9.0)]


def greedy(boxes, iou):
    kept = []
    for b in sorted(boxes, key=lambda b: -b[4]):
        def over(k, b=b):
            i = max(0, min(k[2], b[2]) - max(k[0], b[0])) * max(0, min(k[3], b[3]) - max(k[1], b[1]))
            return i / ((k[2] - k[0]) * (k[3] - k[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i + 1e-9)
        if all(over(k) < iou for k in kept):
            kept.append(b)
    return kept


def test_suppression_against_a_loop(spark):
    rng = random.Random(1)
    boxes = [(x := rng.uniform(0, 50), y := rng.uniform(0, 50), x + rng.uniform(5, 30), y + rng.uniform(5, 30), i / 100) for i in range(60)]
    df = spark.createDataFrame([("i", "date", *b) for b in boxes], "image_id string, cls string, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sorted(round(r["conf"], 6) for r in geometry.suppressed(df).collect()) == sorted(round(b[4], 6) for b in greedy(boxes, 0.45))


def test_reading_order_and_hash(spark):
    corners = lambda x, y, h: [[x, y], [x + 5, y], [x + 5, y + h], [x, y + h]]
    items = [("03", corners(20.0, 1.0, 8.0)), ("2026", corners(0.0, 0.0, 8.0)), ("low", corners(0.0, 30.0, 8.0)), ("08", corners(10.0, 3.0, 8.0))]
    df = spark.createDataFrame([("a", items), ("b", [])], "image_id string, items array<struct<text:string,box:array<array<double>>>>")
    assert {r["image_id"]: r["t"] for r in df.select("image_id", geometry.reading_order(F.col("items")).alias("t")).collect()} == {"a": "2026 08 03 low", "b": ""}
    rng = random.Random(2)
    pixels = [float(rng.randrange(256)) for _ in range(256)]
    words = spark.createDataFrame([(pixels,)], "p array<double>").select(geometry.hash_bits(F.col("p")).alias("h")).first()["h"]
    bits = "".join(f"{w & (2**64 - 1):064b}"[::-1] for w in words)
    assert [b == "1" for b in bits] == [p > sum(pixels) / 256 for p in pixels]


def test_quality_rules(spark):
    columns = "image_id string, year string, month string, day string, final_date string, status string, notation_raw string, tag_ymonly string"
    rows = [("ok", "2026", "02", "11", "2026-02-11", "완료", "x", "FALSE"), ("leap", "none", "02", "29", "none-02-29", "완료", "x", ""), ("leap2", "2026", "02", "29", "2026-02-29", "완료", "x", ""), ("held", "x", "y", "z", "w", "보류", "", ""), ("empty", "", None, "", "", " ", "", ""), ("ok", "2026", "NONE", "NONE", "2026-NONE-NONE", "완료", "x", "true")]
    found = sorted((r["image_id"], r["rule"]) for r in quality.check_labels(spark.createDataFrame(rows, columns), spark.createDataFrame([("ok",), ("new",)], "image_id string")).collect())
    assert ("leap2", "no_such_day") in found and ("ok", "duplicate_id") in found and ("new", "missing") in found and ("empty", "empty_row") in found
    assert not [x for x in found if x[0] == "leap" and x[1] != "ghost"] and ("held", "ghost") in found and len([x for x in found if x[0] == "held"]) == 1
    assert not quality.has_errors(quality.row_rules(spark.createDataFrame(rows[:2], columns)))


def test_selection(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(203)], "id int, s string")
    one, two = (sorted((r["id"], r["part"]) for r in sampling.split(rows.repartition(n), "s", "id").collect()) for n in (1, 6))
    assert one == two and len(one) == 203
    assert sum(p == "val" for i, p in one if i % 10) == 18 and sum(p == "val" for i, p in one if i % 10 == 0) == 2
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(40)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(256), n)) for b, n in zip(base, (0, 5, 20, 21, 61) * 8, strict=True)]
    words = lambda x: [int.from_bytes((x >> 64 * j & (2**64 - 1)).to_bytes(8, "little"), "little", signed=False) - (1 << 64 if x >> 64 * j & 1 << 63 else 0) for j in range(4)]
    df = spark.createDataFrame([(i, words(x)) for i, x in enumerate(hashes)], "image_id int, h array<bigint>")
    got = {(r["left_id"], r["right_id"]) for r in sampling.near_pairs(df, df).where("left_id < right_id").collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (hashes[i] ^ hashes[j]).bit_count() <= 20}
    kept = sampling.accepted_in_order(df, 50)
    assert len(kept) == 50 and all((hashes[a] ^ hashes[b]).bit_count() > 20 for a in kept for b in kept if a != b)
    assert sampling.far_from(df.where("image_id >= 40"), df.where("image_id < 40")).count() == 16


def test_hash_bits_take_values_once(spark):
    """Not again for each of the 256 bits, however the values come about."""
    assert str(geometry.hash_bits(F.col("grey"))).count("grey") == 1
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((F.col("id") * 31 + i * i * 7) % 256).cast("double"))
    for r in spark.range(50).select("id", geometry.hash_bits(pixels).alias("h")).collect():
        x = [(r["id"] * 31 + i * i * 7) % 256 for i in range(256)]
        assert [w % 2**64 for w in r["h"]] == [sum((x[64 * j + k] > sum(x) / 256) << k for k in range(64)) for j in range(4)]
