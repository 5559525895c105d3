import pytest
from pyspark.sql import functions as F

from labeldates import lineage
from labeldates.operators.layers import read_dates
from labeldates.plans import queries


@pytest.fixture
def stashed(monkeypatch):
    """Rows of every table that is written."""
    seen, real = {}, lineage.stash

    def counted(df, name):
        out = real(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lineage, "stash", counted)
    return seen


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """3,000 lines with seven days of shipment."""
    path = tmp_path_factory.mktemp("repeated")
    day = F.expr("timestamp'1996-03-27' + make_interval(0, 0, 0, cast(id % 7 as int))")
    spark.range(3000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 4 + 1).alias("l_linenumber"), day.alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name, texts", [("q_c1_ymd", 7), ("q_l5_glued_8", 7), ("q_l8_named", 2), ("q_k5_made_and_expiry", 7), ("q_k15_diagnosis", 7), ("q_v1_implausible_labelled", 7)])
def test_each_distinct_text_is_read_once(spark, stashed, repeated, name, texts):
    rows = queries.QUERIES[name](spark, repeated).collect()
    assert stashed == {"once": [texts]} and len({r["l_orderkey"] for r in rows}) == len(rows) == 3000
    assert len({(r["y"], r["m"], r["d"]) for r in rows}) == texts


@pytest.mark.parametrize("sent", [200_000, 0])
def test_once_gives_what_the_work_on_every_row_gives(spark, monkeypatch, sent):
    """Sent to the executors and by a shuffle; with a very common text, nulls and texts without a date."""
    monkeypatch.setattr(lineage, "SENT_ROWS", sent)
    texts = ["EXP 2026.11.05", "", None, "05/11/2026", "nothing", "제조일자 2025.01.02 제조일로부터 6개월"]
    rows = spark.createDataFrame([(i, texts[i % 40] if i % 40 < len(texts) else texts[0], i % 3 == 0) for i in range(400)], "i int, text string, crop boolean")
    if not sent:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lineage.once(rows, ("text", "crop"), lambda t: read_dates(t, crop="crop"))
        assert got.columns == ["i", "text", "crop", "answer"]
        assert sorted(map(str, got.collect())) == sorted(map(str, read_dates(rows, crop="crop").select(got.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spans_are_found_once_a_text(spark, stashed, repeated):
    rows = queries.QUERIES["q_c20_spans"](spark, repeated).collect()
    assert stashed == {"once": [7]} and len(rows) == 3000 and {tuple(r)[2:] for r in rows} == {(8, 18, 25, 35)}
