"""Batches that go to Python are bounded by their bytes, whatever the length of a text."""

import pyarrow as pa

from labeldates.llm import common


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])


def test_long_texts_come_in_small_batches(spark):
    spark.conf.unset(common.BATCH_SETTING)
    texts = spark.range(0, 60, 1, 1).selectExpr("repeat('abcdefgh', 50000) as text")
    found = texts.transform(common.in_arrow, _sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in found) == 60
    assert len(found) > 4
    assert max(r["size"] for r in found) < 5_000_000


def test_a_text_past_the_bound_stays_whole(spark):
    texts = spark.range(0, 3, 1, 1).selectExpr("repeat('abcdefgh', 1000000) as text")
    found = texts.transform(common.in_arrow, _sizes, "rows long, size long").collect()
    assert [r["rows"] for r in found] == [1, 1, 1]
    assert min(r["size"] for r in found) >= 8_000_000


def test_a_size_that_is_set_stays(spark):
    spark.conf.set(common.BATCH_SETTING, "9m")
    try:
        common.in_arrow(spark.range(1), _sizes, "rows long, size long")
        assert spark.conf.get(common.BATCH_SETTING) == "9m"
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_an_empty_table_gives_no_rows(spark):
    assert spark.range(0).transform(common.in_arrow, _sizes, "rows long, size long").count() == 0
