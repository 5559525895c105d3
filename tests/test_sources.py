import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldates import imaging
from labeldates.config import DetectorConfig, RunConfig
from labeldates.operators.layers import read_dates
from labeldates.plans import batch
from labeldates.sources import images, tables
from labeldates.streaming import stream


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text('﻿image_id,year,note\n1,2026,"two\nlines, ""quoted"""\n2,,\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(path))
    assert rows.columns == ["image_id", "year", "note"]
    assert [tuple(r) for r in rows.collect()] == [("1", "2026", 'two\nlines, "quoted"'), ("2", None, None)]
    out = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame([("1", "NONE", None, "x", "y", 5)], "image_id string, year string, month string, day string, final_date string, extra int"), out, one_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b"image_id,year,month,day,final_date\n1,NONE,,x,y\n"


def test_batch_run(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    texts = {"3345.jpg": "nothing\nEXP 2026.01.02", "a.b.PNG": "소비기한 2026.09.11까지", "c.webp": "?\n?\n?\n?\n유통기한 02/2027", "bad.jpg": "\0", "note.txt": "EXP 2020.01.01"}
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    config = RunConfig(input_dir=str(folder), output_path=str(tmp_path / "submission.csv"))
    got = {r["image_id"]: r["final_date"] for r in batch.run(spark, imaging.TextProvider, config, debug=True).collect()}
    assert got == {"3345": "2026-01-02", "a.b": "2026-09-11", "c": "2027-02-NONE", "bad": "NONE"}
    again = {r["image_id"]: r["final_date"] for r in tables.read_csv(spark, config.output_path, tables.SUBMISSION).collect()}
    assert again == got
    only = spark.createDataFrame([("a.b",), ("003345",)], "image_id string")
    assert [r["image_id"] for r in batch.run(spark, imaging.TextProvider, config, ids=only).collect()] == ["a.b"]
    assert {r["final_date"] for r in batch.run(spark, imaging.TextProvider, config, fast=True).collect()} == {"2026-09-11", "NONE"}


def test_scans_and_manifest(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "out").mkdir()
    for name in ("in/x.JPG", "in/deep/y.heic", "in/.hidden.jpg", "in/out/z.jpg", "in/readme.md"):
        (tmp_path / name).write_text(name)
    found = images.scan_collection(spark, str(tmp_path / "in"), output=str(tmp_path / "in" / "out"))
    assert sorted(r["src_file"] for r in found.select("src_file").collect()) == ["deep/y.heic", "x.JPG"]
    expected = images.manifest(found).select("name", "sha256").unionByName(spark.createDataFrame([("gone", "0")], "name string, sha256 string"))
    assert {r["name"]: r["state"] for r in images.verified(found, expected).collect()} == {"x.JPG": "ok", "y.heic": "ok", "gone": "missing"}
    with pytest.raises(ValueError, match="gone"):
        images.require(found, expected)


def test_register_and_boxes(spark, tmp_path):
    register = spark.createDataFrame([("cust_0009", "b"), ("other", "z")], "image_id string, src_file string")
    new = tables.appended(register, spark.createDataFrame([("c",), ("a",), ("b",), ("d",)], "src_file string"))
    assert sorted(map(tuple, new.collect())) == [("cust_0010", "a"), ("cust_0011", "c"), ("cust_0012", "d")]
    (tmp_path / "b.json").write_text('{"labeler": "n", "items": [{"filename": "p.q.jpg", "boxes": [{"cls": "due", "x1": -5, "y1": 0, "x2": 10, "y2": 10}, {"cls": "date", "x1": 3, "y1": 3, "x2": 3, "y2": 9}]}]}')
    sizes = spark.createDataFrame([("p.q", 20.0, 10.0)], "image_id string, w double, h double")
    lines = tables.detector_labels(tables.read_boxes(spark, str(tmp_path / "b.json")), sizes, F.create_map(F.lit("date"), F.lit(0), F.lit("due"), F.lit(1))).first()
    assert tuple(lines) == ("p.q", "1 0.250000 0.500000 0.500000 1.000000")


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "weights").mkdir()
    (tmp_path / "weights" / "a.onnx").write_text("x")
    (tmp_path / "c.yaml").write_text("Det:\n  model_path: ./weights/a.onnx\nRec:\n  model_path: ./weights/gone.onnx\n")
    text = tables.absolute_model_paths((tmp_path / "c.yaml").read_text(), str(tmp_path))
    assert f"model_path: {tmp_path.resolve()}/weights/a.onnx" in text and "./weights/gone.onnx" in text
    assert tables.write_absolute_config(str(tmp_path / "none.yaml")) is None
    monkeypatch.setenv("LABELDATES_BUDGET_SEC", "10")
    assert RunConfig.from_env().budget_s == 10


def test_pixels():
    image = np.zeros((40, 60, 3), np.uint8) + 200
    image[15:25, 10:50:4] = 20
    assert imaging.enhanced(image).shape == image.shape and imaging.thickened(image).shape == image.shape
    dark = (imaging.thickened(image) < 128).mean()
    assert dark > (image < 128).mean()
    canvas, scale, dx, dy = imaging.letterboxed(image, 96)
    assert canvas.shape == (96, 96, 3) and scale == 1.6 and (dx, dy) == (0, 16)
    assert len(imaging.average_hash(image)) == 4 and imaging.average_hash(image) == imaging.average_hash(image.copy())
    assert imaging.otsu(imaging.grey(image)) in range(20, 200)
    assert DetectorConfig().classes == ("date", "due", "code", "full")


def test_stream(spark, tmp_path):
    rows = [("a", 1, "EXP 2026.1.2", True), ("b", 1, "?", True)], [("a", 2, "EXP 2026.01.03", True), ("b", 5, "소비기한 02.18", False)]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, stream.TEXTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(stream.TEXTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {r["image_id"]: r["final_date"] for r in stream.best_so_far(spark, str(tmp_path / "out")).collect()} == {"a": "2026-01-03", "b": "NONE-02-18"}
    assert read_dates(source).isStreaming


def test_appended_ids_go_on_past_four_digits(spark, tmp_path):
    """The register of the query has 10,005 ids, the last cust_10005; new ones are not cut to four digits either."""
    from labeldates.plans import queries

    spark.range(20_010).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["image_id"] for r in queries.QUERIES["q_s13_appended"](spark, str(tmp_path)).orderBy("src_file").collect()]
    assert got == [f"cust_{n}" for n in range(10_006, 20_011)]
