"""The image route with a provider that records what it is given."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldates import imaging
from labeldates.config import DetectorConfig, RunConfig
from labeldates.operators import geometry
from labeldates.plans import batch
from labeldates.sources import tables

SMALL = DetectorConfig(full_image_side=64)


class Recorder:
    """An image is JSON: size, boxes, and what its stages read; the calls are part of what is read."""

    def decode(self, content):
        if not content.startswith(b"{"):
            return None
        self.said = json.loads(content)
        self.calls = []
        h, w = self.said["size"]
        return (np.arange(h * w * 3) % 251).astype(np.uint8).reshape(h, w, 3)

    def detect(self, image, config):
        if self.said.get("fails"):
            raise ValueError("broken detector")
        return [(c, tuple(b), s) for c, b, s in self.said["boxes"]]

    def read(self, image):
        shape = "x".join(map(str, image.shape))
        flat = "grey" if (image[:, :, 0] == image[:, :, 2]).all() else "colour"
        two = "black" if len(np.unique(image)) <= 2 else "tones"
        text = self.said["read"].get(f"{flat} {two}") or f"{shape} {flat} {two}"
        return [("2026.11.05" if text == "late" else text, [[5.0, 40.0], [9.0, 40.0], [9.0, 48.0], [5.0, 48.0]]), ("EXP" if text == "late" else "top", [[5.0, 0.0], [9.0, 0.0], [9.0, 8.0], [5.0, 8.0]])]

    def read_line(self, image):
        return self.said["read"].get("line") or "line " + "x".join(map(str, image.shape[:2]))


def picture(boxes, size=(80, 120), **read):
    return json.dumps({"size": size, "boxes": boxes, "read": {k.replace("_", " "): v for k, v in read.items()}})


FULL = ["full", [20.0, 30.0, 60.0, 50.0], 0.9]
DATE, DUE = ["date", [20.0, 30.0, 60.0, 40.0], 0.8], ["due", [70.0, 35.0, 90.0, 45.0], 0.7]


def stage(spark, content, n, config=SMALL):
    rows = spark.createDataFrame([("a", content.encode())], "image_id string, content binary")
    return imaging.stage_texts(rows, Recorder, n, n < 5, config).first()


def test_what_each_stage_reads(spark):
    page = picture([FULL, DATE, DUE])
    # the crop: 40 x 20 grown by 18 and 12 pixels, raised to a height of 100
    assert stage(spark, page, 1)["text"] == "top 100x172x3 colour tones"
    assert stage(spark, page, 2)["text"] == "top 100x172x3 grey tones"
    assert stage(spark, page, 3)["text"] == "top 100x172x3 grey black"
    # dates first, each with the smaller margin, 12 pixels at least
    assert stage(spark, page, 4)["text"] == "line 34x64 line 34x44"
    assert stage(spark, page, 5)["text"] == "top 43x64x3 colour tones" and stage(spark, page, 6)["text"] == "top 43x64x3 grey tones"
    assert stage(spark, picture([]), 1)["text"] == "" and stage(spark, picture([]), 4)["text"] == ""
    # without the whole print, one region around dates and labels; at most two whole prints
    assert stage(spark, picture([DATE, DUE]), 1)["text"].count("top") == 1
    apart = [["full", [x, 0.0, x + 10, 10.0], 0.5 + x / 1000] for x in (0.0, 40.0, 80.0)]
    assert stage(spark, picture(apart), 1)["text"].count("top") == 2
    assert stage(spark, picture([FULL, ["full", [21.0, 30.0, 61.0, 50.0], 0.5]]), 1)["text"].count("top") == 1  # overlaps the surer one


def test_sizes_agree_with_the_columns(spark):
    for w, h in ((40, 20), (5000, 30), (4500, 4400), (1, 1), (300, 99), (700, 100), (8000, 10)):
        want = spark.range(1).select(geometry.crop_size(F.lit(w), F.lit(h)).alias("s")).first()["s"]
        got = imaging.sized_crop(np.zeros((h, w, 3), np.uint8), DetectorConfig())
        assert got.shape[:2] == (want["h"], want["w"])


def test_resized_keeps_means():
    image = np.random.default_rng(1).integers(0, 256, (30, 50, 3)).astype(np.uint8)
    small = imaging.resized(image, 10, 6)
    assert small.shape == (6, 10, 3) and abs(small.astype(float) - image.reshape(6, 5, 10, 5, 3).mean(axis=(1, 3))).max() <= 0.51
    assert imaging.resized(image, 50, 30).tolist() == image.tolist() and imaging.resized(np.full((3, 4, 3), 9, np.uint8), 9, 7).tolist() == np.full((7, 9, 3), 9).tolist()


@pytest.fixture
def folder(tmp_path):
    made = {
        "sound": picture([FULL], colour_tones="late"), "second": picture([FULL], grey_tones="late"), "line": picture([DATE], line="EXP 2026.11.06"), "whole": picture([], colour_tones="late"), "nothing": picture([]),
        "broken": json.dumps({"size": (9, 9), "boxes": [], "read": {"colour tones": "late"}, "fails": 1}), "text": "no image",
    }
    (tmp_path / "in").mkdir()
    for name, content in made.items():
        (tmp_path / "in" / f"{name}.png").write_text(content)
    return tmp_path


def test_the_whole_run(spark, folder):
    config = RunConfig(input_dir=str(folder / "in"), output_path=str(folder / "out.csv"))
    got = {r["image_id"]: r["final_date"] for r in batch.run(spark, Recorder, config, debug=True, waves=2).collect()}
    assert got == {"sound": "2026-11-05", "second": "2026-11-05", "line": "2026-11-06", "whole": "2026-11-05", "nothing": "NONE", "broken": "NONE", "text": "NONE"}
    seen = {r["image_id"]: r for r in spark.read.option("header", True).csv(str(folder / "out_debug.csv")).collect()}
    assert {k: r["route"] for k, r in seen.items()} == {"sound": "crop", "second": "crop+pp", "line": "crop+nodet", "whole": "fallback", "nothing": "none", "broken": "none", "text": "none"}
    assert seen["text"]["error"] == "load_fail" and seen["broken"]["error"] == "ValueError: broken detector" and seen["sound"]["text"] == "EXP 2026.11.05" and (seen["line"]["date"], seen["line"]["full"]) == ("1", "0")
    assert {r["image_id"]: r["final_date"] for r in tables.read_csv(spark, config.output_path).collect()} == got


def test_late_waves_go_fast_and_back(spark, folder, monkeypatch):
    for i in range(24):
        (folder / "in" / f"n{i}.png").write_text(picture([FULL], grey_tones="late"))
    clock = iter([0.0, *[1.0, 10_000.0] * 100])
    went = []
    plain = batch.answers
    monkeypatch.setattr(batch, "answers", lambda images, provider, fast, *a, **k: went.append(fast) or plain(images, provider, True, *a, **k))
    config = RunConfig(input_dir=str(folder / "in"), output_path=str(folder / "out.csv"), budget_s=2300.0)
    batch.run(spark, Recorder, config, waves=4, now=lambda: next(clock))
    assert len(went) == 4 and went[0] is False and True in went and went[-1] in (False, True) and False in went[1:]


def test_sweep_opens_the_sample_alone(spark, folder):
    files = spark.createDataFrame([(f"{folder}/in/sound.png",), (f"{folder}/in/whole.png",)], "path string").withColumn("path", F.concat(F.lit("file:"), "path"))
    got = imaging.size_sweep(files, Recorder, sides=(60, 1000), qualities=(88,), encode=lambda image, q: bytes(image.shape[0])).collect()
    assert {(r["side"], r["mean_bytes"], r["total_bytes"]) for r in got} == {(60, 40.0, 80.0), (1000, 80.0, 160.0)}


def test_jpeg_takes_the_first_that_fits(monkeypatch):
    monkeypatch.setattr(imaging, "_jpeg", lambda image, q: bytes(q))
    image = np.zeros((2, 2, 3), np.uint8)
    assert [imaging.jpeg_within(image, most)[1] for most in (100, 90, 86, 10)] == [92, 88, 85, 75]
