"""The batch run: images to a submission."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, DetectorConfig, Policy, RunConfig
from ..functions import dates
from ..imaging import Provider, detections, stage_texts
from ..lineage import stash
from ..operators import cascade
from ..sources import images as image_source
from ..sources import tables

CROPS = {n: crop for n, _, crop in cascade.STAGES}
DEBUG = ("image_id", "route", "raw", "via", "date", "due", "code", "full", "text", "error")


def answers(images: DataFrame, provider: Callable[[], Provider], fast: bool = False, fallback: bool = True, policy: Policy = DEFAULT, detector: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The best answer per image, with its text. Boxes are found once; later stages open only the images still open."""
    order = cascade.stages(fast, fallback)
    texts = lambda open_, stage: stage_texts(images.join(open_, "image_id", "left_semi"), provider, stage, CROPS[stage], detector)
    return cascade.run_stages(images.select("image_id"), texts, order, policy=policy, keep=("text",))


def submission(ids: DataFrame, best: DataFrame) -> DataFrame:
    y, m, d, full = dates.text_of(F.col("answer")["y"], F.col("answer")["m"], F.col("answer")["d"])
    return tables.complete_submission(ids, best.select("image_id", y.alias("year"), m.alias("month"), d.alias("day"), full.alias("final_date")))


def looked_at(images: DataFrame, best: DataFrame) -> DataFrame:
    """What the debug file says of every image: boxes by class, which stage answered, from what text, or the error."""
    count = lambda c: F.size(F.filter("boxes", lambda b: b["cls"] == c)).alias(c)
    rows = images.select("image_id", *[count(c) for c in ("date", "due", "code", "full")], "error").join(best, "image_id", "left")
    return cascade.labels_of_stages(rows, "text").select("image_id", "route", F.col("answer.raw").alias("raw"), F.col("answer.via").alias("via"), "date", "due", "code", "full", "text", "error")


def run(
    spark: SparkSession, provider: Callable[[], Provider], config: RunConfig = RunConfig(), ids: DataFrame | None = None, fast: bool = False, fallback: bool = True, debug: bool = False,
    detector: DetectorConfig = DetectorConfig(), waves: int = 8, now: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """Scan the folder, answer every image, write the CSV, and return the submission.

    The CSV is written with ``NONE`` for all first, then after every wave of images with the answers so far, so that a run
    that is stopped has left a valid file. Before a wave, what the rest would take at the pace so far decides whether the
    wave goes fast, that is reads crops alone (``cascade.deadline``); a later wave may have time again.
    """
    began = now()
    found = image_source.scan_or_all(spark, config.input_dir, content=False)
    found = image_source.only(found, ids) if ids is not None else found
    found = stash(found.select("image_id", "path", F.pmod(F.xxhash64("path"), F.lit(waves)).alias("wave")), "images")
    sizes = {r["wave"]: r["count"] for r in found.groupBy("wave").count().collect()}  # at most a row a wave
    names = found.select("image_id")
    empty = names.select("image_id", *[F.lit("NONE").alias(c) for c in tables.SUBMISSION[1:]])
    tables.write_csv(empty, config.output_path)
    late = cascade.deadline(config.budget_s, lambda: began, now, sum(sizes.values()))
    best, seen, done, out = None, None, 0, empty
    for wave in sorted(sizes):
        part = found.where(F.col("wave") == wave).select("image_id", "path")
        part = stash(part.join(detections(part, provider, detector), "image_id"), "boxes")
        read = stash(answers(part.where("error is null"), provider, fast or late(done), fallback, detector=detector), "best")
        best, seen = (read, part) if best is None else (best.unionByName(read), seen.unionByName(part))
        done += sizes[wave]
        out = stash(submission(names, best), "submission")
        tables.write_csv(out.orderBy("image_id"), config.output_path)
        if debug:
            tables.write_csv(looked_at(seen, best), config.output_path.replace(".csv", "") + "_debug.csv", DEBUG)
    return out
