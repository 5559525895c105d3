"""Which stage's answer an image gets.

Stages run from cheap to dear; a complete answer that looks sound ends the run. As a relation: rank all answers and take
the first. Where later stages cost more than a join, ``run_stages`` computes each only for what is still open; both give
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Policy
from ..lineage import stash
from .layers import read_dates

# number, name, whether it reads a date region
STAGES = ((1, "crop", True), (2, "crop+pp", True), (3, "crop+dot", True), (4, "crop+nodet", True), (5, "fallback", False), (6, "full+pp", False))


def stages(fast: bool = False, fallback: bool = True) -> tuple[int, ...]:
    """Fast runs read the crop alone; without fallback the whole image is not read."""
    return (1,) if fast else tuple(n for n, _, crop in STAGES if crop or fallback)


def filled(answer: Column) -> Column:
    """How many of year, month and day an answer has."""
    return sum((answer[k].isNotNull().cast("int") for k in ("m", "d")), answer["y"].isNotNull().cast("int"))


def is_weak(answer: Column) -> Column:
    """A complete answer with signs of lost digits: letters had to be repaired, or its print has fewer digits for month
    and day than they take."""
    raw = F.coalesce(answer["raw"], F.lit(""))
    digits = F.length(F.regexp_replace(raw, r"(?U)\D", ""))
    year = F.when(raw.rlike(r"(?U)\d{4}"), 4).otherwise(2)
    need = F.when(raw.rlike("[A-Za-z]{3}"), 2).otherwise(4)
    return answer["via"].eqNullSafe("ocr_normalized") | ((F.length(raw) > 0) & (digits - year < need))


def rank(answer: Column) -> Column:
    """0 complete and sound, 1 complete and weak, 2 partial, null nothing."""
    n = filled(answer)
    return F.when(n == 3, F.when(is_weak(answer), 1).otherwise(0)).when(n > 0, 2)


def best_answers(answers: DataFrame, key: str = "image_id", stage: str = "stage", answer: str = "answer", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per image with any answer: sound before weak before partial; partial ones by what they fill; then the
    earlier stage. One shuffle by image, reduced on the map side. ``keep`` names further columns of the best row."""
    r = rank(F.col(answer))
    order = F.struct(r.alias("rank"), F.when(r == 2, -filled(F.col(answer))).otherwise(0).alias("less"), F.col(stage).alias("stage"))
    best = answers.where(r.isNotNull()).groupBy(key).agg(F.min_by(F.struct(F.col(stage).alias("stage"), F.col(answer).alias("answer"), r.alias("rank"), *keep), order).alias("b"))
    return best.select(key, F.col("b.stage").alias(stage), F.col("b.answer").alias(answer), (F.col("b.rank") == 1).alias("weak"), *[F.col(f"b.{c}") for c in keep])


def every_image(ids: DataFrame, best: DataFrame, key: str = "image_id") -> DataFrame:
    """All images, those without an answer too."""
    return ids.select(key).join(best, key, "left")


def run_stages(ids: DataFrame, texts: Callable[[DataFrame, int], DataFrame], order: tuple[int, ...] = stages(), key: str = "image_id", policy: Policy = DEFAULT, go_on: Callable[[int], bool] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stage by stage, each only for images without a sound answer so far.

    ``texts(open, stage)`` gives ``key, text`` of the open images. ``go_on(stage)``, asked before each stage past the
    first, may end the run (a deadline). Each round is a written table, so no stage is computed twice and a lost executor
    costs its own files only.
    """
    crops = {n: crop for n, _, crop in STAGES}
    open_, done = ids.select(key), None
    for stage in order:
        if done is not None and go_on is not None and not go_on(stage):
            break
        read = read_dates(texts(open_, stage), crop=crops.get(stage, False), policy=policy).select(key, F.lit(stage).alias("stage"), "answer", *keep)
        read = stash(read, f"stage-{stage}")
        done = read if done is None else done.unionByName(read)
        open_ = stash(open_.join(read.where(rank(F.col("answer")) == 0).select(key).distinct(), key, "left_anti"), "open")
        if open_.isEmpty():
            break
    return best_answers(done, key, keep=keep)


def regions(detections: DataFrame, key: str = "image_id") -> DataFrame:
    """The boxes to crop: the two surest of class ``full``, else one around all of ``date`` and ``due``."""
    surest = Window.partitionBy(key).orderBy(F.desc("conf"), "x1", "y1", "x2", "y2")
    full = detections.where("cls = 'full'").withColumn("n", F.row_number().over(surest)).where("n <= 2").select(key, "n", "x1", "y1", "x2", "y2")
    rest = detections.where("cls in ('date', 'due')").join(full.select(key).distinct(), key, "left_anti")
    union = rest.groupBy(key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return full.unionByName(union.withColumn("n", F.lit(1)))


def deadline(budget_s: float, started: Callable[[], float], now: Callable[[], float], total: int) -> Callable[[int], bool]:
    """Whether to go fast: after ten images, what the rest would take at this pace, and a minute, passes the budget."""

    def fast(done: int) -> bool:
        if done < 10:
            return False
        spent = now() - started()
        return spent + (total - done) * (spent / done) + 60 > budget_s

    return fast


def labels_of_stages(answers: DataFrame, text: str | None = None) -> DataFrame:
    """The answers with their stage's name, weak ones marked, and at most 300 characters of text: for looking at."""
    names = F.create_map(*[F.lit(x) for n, name, _ in STAGES for x in (n, name)])
    route = F.concat(F.coalesce(F.try_element_at(names, F.col("stage")), F.lit("none")), F.when(F.col("weak"), F.lit("(weak)")).otherwise(F.lit("")))
    out = answers.withColumn("route", F.when(F.col("stage").isNull(), "none").otherwise(route))
    return out.withColumn("text", F.substring(text, 1, 300)) if text else out
