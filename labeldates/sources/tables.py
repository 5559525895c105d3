"""CSV and JSON tables, submissions, incremental registers, configuration."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import NONE
from ..functions.textnorm import padded
from ..operators.geometry import detector_line, normalized_box

SUBMISSION = ("image_id", "year", "month", "day", "final_date")
LABELS = ("image_id", "year", "month", "day", "final_date", "status", "term", "notation_raw", *(f"tag_{t}" for t in ("dot", "engrave", "curved", "lowcontrast", "multidate", "lotconfuse", "relative", "reference", "ymonly", "foreign", "unreadable")), "notes")
META = ("image_id", "src_file", "group_id", "category", "print_type", "surface", "capture_note", "source", "collected_by", "collected_at", "orig_w", "orig_h", "orig_exif_orientation", "orig_bytes", "out_w", "out_h", "out_bytes")
CASES = ("case_id", "image_id", "input_text", "expect_year", "expect_month", "expect_day", "expect_final_date", "note")
BOXES = "labeler string, items array<struct<filename:string,boxes:array<struct<cls:string,x1:double,y1:double,x2:double,y2:double>>>>"


def strings(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All columns as strings, a byte-order mark dropped, quoted line breaks kept. Without ``columns`` those of the
    header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    table = (reader.schema(strings(columns)) if columns else reader).csv(path)
    return table if columns else table.toDF(*[c.removeprefix("﻿") for c in table.columns])


def blank_for_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def typed_meta(meta: DataFrame) -> DataFrame:
    return meta.withColumns({c: F.col(c).try_cast("long") for c in ("orig_w", "orig_h", "orig_bytes", "out_w", "out_h", "out_bytes")})


def with_update_time(labels: DataFrame, column: str = "updatedAt") -> DataFrame:
    """Epoch milliseconds in text as a timestamp."""
    return labels.withColumn(column, F.timestamp_millis(F.col(column).try_cast("long")))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = SUBMISSION, one_file: bool = False) -> None:
    """The named columns as UTF-8 without a byte-order mark, empty text for null. ``one_file`` is for small results."""
    out = df.select(*columns)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def complete_submission(ids: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for every image, ``NONE`` in all fields where it has no answer."""
    rows = ids.select("image_id").join(answers.select(*SUBMISSION), "image_id", "left")
    return rows.select("image_id", *[F.coalesce(F.col(c), F.lit(NONE)).alias(c) for c in SUBMISSION[1:]])


def answer_rate(submission: DataFrame) -> DataFrame:
    return submission.agg(F.avg((F.col("final_date") != NONE).cast("double")).alias("answer_rate"), F.count(F.lit(1)).alias("n"))


def appended(register: DataFrame, found: DataFrame, key: str = "src_file", prefix: str = "cust_", width: int = 4) -> DataFrame:
    """Rows of ``found`` that the register does not have, with the ids that follow its largest one, in order of ``key``.

    Numbers come from counts by range of the key, so no task has to hold all new rows: ranges are numbered by what lies
    before them, rows inside their range.
    """
    fresh = found.join(register.select(key), key, "left_anti")
    number = F.regexp_extract("image_id", "^" + re.escape(prefix) + "([0-9]+)$", 1).try_cast("long")
    last = register.agg(F.coalesce(F.max(number), F.lit(0)).alias("last")).first()["last"]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = fresh.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id())
    own = Window.partitionBy("__p").orderBy(key)
    numbered = ranged.withColumn("__i", F.row_number().over(own))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row per range
    ident = F.lit(last) + F.col("__b") + F.col("__i")
    return numbered.join(before, "__p").withColumn("image_id", F.concat(F.lit(prefix), F.lpad(ident.cast("string"), F.greatest(F.lit(width), F.length(ident.cast("string"))), F.lit("0")))).select("image_id", *[c for c in found.columns if c != "image_id"])


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box labels in JSON, one row per box: ``labeler, image_id, filename, cls, x1, y1, x2, y2``."""
    raw = spark.read.schema(BOXES).option("multiLine", True).json(path)
    items = raw.select("labeler", F.explode_outer("items").alias("i"))
    stem = F.regexp_replace(F.col("i.filename"), r"(?<=.)\.[^.]*$", "")
    return items.select("labeler", stem.alias("image_id"), F.col("i.filename").alias("filename"), F.explode_outer("i.boxes").alias("b")).select("labeler", "image_id", "filename", "b.*")


def detector_labels(boxes: DataFrame, sizes: DataFrame, classes: Column) -> DataFrame:
    """A detector's label files: ``image_id`` and its text, a line per box that has an area inside the image.

    ``classes`` maps a class name to its number. An image without such a box has an empty text.
    """
    rows = boxes.join(sizes.select("image_id", "w", "h"), "image_id")
    line = detector_line(F.try_element_at(classes, F.col("cls")), normalized_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("w"), F.col("h")))
    return rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def absolute_model_paths(config: str, base: str) -> str:
    """A recognizer's YAML with each relative ``model_path`` made absolute where the file is there."""

    def fix(m: re.Match) -> str:
        there = Path(base, m[2].strip().strip("\"'"))
        return f"{m[1]}{there.resolve()}" if there.exists() else m[0]

    return re.sub(r"(?m)^(\s*model_path:\s*)(\./\S+)", fix, config)


def write_absolute_config(path: str) -> str | None:
    """A temporary copy of such a file; None if there is no file."""
    import tempfile

    source = Path(path)
    if not source.exists():
        return None
    with tempfile.NamedTemporaryFile("w", suffix=".yaml", delete=False, encoding="utf-8") as out:
        out.write(absolute_model_paths(source.read_text("utf-8"), str(source.parent)))
    return out.name


def padded_ids(df: DataFrame, column: str = "image_id") -> DataFrame:
    return df.withColumn(column, padded(F.col(column), 6))
