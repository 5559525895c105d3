"""The functions that a caller of a plain library would look for, over a session."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Policy
from .functions import dates
from .operators import choose
from .operators.layers import read_dates, submission

FIELDS = ("year", "month", "day", "final_date")


def extract_expiry_fields(spark: SparkSession, text: str | None, rescue: bool = True, from_crop: bool = False, policy: Policy = DEFAULT) -> dict[str, str]:
    """One text's four fields, and how they were read (``_kind``, ``_raw``, ``_via``) where that is known. For many texts
    use ``extract_many`` or, on a table, ``read_dates``."""
    return extract_many(spark, [text], rescue, from_crop, policy)[0]


def extract_many(spark: SparkSession, texts: Iterable[str | None], rescue: bool = True, from_crop: bool = False, policy: Policy = DEFAULT) -> list[dict[str, str]]:
    """As many answers as texts, in their order; for lists that a driver holds anyway."""
    held = [(i, t) for i, t in enumerate(texts)]
    read = read_dates(spark.createDataFrame(held, "i int, text string"), crop=from_crop, rescue=rescue, policy=policy)
    shown = dates.text_of(F.col("answer.y"), F.col("answer.m"), F.col("answer.d"))
    rows = read.select("i", "answer", *[c.alias(n) for n, c in zip(FIELDS, shown, strict=True)]).collect()
    out: list[dict[str, str]] = [{} for _ in held]
    for r in rows:
        how = {f"_{k}": r["answer"][k] for k in ("kind", "raw", "via") if r["answer"] is not None and r["answer"][k] is not None}
        out[r["i"]] = {n: r[n] for n in FIELDS} | how
    return out


def explain(spark: SparkSession, text: str, policy: Policy = DEFAULT) -> dict:
    """Candidates with their kinds, the chosen one, and phrases that refer elsewhere, on the normalized text."""
    from .functions import textnorm

    normal = textnorm.repaired(textnorm.aliased(F.col("t")))
    row = spark.createDataFrame([(text,)], "t string").select(normal.alias("t")).select(choose.diagnosis(F.col("t"), policy).alias("e")).first()["e"]
    return row.asDict(recursive=True)


def create_answer_view(table: DataFrame, name: str, text: str = "text", crop: str | bool = False, policy: Policy = DEFAULT) -> None:
    """A temporary view of ``table`` with its answers, for SQL: ``SELECT answer.y, answer.via FROM name``."""
    read_dates(table, text, crop, policy=policy).createOrReplaceTempView(name)


def submission_of(table: DataFrame, key: str = "image_id", text: str = "text", crop: str | bool = False, policy: Policy = DEFAULT) -> DataFrame:
    return submission(read_dates(table, text, crop, policy=policy), key)
