"""Rules that label tables must keep, each a column; and what a table is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, DONE, NONE, ON_HOLD, Policy
from ..functions.dates import days_in_month

TAG_VALUES = ("TRUE", "FALSE", "", "1", "0", "true", "false")
STATUSES = (DONE, ON_HOLD)


def trimmed(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def is_none(v: Column) -> Column:
    return F.upper(v) == NONE


def _whole(v: Column) -> Column:
    return F.when(v.rlike(r"^[0-9]{1,9}$"), v.try_cast("int"))


def joined(y: Column, m: Column, d: Column) -> Column:
    """What the full date must be for its fields."""
    part = lambda v: F.when(v == "", F.lit(NONE)).otherwise(v)
    return F.when(is_none(y) & is_none(m) & is_none(d), F.lit(NONE)).otherwise(F.concat_ws("-", part(y), part(m), part(d)))


def row_rules(labels: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """``image_id, severity, rule, detail``: one row per broken rule of a row. No shuffle.

    An empty row is only noted. A row on hold has its status checked and no more.
    """
    y, m, d, full, status = (trimmed(c) for c in ("year", "month", "day", "final_date", "status"))
    tags = [c for c in labels.columns if c.startswith("tag_")]
    empty = (y == "") & (m == "") & (d == "") & (full == "") & (status == "")
    held = status == ON_HOLD
    yi, mi, di = _whole(y), _whole(m), _whole(d)
    two = lambda v: is_none(v) | v.rlike("^[0-9]{2}$")
    year_for_days = F.when(yi > 0, yi).otherwise(2024)
    open_row = ~empty & ~held
    rule = lambda when, severity, name, detail: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), detail.alias("detail")))
    checks = [
        rule(empty, "warn", "empty_row", F.lit("")),
        rule(~empty & ~status.isin(*STATUSES), "error", "status", status),
        rule(open_row & ~(is_none(y) | y.rlike("^[0-9]{4}$")), "error", "year_format", y), rule(open_row & ~two(m), "error", "month_format", m), rule(open_row & ~two(d), "error", "day_format", d),
        rule(open_row & mi.isNotNull() & ~mi.between(1, 12), "error", "month_range", m), rule(open_row & di.isNotNull() & ~di.between(1, 31), "error", "day_range", d),
        rule(open_row & di.between(1, 31) & mi.between(1, 12) & (di > days_in_month(year_for_days, mi)), "error", "no_such_day", F.concat_ws("-", y, m, d)),
        rule(open_row & yi.isNotNull() & ~yi.between(policy.year_min, policy.year_max), "warn", "year_range", y),
        rule(open_row & (full != joined(y, m, d)), "error", "final_date", full),
        *[rule(open_row & ~trimmed(t).isin(*TAG_VALUES), "error", "tag_value", F.concat(F.lit(f"{t}="), trimmed(t))) for t in tags],
        rule(open_row & (F.upper(trimmed("tag_ymonly")) == "TRUE") & ~is_none(d), "error", "ymonly_with_day", d) if "tag_ymonly" in tags else None,
        rule(open_row & ~is_none(d) & is_none(m), "warn", "day_without_month", d),
        rule(open_row & (trimmed("notation_raw") == "") & ~is_none(y), "warn", "no_notation", y) if "notation_raw" in labels.columns else None,
    ]
    found = F.filter(F.array(*[c for c in checks if c is not None]), lambda x: x.isNotNull())
    return labels.select(trimmed("image_id").alias("image_id"), F.explode(found).alias("f")).select("image_id", "f.severity", "f.rule", "f.detail")


def duplicates(rows: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.groupBy(trimmed(key).alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_and_ghosts(labels: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Images without a label row (``missing``) and label rows without an image (``ghost``), each id once."""
    a, b = labels.select(trimmed(key).alias(key)).distinct(), images.select(trimmed(key).alias(key)).distinct()
    return b.join(a, key, "left_anti").withColumn("rule", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("rule", F.lit("ghost")))


def check_labels(labels: DataFrame, images: DataFrame | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """All findings of a label table."""
    found = row_rules(labels, policy)
    found = found.unionByName(duplicates(labels).select("image_id", F.lit("error").alias("severity"), F.lit("duplicate_id").alias("rule"), F.col("n").cast("string").alias("detail")))
    if images is not None:
        found = found.unionByName(missing_and_ghosts(labels, images).select("image_id", F.lit("error").alias("severity"), "rule", F.lit("").alias("detail")))
    return found


def has_errors(findings: DataFrame) -> bool:
    """Whether a run over these findings fails."""
    return not findings.where("severity = 'error'").isEmpty()


def check_cases(cases: DataFrame) -> DataFrame:
    """Parser cases without a text, or whose full date is not what its fields say."""
    y, m, d = (trimmed(f"expect_{c}") for c in ("year", "month", "day"))
    checks = F.array(F.when(trimmed("input_text") == "", F.lit("empty_text")), F.when(trimmed("expect_final_date") != joined(y, m, d), F.lit("final_date")))
    return cases.select("case_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))


def value_counts(rows: DataFrame, columns: list[str], blank: str = "(미기입)") -> DataFrame:
    """``column, value, n`` of several columns in one pass, the most frequent first; equal counts by value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(trimmed(c) == "", F.lit(blank)).otherwise(trimmed(c)).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n")).orderBy("column", F.desc("n"), "value")


def group_count(meta: DataFrame) -> DataFrame:
    """Products photographed: distinct group ids, the image's own where it has none."""
    key = F.when(F.coalesce(F.col("group_id"), F.lit("")) == "", F.col("image_id")).otherwise(F.col("group_id"))
    return meta.agg(F.countDistinct(key).alias("groups"))


def tag_summary(labels: DataFrame) -> DataFrame:
    """Rows of each tag, rows that are done without a tag, and rows that are done without year and month."""
    tags = [c for c in labels.columns if c.startswith("tag_")]
    on = lambda t: F.coalesce(F.upper(F.col(t)) == "TRUE", F.lit(False))
    ready = F.coalesce(F.col("status") == DONE, F.lit(False))
    bare = ready
    for t in tags:
        bare = bare & ~on(t)
    none = ready & is_none(trimmed("year")) & is_none(trimmed("month"))
    count = lambda c: F.sum(c.cast("long"))
    return labels.agg(count(ready).alias("done"), count(bare).alias("plain"), count(none).alias("unreadable"), *[count(on(t)).alias(t) for t in tags])
