"""Label texts as a stream: reading is stateless by row, so the batch columns serve as they are; the best answer per image
is kept by merging each micro-batch into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Policy
from ..operators import cascade
from ..operators.layers import read_dates, submission

TEXTS = "image_id string, stage int, text string, from_crop boolean"


def source(spark: SparkSession, folder: str, schema: str = TEXTS, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def answers(texts: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return read_dates(texts, crop="from_crop", policy=policy).select("image_id", "stage", "answer")


def start(texts: DataFrame, out: str, checkpoint: str, policy: Policy = DEFAULT) -> StreamingQuery:
    """Append every micro-batch's answers under its own batch folder; a batch that is run again overwrites its folder, so
    each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return answers(texts, policy).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The submission over all batches so far."""
    rows = spark.read.parquet(out).drop("batch")
    return submission(cascade.best_answers(rows))


def answers_by_window(texts: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours", policy: Policy = DEFAULT) -> DataFrame:
    """Answered and unanswered texts by event-time window; rows later than the watermark are dropped by it."""
    read = read_dates(texts.withWatermark(time, late), policy=policy)
    return read.groupBy(F.window(time, length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("answer").isNotNull().cast("long")).alias("answered")).select("w.start", "w.end", "n", "answered")
