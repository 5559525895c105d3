"""Written tables that cut lineage, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes to every executor at once: so many rows and bytes of what they are found by, at most.
SENT_ROWS, SENT_BYTES = 200_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="labeldates-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than there are cores; else as it is, without a shuffle.

    For row-wise work that takes far longer than its rows take to move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stash(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, by: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``f`` adds to its distinct values of ``by``, each value worked out once.

    For row-wise work that takes far longer than finding a value again. ``f`` keeps the columns ``by`` and gives a row for
    each row. What it gives is written and joined back: sent to every executor while it is small, else by a shuffle.
    ``df`` is computed twice, so it has to be cheap and the same each time; a table that is not is stashed first.
    """
    session = df.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    found = stash(f(df.select(*by).distinct().repartition(tasks, *by)), "once")
    taken = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in by), F.lit(0))
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(taken), F.lit(0)).alias("bytes")).first()
    found = found.withColumnsRenamed({c: f"__by_{c}" for c in by})
    if size["n"] <= SENT_ROWS and size["bytes"] <= SENT_BYTES:
        found = F.broadcast(found)
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return df.join(found, same).drop(*[f"__by_{c}" for c in by])
