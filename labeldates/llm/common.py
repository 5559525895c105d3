"""Shared plumbing: table reads, the shared folder of the cluster, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE, HOT_LEAST = 1000, 100
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Only where a local session has none (tests, a notebook) a temporary folder is made and kept as the session's
    setting; on a cluster it must be set, since a folder of one machine is not seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in as few partitions as its size asks for (the adaptive plan decides), before it is written. A step that runs
    in many tasks and returns few rows would else leave a small file of each, and on a local file system an executor starts
    a process of its own for every file and folder it makes."""
    return df.hint("rebalance")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and what a lost executor had is
    still there for the others."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of a few megabytes, however long the texts are: task and Python worker both hold a batch,
    and by default it may have 64 MB. The size is the session's setting from then on, as the plan reads it when it runs;
    one that is set already stays. A row is never cut: a longer text is a batch of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def join_named(rows: DataFrame, named: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` with ``named``, which has a row per key and in ``n`` how many of ``total`` rows have it.

    Keys that more than a thousandth of the rows (and ``HOT_LEAST``) share are fewer than a thousand, whatever the input:
    their rows stay where they are and ``named`` comes to them; only the rows of other keys are shuffled. So no task
    gets more than a thousandth of the rows for one key.
    """
    cold = F.col("n") <= F.lit(max(total // HOT_SHARE, HOT_LEAST))
    hot = named.where(~cold).drop("n")
    if hot.isEmpty():
        return rows.join(named.drop("n"), key, how)
    here = rows.join(F.broadcast(hot), key)
    away = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.where(cold).drop("n"), key, how)
    return here.unionByName(away)
