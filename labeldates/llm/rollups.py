"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so a change of the corpus is a signed row: an insert
adds a document's counts, a delete takes them away, a revision takes the old away and adds the new. A batch of changes
is summed by key on the executors and written as one small table; the totals are the sum over all committed batches.

Commits are idempotent. A batch is written to a folder of its own and then renamed to its id; only a renamed folder
counts, and a batch whose id is there already changes nothing. A driver or executor that is lost in between leaves only
a folder that no reader looks at. This needs a store whose rename of a folder is atomic and fails where the name is taken
or moves the folder inside (HDFS, a local disk, NFS); on a plain object store a commit must go through a table format.

``compact`` folds the last compacted table and all batches after it into the next one, with the ids of all that it holds.
Its commit is likewise a rename, to the next number: of two that run at once one wins and the other's work is thrown
away. Only the highest number counts, so no batch is ever added twice.

Defined cases: null source or language is a key of its own. Null text has zero tokens and counts as a document. Null
counts and signs add nothing. Repeated rows count as often as they stand there. An empty batch commits and adds
nothing. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import ByteBpe, default_paths

KEY = ("source", "lang", "tokenizer_version")
SUMS = ("docs", "tokens", "chars")
TOTALS = "source string, lang string, tokenizer_version string, docs long, tokens long, chars long"


def _counting(json_path: str, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.held(json_path, ranks_path)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(bpe.ids(t)) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "source", "lang", "tokens", "chars"])

    return run


def token_counts(docs: DataFrame, version: str, tokenizer_json: str | None = None, ranks: str | None = None) -> DataFrame:
    """Counts of every document under a tokenizer version."""
    if tokenizer_json is None:
        tokenizer_json, ranks = default_paths()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.transform(common.in_arrow, _counting(tokenizer_json, ranks), "doc_id long, source string, lang string, tokens long, chars long").withColumn("tokenizer_version", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Committed batches under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        return sorted(n for s in self._fs.listStatus(self._at(self.path)) if (n := s.getPath().getName()).startswith(f"{kind}="))

    def _compacted(self) -> tuple[str | None, set[str]]:
        """The compacted table that counts, and the ids of the batches in it."""
        names = self._names("compact")
        if not names:
            return None, set()
        return names[-1], {r["batch"] for r in self.spark.read.parquet(f"{self.path}/{names[-1]}/batches").collect()}

    def committed(self) -> set[str]:
        """Ids of all batches that count, compacted ones too."""
        return {n.split("=", 1)[1] for n in self._names("batch")} | self._compacted()[1]

    def _publish(self, working: str, name: str) -> bool:
        """The rename is the commit; of two at once one wins."""
        done = not self._fs.exists(self._at(f"{self.path}/{name}")) and self._fs.rename(self._at(working), self._at(f"{self.path}/{name}"))
        if not done or self._fs.exists(self._at(f"{self.path}/{name}/{working.rsplit('/', 1)[1]}")):
            self._fs.delete(self._at(f"{self.path}/{name}/{working.rsplit('/', 1)[1]}"), True)
            self._fs.delete(self._at(working), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if the batch was there already."""
        import uuid

        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id is made of letters, digits, _, . and -")
        if batch in self.committed():
            return False
        signed = lambda value: F.coalesce(F.sum(F.col("sign") * value), F.lit(0)).cast("long")
        summed = changes.groupBy(*KEY).agg(signed(F.lit(1)).alias("docs"), signed(F.col("tokens")).alias("tokens"), signed(F.col("chars")).alias("chars"))
        working = f"{self.path}/_working-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at(self.path))
        summed.write.parquet(working)
        return self._publish(working, f"batch={batch}")

    def _parts(self) -> tuple[str | None, set[str], list[str]]:
        """The compacted table, the ids in it, and the ids of the batches beside it."""
        single = [n.split("=", 1)[1] for n in self._names("batch")]  # listed first: what is folded meanwhile is in both
        last, inside = self._compacted()
        return last, inside, [b for b in single if b not in inside]

    def _sum(self, last: str | None, single: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in single] + ([f"{self.path}/{last}/sums"] if last else [])
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        """Keys with any documents, tokens or characters, after all committed batches."""
        last, _, single = self._parts()
        return self._sum(last, single).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self, name: str) -> bool:
        """Fold the compacted table and all batches beside it into a new one; False if there is nothing to fold, ``name``
        was used for the last one, or another ``compact`` was first. What was folded goes after the commit."""
        import uuid

        last, inside, single = self._parts()
        number = int(last.split("=", 1)[1]) + 1 if last else 1
        used = last is not None and self.spark.read.parquet(f"{self.path}/{last}/name").first()["name"] == name
        if not single or used:
            return False
        working = f"{self.path}/_working-{uuid.uuid4().hex}"
        self._sum(last, single).write.parquet(f"{working}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(inside | set(single))], "batch string").write.parquet(f"{working}/batches")
        self.spark.createDataFrame([(name,)], "name string").write.parquet(f"{working}/name")
        done = self._publish(working, f"compact={number:010d}")
        if done:
            for n in [f"batch={b}" for b in single] + ([last] if last else []):
                self._fs.delete(self._at(f"{self.path}/{n}"), True)
        return done
