"""Splits, selections and near-duplicate exclusion.

Orders are by a seeded hash of the id: the same on every run and partitioning, and computed where the rows are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.textnorm import padded

NEAR_BITS = 20


def place(key: Column, seed: int) -> Column:
    return F.xxhash64(key.cast("string"), F.lit(seed))


def split(rows: DataFrame, stratum: str, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``rows`` with ``part``: of each stratum ``max(1, round(n * share))`` rows are ``val``, the others ``train``.

    Needs a total order inside a stratum; strata are few and can be large, so ranks come from counts by hash range: each
    row's rank is the number of rows in lower ranges plus its rank in its own, and no range holds a stratum.
    """
    ranges = 1024
    h = place(F.col(key), seed)
    ranged = rows.withColumns({"__h": h, "__r": F.shiftrightunsigned(h, 54).cast("int")})
    counts = ranged.groupBy(stratum, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumns({
        "__before": F.sum("__n").over(Window.partitionBy(stratum).orderBy("__r")) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy(stratum)),
    }).select(F.col(stratum).alias("__s"), F.col("__r").alias("__r2"), "__before", "__all")
    assert ranges == 1 << 10
    own = ranged.withColumn("__i", F.row_number().over(Window.partitionBy(stratum, "__r").orderBy("__h", key)))
    rank = own.join(before, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__r") == F.col("__r2")))
    take = F.greatest(F.lit(1), F.bround(F.col("__all") * share, 0))
    return rank.withColumn("part", F.when(F.col("__before") + F.col("__i") <= take, "val").otherwise("train")).select(*rows.columns, "part")


def take(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows that come first in the seeded order, numbered."""
    picked = rows.withColumn("__h", place(F.col(key), seed)).orderBy("__h", key).limit(n)
    return picked.withColumn("order", F.row_number().over(Window.orderBy("__h", key))).drop("__h")


def manifest_hash(rows: DataFrame, key: str = "image_id", order: str = "order", digits: int = 64) -> DataFrame:
    """SHA-256 of a selection's ids, in order, joined by commas. A selection is a few hundred rows."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(key).cast("string").alias("id")))), lambda x: x["id"])
    return rows.agg(F.substring(F.sha2(F.array_join(ids, ","), 256), 1, digits).alias("manifest"), F.count(F.lit(1)).alias("n"))


def unused(pool: DataFrame, used: DataFrame, key: str = "image_id") -> DataFrame:
    """Pool ids that were never used, ids padded."""
    ids = lambda df: df.select(padded(F.col(key), 6).alias(key)).distinct()
    return ids(pool).join(ids(used), key, "left_anti")


def present(pool: DataFrame, files: DataFrame, key: str = "image_id") -> DataFrame:
    ids = lambda df: df.select(padded(F.col(key), 6).alias(key)).distinct()
    return ids(pool).join(ids(files), key, "left_semi")


#: Rows of a block, and the comparisons that are held at once.
BLOCK, HELD = 8192, 1 << 17


def _blocks(rows: DataFrame, side: str, key: str, n: int, words: int) -> DataFrame:
    """``rows`` dealt into ``n`` blocks by their ids: a row per block with ids in order and the words of their hashes."""
    whole = rows.select(F.col(key).alias("id"), F.slice("h", 1, words).alias("h")).where((F.size("h") == words) & ~F.exists("h", lambda w: w.isNull()))
    dealt = whole.distinct().groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{side}_block")).agg(F.array_sort(F.collect_list(F.struct("id", "h"))).alias("rows"))
    return dealt.select(f"{side}_block", F.col("rows.id").alias(f"{side}_ids"), F.flatten("rows.h").alias(f"{side}_words"))


def _compare(most: int, words: int, nearest: bool, schema):
    """Two blocks a row, every hash of one against every of the other; a batch of pairs for each group of hashes."""

    def compared(batches):
        import numpy as np
        import pyarrow as pa

        hashes = lambda column, i: np.asarray(column[i].values).astype(np.int64, copy=False).view(np.uint64).reshape(-1, words)
        for batch in batches:
            of = {n: batch.column(n) for n in ("left_ids", "left_words", "right_ids", "right_words")}
            for i in range(batch.num_rows):
                left_ids, right_ids = of["left_ids"][i].values, of["right_ids"][i].values
                left, right = hashes(of["left_words"], i), np.ascontiguousarray(hashes(of["right_words"], i).T)
                step = max(1, HELD // right.shape[1])
                for at in range(0, len(left), step):
                    part = left[at : at + step]
                    bits = np.bitwise_count(part[:, :1] ^ right[0])
                    for w in range(1, words):
                        bits = np.add(bits, np.bitwise_count(part[:, w : w + 1] ^ right[w]), dtype=np.uint16)
                    if nearest:  # the first of equal ones: ids are in order
                        best = bits.argmin(axis=1)
                        a = np.flatnonzero(bits[np.arange(len(part)), best] <= most)
                        b = best[a]
                    else:
                        a, b = np.nonzero(bits <= most)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([left_ids.take(pa.array(a + at)), right_ids.take(pa.array(b)), pa.array(bits[a, b].astype(np.int32))], schema=schema)

    return compared


def _near(left: DataFrame, right: DataFrame, most: int, bits: int, key: str, nearest: bool) -> DataFrame:
    """Pairs of hashes within ``most`` bits, or for each left one and block the nearest.

    Every hash is compared with every other: at such distances an index by bands leaves much of all pairs (for 64 bits and
    12, two fifths) and makes a row of each. Here a comparison is a few machine instructions and only what is near becomes a
    row. Blocks have a fixed size, so a task holds two of them, however many rows or equal hashes there are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    words = bits // 64
    n, m = (max(1, -(-side.count() // BLOCK)) for side in (left, right))
    a = _blocks(left, "left", key, n, words).withColumn("right_block", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = _blocks(right, "right", key, m, words).withColumn("left_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks = min(n * m, 16 * left.sparkSession.sparkContext.defaultParallelism)
    deal = lambda df: df.repartition(tasks, "left_block", "right_block")
    schema = StructType([StructField("left_id", left.schema[key].dataType), StructField("right_id", right.schema[key].dataType), StructField("distance", IntegerType())])
    both = deal(a).join(deal(b).hint("merge"), ["left_block", "right_block"]).select("left_ids", "left_words", "right_ids", "right_words")
    return both.mapInArrow(_compare(most, words, nearest, to_arrow_schema(schema)), schema)


def near_pairs(left: DataFrame, right: DataFrame, most: int = NEAR_BITS, bits: int = 256, key: str = "image_id") -> DataFrame:
    """Pairs of hashes (``h: array<bigint>``, ``bits`` a whole number of words) within ``most`` bits, each once:
    ``left_id, right_id, distance``."""
    return _near(left, right, most, bits, key, False).distinct()


def far_from(pool: DataFrame, used: DataFrame, most: int = NEAR_BITS, bits: int = 256, key: str = "image_id") -> DataFrame:
    """Pool rows whose hash is near to none of the used ones."""
    near = _near(pool, used, most, bits, key, True).select(F.col("left_id").alias(key)).distinct()
    return pool.join(near, key, "left_anti")


def nearest_used(pool: DataFrame, used: DataFrame, most: int = NEAR_BITS, bits: int = 256, key: str = "image_id") -> DataFrame:
    """For each pool row that is near to a used one, the nearest and its distance."""
    return _near(pool, used, most, bits, key, True).groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("m")).select(F.col("left_id").alias(key), F.col("m.right_id").alias("near_id"), F.col("m.distance").alias("distance"))


def accepted_in_order(pool: DataFrame, n: int, most: int = NEAR_BITS, bits: int = 256, key: str = "image_id", seed: int = 42) -> list:
    """Ids accepted one after the other in the seeded order, each far from all accepted before it, until there are ``n``.

    Whether a row is accepted depends on those before it, so the walk itself is sequential. It runs over the near pairs
    of the pool alone, in blocks of ids from the front of the order: a row without near neighbours is accepted as it
    comes. The driver holds one block, its pairs, and at most ``n`` accepted ids.
    """
    ordered = pool.select(key, "h", place(F.col(key), seed).alias("__h"))
    accepted: list = []
    block, low = max(4 * n, 1000), None
    while len(accepted) < n:
        rest = ordered if low is None else ordered.where((F.col("__h") > low[0]) | ((F.col("__h") == low[0]) & (F.col(key) > low[1])))
        front = rest.orderBy("__h", key).limit(block).collect()
        if not front:
            break
        low = (front[-1]["__h"], front[-1][key])
        seen = [(r[key], [w & (2**64 - 1) for w in r["h"]]) for r in front]
        for ident, h in seen:
            if all(sum((a ^ b).bit_count() for a, b in zip(h, other, strict=True)) > most for _, other in accepted):
                accepted.append((ident, h))
                if len(accepted) == n:
                    break
    return [ident for ident, _ in accepted]


def minimum_pairs(effect: float) -> int:
    """Pairs that show a difference of ``effect`` points at 80 % power."""
    return math.ceil((2.8016 * 26.1 / effect) ** 2)
