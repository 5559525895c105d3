"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, and each segment is known by its mean and deviation. For two segments of length L,

    |a - b|^2 >= L (mean_a - mean_b)^2 + L (dev_a - dev_b)^2,

summed over segments: a lower bound of the distance, which doubling the number of segments can only raise. As
2 <a, b> = |a|^2 + |b|^2 - |a - b|^2 and |a|^2 = L sum(mean^2 + dev^2), the same statistics bound the inner product from
above by sum L (mean_a mean_b + dev_a dev_b). A query without a k-th score yet first gets the exact scores of its
best-bounded candidates. Candidates whose bound at a coarse level stays under a query's k-th best score are dropped; the
rest go to the next finer level, and the survivors get their exact score, by falling bound. Bounds are widened by their
rounding error, so nothing that could count is lost.

How it scales. Queries are sent out in rounds of at most ``ROUND_BYTES`` (checked by their components before any is
collected); each round is one scan of the candidates without a shuffle, in which every task keeps k rows for a query.
Only these are shuffled.

Defined cases: vectors that are null or hold null or non-finite components take no part; neither do rows without an
id. Two vectors are compared if they have the same length (none of length zero scores but 0). Rows with a query's own
id are never its candidates; repeated rows are candidates each by itself; a repeated query is answered once. Extra
columns are ignored. Scores are whole numbers as far as 63 bits reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 5
LEVELS = (2, 8, 32)
ROUND_BYTES = 32_000_000
PAIRS = 1 << 18
SCHEMA = "query_id long, query_no long, vec_id long, score long"
LEAST = np.iinfo(np.int64).min


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product is the bound: of each segment sqrt(L) mean and sqrt(L) deviation."""
    n, d = x.shape
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1) if d else np.zeros((n, 0))
    mean = total / size
    dev = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1), 0)) if d else total
    return np.concatenate([mean * np.sqrt(size), dev], axis=1)


class Search:
    """The best k of all candidates seen so far, for queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, levels: tuple[int, ...] = LEVELS):
        self.ids, self.x, self.k = ids, vectors, k
        self.levels = [s for s in levels if s < vectors.shape[1]]
        self.stats = [statistics(vectors, s) for s in self.levels]
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.score = np.full((len(ids), k), LEAST, np.int64)
        self.vec = np.zeros((len(ids), k), np.int64)
        self.count = np.zeros(len(ids), np.int64)
        self.compared = self.pairs = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # at equal scores the smaller id comes first
        ids, y = ids[order], vectors[order]
        stats = [statistics(y, s) for s in self.levels]
        norm = np.sqrt((y**2).sum(axis=1))
        step = max(1, 2_000_000 // max(len(ids), 1))
        for at in range(0, len(self.ids), step):
            rows = slice(at, min(at + step, len(self.ids)))
            self.pairs += (rows.stop - rows.start) * len(ids)
            slack = 1e-9 * (1 + self.norm[rows, None] * norm.max(initial=0))
            alive = ids[None] != self.ids[rows, None]
            if self.levels:
                self._seed(rows, ids, y, self.stats[-1][rows] @ stats[-1].T, alive)
            bound = None
            for mine, theirs in zip(self.stats, stats, strict=True):
                least = self._least(rows)
                if alive.mean() > 0.25:
                    bound = mine[rows] @ theirs.T + slack
                    alive &= bound >= least[:, None]
                else:
                    q, c = np.nonzero(alive)
                    found = np.concatenate([np.einsum("ij,ij->i", mine[rows][q[i : i + PAIRS]], theirs[c[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)] + [np.empty(0)]) + slack[q, 0]
                    alive[q, c] = found >= least[q]
                    bound = np.full(alive.shape, -np.inf)
                    bound[q, c] = found
            self._survivors(rows, ids, y, alive, bound)

    def _least(self, rows: slice) -> np.ndarray:
        """The score that a candidate must reach to count."""
        return np.where(self.count[rows] >= self.k, self.score[rows, -1], LEAST).astype(float)

    def _seed(self, rows: slice, ids: np.ndarray, y: np.ndarray, bound: np.ndarray, alive: np.ndarray) -> None:
        """Exact scores of the best-bounded candidates of queries that have no k-th score yet, so that bounds can prune."""
        new = np.flatnonzero(self.count[rows] < self.k)
        if not len(new) or not len(ids):
            return
        bound = np.where(alive[new], bound[new], -np.inf)
        n = min(4 * self.k, len(ids))
        best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        q, c = np.repeat(new, n), best.ravel()
        q, c = q[alive[q, c]], c[alive[q, c]]
        alive[q, c] = False
        self._exact(rows, ids, y, q, c)

    def _survivors(self, rows: slice, ids: np.ndarray, y: np.ndarray, alive: np.ndarray, bound: np.ndarray | None) -> None:
        """Exact scores of what is left, by falling bound: the best of each query first, then those that still reach."""
        if bound is not None and len(ids) > 64:
            top = np.argpartition(-np.where(alive, bound, -np.inf), 63, axis=1)[:, :64]
            q, c = np.repeat(np.arange(len(alive)), 64), top.ravel()
            q, c = q[alive[q, c]], c[alive[q, c]]
            self._exact(rows, ids, y, q, c)
            alive[q, c] = False
            alive &= bound >= self._least(rows)[:, None]
        self._exact(rows, ids, y, *np.nonzero(alive))

    def _exact(self, rows: slice, ids: np.ndarray, y: np.ndarray, q: np.ndarray, c: np.ndarray) -> None:
        """Score the pairs (query of ``rows``, candidate) and keep the k best of each query."""
        n = rows.stop - rows.start
        self.compared += len(q)
        for i in range(0, len(q), PAIRS):
            self._keep(rows, n, q[i : i + PAIRS], ids[c[i : i + PAIRS]], self._products(self.x[rows][q[i : i + PAIRS]], y[c[i : i + PAIRS]]))

    def _keep(self, rows: slice, n: int, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        good = score >= np.where(self.count[rows] >= self.k, self.score[rows, -1], LEAST)[q]
        q, vec, score = q[good], vec[good], score[good]
        if not len(q):
            return
        has = np.arange(self.k) < self.count[rows][:, None]
        q = np.r_[np.nonzero(has)[0], q]
        score = np.r_[self.score[rows][has], score]
        vec = np.r_[self.vec[rows][has], vec]
        order = np.lexsort((vec, ~score, q))  # ~x turns the order of whole numbers round without overflow
        q, score, vec = q[order], score[order], vec[order]
        first = np.searchsorted(q, np.arange(n), "left")
        rank = np.arange(len(q)) - first[q]
        best = rank < self.k
        self.score[rows.start + q[best], rank[best]] = score[best]
        self.vec[rows.start + q[best], rank[best]] = vec[best]
        self.count[rows] = np.bincount(q[best], minlength=n)

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        safe = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53
        a, b = (a, b) if safe else (a.astype(np.int64), b.astype(np.int64))
        return np.einsum("ij,ij->i", a, b).astype(np.int64)


def _vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids, and components as whole numbers floor(256 x)."""
    sizes = np.where(np.asarray(column.is_null()), -1, np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    values = np.asarray(flat.fill_null(np.nan), dtype=float)
    out = {}
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    with_id = ~np.asarray(ids.is_null())
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero((sizes == size) & with_id)
        x = values[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(x).all(axis=1)
        out[int(size)] = np.asarray(ids.take(pa.array(rows[fine])), dtype=np.int64), np.floor(256 * x[fine])
    return out


def _searching(queries, k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {size: (no, Search(ids, x, k, levels)) for size, (ids, no, x) in queries.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for size, (ids, x) in _vectors(part.column(0), part.column(1)).items():
                    if size in found and len(ids):
                        found[size][1].add(ids, x)
        for no, s in found.values():
            has = np.arange(k) < s.count[:, None]
            rows = np.nonzero(has)[0]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (s.ids[rows], no[rows], s.vec[has], s.score[has])], names=["query_id", "query_no", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, levels: tuple[int, ...] = LEVELS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates (``vec_id``, ``embedding``) of highest inner product."""
    spark = queries.sparkSession
    shape = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked, rows = shape(queries).where("vec_id is not null and embedding is not null").distinct(), shape(candidates)
    volume = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 24), F.lit(0)).alias("n")).first()["n"]
    rounds = -(-volume // round_bytes) or 1
    parts = []
    for i in range(rounds):
        chunk = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rounds)) == i).orderBy("vec_id", "embedding").toArrow()
        held, no = {}, 0
        for batch in chunk.to_batches():
            for size, (ids, x) in _vectors(batch.column(0), batch.column(1)).items():
                held.setdefault(size, []).append((ids, np.arange(no, no + len(ids)), x))
                no += len(ids)
        sent = spark.sparkContext.broadcast({s: tuple(np.concatenate(c) for c in zip(*v, strict=True)) for s, v in held.items()})
        found = rows.mapInArrow(_searching(sent, k, levels), SCHEMA)
        order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if rounds > 1:  # written at once, so that one round's queries are held at a time
            best = common.stash(best, "top-k")
            sent.destroy()
        parts.append(best)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
