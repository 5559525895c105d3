"""Near copies by word shingles: all pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Two layers. First the SimHash of the 5-word shingles: fingerprints within ``simhash.RADIUS`` bits are linked by BK-trees
(``simhash.links``), and what they link is checked by the exact similarity. That joins copies and most near copies at the
cost of a row each. Pairs of similarity 0.8 can lie up to 17 bits apart, though, where a BK-tree over 64 bits prunes
nothing and shards by whole blocks do not reach; so the rest comes from an exact set join, over the texts that are not in
one component yet. A set of ``n`` shingles (XXH64) has a prefix, its first ``n - ceil(0.8 n) + 1`` in one order of all
shingles; two sets of similarity 0.8 share a shingle of their prefixes, whatever the order is. The order here is by hash,
with the shingles that a sample shows often at the end, where prefixes seldom reach.

How it scales. Equal sets are merged first, so copies never meet. Prefixes meet by shingle, except for the few shingles
that a thousandth of all rows share, whose rows stay apart (``_crowded``). Of up to ``SMALL`` sets that
share one, all pairs are candidates; of more, a few leading sets against all. Those leave the group, and a next round
takes many more leading sets against those that are not in one component with them yet, until no group is left: a large group
of near copies costs a row per member and round, not all pairs. The first shingle that two such sets share stands among the
first ``n - ceil(8 n / 9) + 1`` of the smaller one, so only these call for its partners. A candidate is compared by size and
by parities: counters of shingles modulo two, about as many as shingles, differ in at most as many places as the sets do.
What passes is compared by all its shingles. None of this loses a pair. Nothing that grows with the rows comes to the driver (of the sample, at most ``OFTEN`` shingles do).

Defined cases: null text and text without words have the empty set and are alike. Text of fewer words than a shingle is
one shingle. Null ids, repeated rows and extra columns are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
SMALL, LEADERS, CROWD = 32, 2, 500
SAMPLE, OFTEN = 10_000, 50_000
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 17
SKETCH = 1 << 20
PAIRS = 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle values, sorted."""
    return np.unique(simhash.shingle_values(text, SHINGLE))


MADE = "doc_id long, text_hash long, root long, n long, bits binary, fp long, prefix array<long>"


def prefix(own: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    n = len(own)
    if not n:
        return own
    order = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        order = np.where(often[at] == own, rank[at], 0)
    return own[np.lexsort((own, order))[: n - (4 * n + 4) // 5 + 1]]


def calls(n: int) -> int:
    """How many shingles of the order can be the first that a set has in common with one as large or larger."""
    return n - (8 * n + 8) // 9 + 1


def parities(own: np.ndarray) -> bytes:
    bits = min(max(LEAST_BITS, 1 << len(own).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            if len(own := shingles(text.as_py())):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["token"])


def _often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the distinct texts shows often, and their place in the order. Any answer is right; a good
    one keeps groups small."""
    share = max(1, docs.count() // SAMPLE)
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    rows = rows.transform(common.in_arrow, _values, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").orderBy(F.desc("n"), "token").limit(OFTEN)
    found = rows.collect()
    often = np.array([r["token"] for r in found], dtype=np.int64).view(np.uint64)
    rank = np.array([r["n"] for r in found], dtype=np.int64)
    order = np.argsort(often)
    return often[order], rank[order]


def _sets(often: np.ndarray, rank: np.ndarray):
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                every = [simhash.shingle_values(x.as_py(), SHINGLE) for x in batch.column(2)]
                prints = np.array([simhash.of_values(x) for x in every], np.uint64).view(np.int64)
                own = [np.unique(x) for x in every]
                ids = np.array([xxh64_intdigest(s.tobytes(), 42) if len(s) else 0 for s in own], dtype=np.uint64).view(np.int64)
                firsts = [prefix(s, often, rank).view(np.int64) for s in own]
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64)))
                made = [batch.column(0), batch.column(1), pa.array(ids), pa.array([len(s) for s in own], pa.int64()), pa.array([parities(s) for s in own], pa.binary()), pa.array(prints), firsts]
                yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in MADE.split(", ")])

    return run


def _meeting(leaders: int, small: int):
    """From rows ``token, node, n, comp``, sorted: candidates ``(null, a, b)``, and what is left of large groups ``(token,
    node, n)``. ``n`` is twice the size, one more where the shingle calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(token, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if token is None else pa.array(token), pa.array(a), pa.array(b)], names=["token", "a", "b"])

        def pairs(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            m, n = rows[2][i], rows[2][j]
            good = (rows[3][i] != rows[3][j]) & (5 * (np.minimum(m, n) >> 1) >= 4 * (np.maximum(m, n) >> 1)) & (np.minimum(m, n) & 1 == 1)
            if good.any():
                x, y = rows[1][i[good]], rows[1][j[good]]
                yield out(None, np.minimum(x, y), np.maximum(x, y))

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            size = np.diff(np.r_[starts, rows.shape[1]])
            few = np.repeat((size > 1) & (size <= small), size)
            some = rows[:, few]
            for d in range(1, small):
                i = np.flatnonzero(some[0][d:] == some[0][:-d])
                if not len(i):
                    break
                yield from pairs(some, i, i + d)
            for start, m in zip(starts[size > small], size[size > small], strict=True):
                group = rows[:, start : start + m]
                if (group[3] == group[3][0]).all():
                    continue
                for k in range(min(leaders, m - 1)):
                    for lo in range(k + 1, m, PAIRS):
                        j = np.arange(lo, min(lo + PAIRS, m))
                        yield from pairs(group, np.full(len(j), k), j)
                if m - leaders > 1:
                    yield out(group[0][leaders:], group[1][leaders:], group[2][leaders:])

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(4)]))
            size += batch.num_rows
            if size < 200_000:
                continue
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last group may go on
            if cut:
                yield from solve(rows[:, :cut])
            held, size = [rows[:, cut:]], 0
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield from solve(rows)

    return run


def _near_parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``a, b, n_a, n_b, bits_a, bits_b``: the pairs whose parities do not tell them apart. Of two lengths the
    longer is folded to the shorter."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.array(batch.column(k).to_pylist(), object) for k in (4, 5))
        size = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)])
        apart = np.zeros(len(x), np.int64)
        for m, n in np.unique(size, axis=0):
            rows = np.flatnonzero((size == (m, n)).all(axis=1))
            a, b = np.frombuffer(b"".join(x[rows]), np.uint8), np.frombuffer(b"".join(y[rows]), np.uint8)
            short = min(m, n)
            a, b = (np.bitwise_xor.reduce(v.reshape(len(rows), -1, short), axis=1) for v in (a, b))
            apart[rows] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        yield batch.select([0, 1]).filter(pa.array(9 * apart <= batch.column(2).to_numpy() + batch.column(3).to_numpy()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())], names=["root", "own"])


def _near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that a thousandth of a block's prefixes hold, with their number there, and (null) the block's size. A
    shingle with more than two thousandths of all is reported with more than one, so the sums find it."""
    held, size = [], 0

    def report() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > max(1, size // common.HOT_SHARE)
        return pa.RecordBatch.from_arrays([pa.array([*token[often].tolist(), None], pa.int64()), pa.array([*n[often].tolist(), size], pa.int64())], names=["token", "k"])

    for batch in batches:
        held.append(np.asarray(batch.column(0).flatten()))
        size += len(held[-1])
        if size >= SKETCH:
            yield report()
            held, size = [], 0
    if size:
        yield report()


def _verified(pairs: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` of sets whose similarity is 0.8 or more, as a written table."""
    parts = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = pairs.where("a <> b").distinct()
    for k in ("a", "b"):
        near = near.join(bits.select(F.col("root").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")), k)
    near = common.stash(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").transform(common.in_arrow, _near_parities, "a long, b long").transform(common.gathered), "near-parities")
    ends = near.select(F.explode(F.array("a", "b")).alias("root")).distinct().join(bits.select("root", "text_hash"), "root")
    ends = texts.join(common.stash(ends, "ends"), "text_hash").dropDuplicates(["root"]).select("root", "text")
    ends = common.stash(ends.transform(common.in_arrow, _whole, "root long, own binary"), "whole-sets")
    near = near.join(ends.select(F.col("root").alias("a"), F.col("own").alias("own_a")), "a")
    near = near.repartition(parts, "b").join(ends.select(F.col("root").alias("b"), F.col("own").alias("own_b")), "b")
    return common.stash(near.select("a", "b", "own_a", "own_b").transform(common.in_arrow, _near_sets, "a long, b long").transform(common.gathered), "links")


def _by_fingerprint(bits: DataFrame, radius: int) -> DataFrame:
    """Candidates from the BK-trees: every set with the least set of its fingerprint, and the least sets of linked
    fingerprints."""
    least = common.stash(bits.groupBy("fp").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    tied = simhash.links(least.select("fp"), radius)
    same = common.join_named(bits.select("fp", "root"), least, "fp", bits.count()).select(F.col("least").alias("a"), F.col("root").alias("b"))
    for k in ("a", "b"):
        tied = tied.join(least.select(F.col("fp").alias(k), F.col("least").alias(f"set_{k}")), k)
    return same.union(tied.select(F.least("set_a", "set_b"), F.greatest("set_a", "set_b")))


def _crowded(counts: DataFrame, total: int, least: int) -> DataFrame:
    """Shingles that more than a thousandth of the rows (and ``least``) share, fewer than a thousand, as a written table."""
    return common.stash(counts.where(F.col("k") > max(total // common.HOT_SHARE, least)).select("token"), "crowded")


def _apart(rows: DataFrame, crowded: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows of crowded shingles: candidates of some leading sets of each with all others, and the rows ``(token,
    node, n)`` without these leaders. The rows of such a shingle never meet in one task; its leaders, found by partial
    sums, go to them. A shingle whose sets are all of one component is done."""
    here = rows.join(F.broadcast(crowded), "token")
    lead = here.groupBy("token", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("place")).agg(F.min(F.struct("node", "n", "comp")).alias("x"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    lead = lead.groupBy("token").agg(F.collect_list("x").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("token", "lead")
    lead = common.stash(lead, "leaders")
    met = rows.join(F.broadcast(lead), "token")
    size = lambda c: F.shiftright(c, 1)
    less, more = F.least("n", "x.n"), F.greatest("n", "x.n")
    pairs = met.withColumn("x", F.explode("lead")).where((F.col("comp") != F.col("x.comp")) & (5 * size(less) >= 4 * size(more)) & (less % 2 == 1))
    return pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")), met.where(~F.array_contains("lead.node", F.col("node"))).select("token", "node", "n")


def near_copies(docs: DataFrame, small: int = SMALL, radius: int = simhash.RADIUS, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash`` and ``root``, which names its component."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    made = common.stash(rows.transform(common.in_arrow, _sets(*_often(docs)), MADE), "shingle-sets")
    bits = made.groupBy("root").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("rows"))
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    bits = common.stash(bits, "distinct-sets")
    roots = simhash.components(_verified(_by_fingerprint(bits, radius), bits, texts))
    known = lambda df: df.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    sets = known(made.select(F.col("root").alias("node"), "n", "prefix").dropDuplicates(["node"]))
    shared = lambda i: F.col("n") * 2 + (i < F.col("n") - F.floor((F.col("n") * 8 + 8) / 9) + 1).cast("int")
    open_ = sets.select(F.explode(F.transform("prefix", lambda t, i: F.struct(t.alias("token"), shared(i).cast("long").alias("n")))).alias("t"), "node", "comp").select("t.token", "node", "t.n", "comp")
    seen = made.select("prefix").transform(common.in_arrow, _frequent, "token long, k long").groupBy("token").agg(F.sum("k").alias("k"))
    seen, leaders = common.stash(seen, "frequent"), LEADERS
    counts, total = seen.where("token is not null"), (seen.where("token is null").first() or {"k": 0})["k"]
    while True:
        crowded = _crowded(counts, total, crowd)
        pairs, left = _apart(open_, crowded, leaders)
        rest = open_.join(F.broadcast(crowded), "token", "left_anti").select("token", "node", "n", "comp")
        rest = rest.repartition(parts, "token").sortWithinPartitions("token", "node")
        met = common.stash(rest.transform(common.in_arrow, _meeting(leaders, small), "token long, a long, b long").transform(common.gathered), "candidates")
        found = _verified(met.where("token is null").select("a", "b").union(pairs), bits, texts)
        if not found.isEmpty():
            roots = simhash.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
        left = left.union(met.where("token is not null").select("token", "a", "b"))
        open_ = common.stash(known(left).select("token", "node", "n", "comp"), "open")
        total = open_.count()
        if not total:
            break
        counts = open_.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
        leaders *= 32
    of = bits.select(F.col("root").alias("node"), F.col("rows").alias("n")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n")
    of = common.stash(of, "set-roots")
    return common.join_named(made.select("doc_id", "text_hash", F.col("root").alias("node")), of, "node", made.count()).select("doc_id", "text_hash", "root")
