"""SimHash near-duplicates through sharded BK-trees.

A fingerprint has 64 bits; bit ``i`` is set if it is set in more than half of the XXH64 values (seed 42) of the text's
4-word shingles. Texts link when their fingerprints differ in at most ``radius`` bits; components are transitive.

How it scales. Equal fingerprints are merged first (partial aggregation), so copies never meet. The distinct ones are
sharded by pigeonhole: the 64 bits are cut into ``radius + e`` blocks, so two fingerprints within the radius agree on at
least ``e`` whole blocks, and so on the first bits of these; each fingerprint goes to one shard for every choice of
``e`` blocks. How many bits make a shard's key follows the number of distinct fingerprints, so that a tree has about
``TREE`` nodes at every size of the input (``e`` is 1 up to two million fingerprints, then 2, then 3). Each shard is a
BK-tree (children keyed by integer Hamming distance to their parent), built and searched where the shard lies, following
only edges within the radius. A shard emits a spanning set of links, at most one per fingerprint, never all pairs.
Shards of more than ``TILE`` fingerprints are dealt out in tiles; the tree of each meets the fingerprints of every other
in a task of its own. No fingerprint, link or component comes to the driver. For that reason trees of all rows are not
broadcast either: a broadcast goes through the driver, and no bound holds for them.

Components come from large-star / small-star rounds over the links of distinct fingerprints, each round written to the
shared folder. Joins by a fingerprint or component that many rows share go through ``common.join_named``.

Defined cases: null text and text without words have fingerprint zero and link like any other. Null ids never become a
component id unless all ids of a component are null. Repeated rows give repeated result rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
RADIUS, SHINGLE, SEED = 4, 4, 42
TREE, TILE = 64, 4096
FRONTIER = 1_000_000


def shingle_values(text: str | None, size: int) -> np.ndarray:
    """XXH64 of all shingles, repeated ones too."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").translate(LOWER) if text and not text.isascii() else (text or "").lower())
    if not words:
        return np.empty(0, dtype="<u8")
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    return np.fromiter((xxh64_intdigest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles), dtype="<u8", count=len(shingles))


def of_values(h: np.ndarray) -> int:
    """The fingerprint of shingle values."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return of_values(shingle_values(text, size))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(2)], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text by which its row can be found again, and the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.transform(common.in_arrow, _fingerprints, "doc_id long, text_hash long, fp long")


class Forest:
    """One BK-tree per shard, all of a batch built and searched together, level by level, in numpy."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """``fps`` unsigned 64-bit, ``shard`` sorted: equal values make one tree, whose root is its first element."""
        n = len(fps)
        self.fps, self.shard, self.visits = fps, shard, 0
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        self.root = np.repeat(starts, np.diff(np.r_[starts, n]))
        keys, kids = [], []
        todo = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at = self.root[todo]
        while len(todo):
            key = at * 66 + np.bitwise_count(fps[todo] ^ fps[at])
            order = np.argsort(key, kind="stable")
            key, todo = key[order], todo[order]
            first = np.r_[True, key[1:] != key[:-1]]  # the first element with this distance becomes the child, the others go down to it
            keys.append(key[first])
            kids.append(todo[first])
            at = np.repeat(todo[first], np.diff(np.r_[np.flatnonzero(first), len(key)]))[~first]
            todo = todo[~first]
        key = np.concatenate([*keys, np.empty(0, np.int64)])
        self.kids = np.concatenate([*kids, np.empty(0, np.int64)])[np.argsort(key, kind="stable")]
        # children of a node at a distance of at least d begin at begin[66 * node + d]
        self.begin = np.r_[0, np.cumsum(np.bincount(key, minlength=66 * n), dtype=np.int64)]

    def links(self, radius: int, fps: np.ndarray | None = None, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within the radius, in slices of bounded size: of the forest's own elements, or of other ``fps``
        (first of the pair) with the trees at ``root``."""
        own = fps is None
        fps, root = (self.fps, self.root) if own else (fps, root)
        todo = [(np.arange(len(fps)), root)]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            self.visits += len(q)
            d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if own:
                near &= q != node
            if near.any():
                yield q[near], node[near]
            lo = self.begin[node * 66 + np.maximum(d - radius, 0)]
            n = self.begin[node * 66 + np.minimum(d + radius, 64) + 1] - lo
            if (total := int(n.sum())):
                within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                todo.append((np.repeat(q, n), self.kids[np.repeat(lo, n) + within]))


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs in a forest of smallest members, in place."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _spanning(radius: int):
    """From rows ``key, asks, fp``, sorted: in every shard the fingerprints that do not ask make the tree. Those that ask
    are searched in it, or, where none asks, its own elements are."""

    def solve(key: np.ndarray, asks: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        foreign = np.repeat(np.add.reduceat(asks, starts) > 0, size)
        parent = np.arange(len(key))
        mine = np.flatnonzero(~foreign & np.repeat(size > 1, size))
        for a, b in Forest(fp[mine], key[mine]).links(radius):
            merge(parent, mine[a], mine[b])
        tree, query = np.flatnonzero(foreign & (asks == 0)), np.flatnonzero(foreign & (asks == 1))
        query = query[np.isin(key[query], key[tree])]
        if len(query):
            forest = Forest(fp[tree], key[tree])
            for a, b in forest.links(radius, fp[query], np.searchsorted(key[tree], key[query], "left")):
                merge(parent, query[a], tree[b])
        tied = np.flatnonzero(parent != np.arange(len(key)))
        if len(tied):
            return pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[parent[tied]].view(np.int64))], names=["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().view(np.uint64)
            held = [np.r_[a, b] for a, b in zip(held, new, strict=True)]
            if len(held[0]) < 50_000:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last shard may go on
            if cut and (made := solve(*(x[:cut] for x in held))) is not None:
                yield made
            held = [x[cut:] for x in held]
        if len(held[0]) and (made := solve(*held)) is not None:
            yield made

    return run


def scheme(count: int, radius: int, tree: int = TREE) -> tuple[int, int]:
    """How many blocks agree (``e``), and how many bits of each make a key, for trees of about ``tree`` nodes."""
    bits = max(0, (count // tree).bit_length())
    for e in range(1, 64 - radius):
        room = e * (64 // (radius + e))
        if bits <= room + 3 or e == 3:  # up to eight times as large before more copies of each pay
            return e, min(64 // (radius + e), -(-bits // e))
    return 1, min(64 // (radius + 1), bits)


def _shard_keys(fp, radius: int, agreeing: int, width: int):
    """An array of one key for every choice of agreeing blocks: which choice, and the first bits of its blocks."""
    if not width:
        return F.array(F.lit(0).cast("long"))
    count = radius + agreeing
    cuts = [round(i * 64 / count) for i in range(count)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << width) - 1)) for a in cuts]
    keys = []
    for k, chosen in enumerate(combinations(range(count), agreeing)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width) + block[i]
        keys.append(key)
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, tree: int = TREE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that span all components of the relation."""
    agreeing, width = scheme(fps.count(), radius, tree)
    shards = fps.select("fp", F.explode(_shard_keys(F.col("fp"), radius, agreeing, width)).alias("shard"))
    counted = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = counted.where(F.col("n") > tile).select("shard", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = shards.join(large, "shard", "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")))
    # Each tile meets every other tile, and so itself, under the key of the two; the later of the two asks.
    alone = F.array(F.struct(F.xxhash64("shard").alias("key"), F.lit(0).alias("asks")))
    met = F.when(F.col("tile").isNull(), alone).otherwise(F.transform(
        F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1),
        lambda o: F.struct(F.xxhash64(F.col("shard"), F.least(F.col("tile"), o), F.greatest(F.col("tile"), o)).alias("key"), (o < F.col("tile")).cast("int").alias("asks")),
    ))
    keyed = dealt.select(F.explode(met).alias("m"), "fp").select("m.key", "m.asks", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").transform(common.in_arrow, _spanning(radius), "a long, b long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node``, ``root`` (the component's smallest node) for all nodes of the links ``(a, b)``.

    Large-star and small-star rounds until nothing changes; each round is written to the shared folder.
    """
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    edges = common.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen, now = None, state(edges)
    while seen != now:
        seen = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), label)
        large = common.join_named(both.where("v > u"), least, "u", 2 * now["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stash(large.distinct(), label)
        least = common.stash(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), label)
        down = common.join_named(large, least, "u", now["n"])
        edges = common.stash(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        now = state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``fp`` (signed long), ``root`` (fingerprint that names its component) and
    ``component_id`` (smallest ``doc_id`` of the component)."""
    rows = common.stash(fingerprints(docs), "fingerprints")
    fps = common.stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius))
    tied = common.stash(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", F.col("n").alias("rows")), "roots")
    named = common.stash(tied.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "named-roots")
    total = fps.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    of = common.stash(common.join_named(tied, named, "root", total["fps"]).select("fp", "root", "component_id", F.col("rows").alias("n")), "components")
    return common.join_named(rows, of, "fp", total["rows"])


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each component the row of smallest id stays (of its
    smallest text hash, where an id has several texts), once."""
    return first_of_each(docs, near_duplicates(docs, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each ``root`` in ``found`` (``doc_id``, ``text_hash``, ``root``)."""
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    i, none, text, n = (own + c for c in ("id", "none", "text", "n"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.coalesce("k.doc_id", F.lit(0)).alias(i), F.col("k.no_id").alias(none), F.col("k.text_hash").alias(text))
    keys = {i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").cast("long").isNull(), text: F.xxhash64(F.col("text").cast("string"))}
    # Repeated rows become one first (each task keeps one of its own before anything moves); the join then finds its rows
    # where the window has put them, so a text is moved once.
    once = docs.withColumns(keys).withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(text))).where(F.col(n) == 1)
    return once.join(kept, [*keys]).select(*[once[f"`{c}`"] for c in docs.columns])
