"""Hierarchical multi-length packing of token streams.

Documents go to context tiers (2048, 1024, 512, 256 by default) by their length: whole windows of the longest tier are
cut off first, the rest goes to the shortest tier that holds it. Each tier is packed, longest first; a window's gap is
filled with whole pieces of shorter tiers and, last, with a cut of one piece, so every window is full. What a task has
left at its end (less than one long window) is cut into runs whose lengths are powers of two, which need no padding.
Sequences of a tier are dealt out to step groups of an equal number of tokens over all tasks.

Each task packs the rows of its own split, so texts are never shuffled; only counts by task and tier are.

Defined cases: null text packs as empty, i.e. as the end token alone. Null ids and repeated rows are packed row by row.
An empty table gives no rows. Columns other than the id and the text are ignored. A document of any length is packed
whole; its windows are emitted as they are cut.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import ByteBpe, default_paths

TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_TOKENS = 64 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, tier_index long, part long"


class Packer:
    """Packs pieces ``(doc, start, ids)`` into full windows; yields ``(size, pieces)``."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, hold: int = 256):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pools: list[deque] = [deque() for _ in self.tiers]
        self.held, self.hold = 0, hold * self.tiers[0]

    def _route(self, piece, first: bool = False) -> None:
        n = len(piece[2])
        at = max(i for i, t in enumerate(self.tiers) if t >= n)
        (self.pools[at].appendleft if first else self.pools[at].append)(piece)

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        top, n = self.tiers[0], len(ids)
        for s in range(0, n - n % top, top):
            yield top, [(doc, s, ids[s : s + top])]
        if n % top:
            self._route((doc, n - n % top, ids[n - n % top :].copy()))
            self.held += n % top
        if self.held > self.hold:
            yield from self._pack()

    def _pack(self) -> Iterator[tuple[int, list]]:
        for i, size in enumerate(self.tiers):
            while self.pools[i]:
                window = [self.pools[i].popleft()]
                gap = size - len(window[0][2])
                for pool in self.pools[i + 1 :]:
                    while gap and pool and len(pool[0][2]) <= gap:
                        window.append(pool.popleft())
                        gap -= len(window[-1][2])
                while gap and (pool := next((p for p in self.pools[i:][::-1] if p), None)):
                    doc, start, ids = pool.popleft()
                    window.append((doc, start, ids[:gap]))
                    if len(ids) > gap:
                        self._route((doc, start + gap, ids[gap:]), first=True)
                    gap -= len(window[-1][2])
                if gap:  # no piece is left anywhere: the window waits for more
                    self.held = 0
                    for piece in window:
                        self._route(piece)
                        self.held += len(piece[2])
                    return
                yield size, window
        self.held = 0

    def finish(self) -> Iterator[tuple[int, list]]:
        yield from self._pack()
        rest = deque(p for pool in self.pools for p in pool)
        left = sum(len(p[2]) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, gap = [], size
            while gap:
                doc, start, ids = rest.popleft()
                window.append((doc, start, ids[:gap]))
                if len(ids) > gap:
                    rest.appendleft((doc, start + gap, ids[gap:]))
                gap -= len(window[-1][2])
            left -= size
            yield size, window


def _packed(json_path: str, ranks_path: str | None, tiers: tuple[int, ...], end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe, packer, made = ByteBpe.held(json_path, ranks_path), Packer(tiers), {}
        rows: list[tuple] = []
        base = part << 32
        total = 0

        def keep(sequences) -> None:
            nonlocal total
            for size, window in sequences:
                index, offset = made.get(size, 0), 0
                made[size] = index + 1
                for (doc_id, doc_tokens), start, ids in window:
                    row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, base + total, offset, size, index, part)
                    rows.append((*row, ids) if with_ids else row)
                    offset += len(ids)
                total += 1

        def out() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[: len(names)]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[-1]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py())
                ids.append(end_id)
                keep(packer.add((doc_id, len(ids)), np.array(ids, dtype="<u4")))
                if len(rows) >= 5000:
                    yield out()
        keep(packer.finish())
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer_json: str | None = None, ranks: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence; ``with_ids`` adds the ids."""
    if tokenizer_json is None:
        tokenizer_json, ranks = default_paths()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(common.in_arrow, _packed(tokenizer_json, ranks, tuple(tiers), end_id, with_ids), SCHEMA + ", ids array<int>" * with_ids)


def balance(pieces: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Deal the sequences of each tier out to step groups of ``group_tokens`` tokens over all tasks; only the last group
    of a tier is smaller. ``pieces`` must be a written table: it is read twice. What is joined has a row per task and
    tier."""
    counts = pieces.where("offset = 0").groupBy("part", "tier").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tier").orderBy("part")) - F.col("n")).drop("n")
    per_group = F.greatest(F.lit(1), F.floor(F.lit(group_tokens) / F.col("tier")))
    return pieces.join(before, ["part", "tier"]).withColumn("step_group", F.floor((F.col("before") + F.col("tier_index")) / per_group).cast("long")).drop("before", "tier_index", "part")


def packed(docs: DataFrame, group_tokens: int = GROUP_TOKENS, **how) -> DataFrame:
    """Pieces with their step group."""
    done = balance(common.stash(pack(docs, **how), "pieces"), group_tokens)
    first = [c.split()[0] for c in SCHEMA.split(", ")][:7]
    return done.select(*first, "tier", "step_group", *(["ids"] if how.get("with_ids") else []))
