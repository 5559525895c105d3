"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared in normal form: lower case, runs of white space as one space. An item of ``m``
characters may occur with up to ``k = max(2, m * rate)`` edits (insertions, deletions, changes of one character). Cut
into ``k + 1`` pieces, at least one piece of such an occurrence is untouched, so every occurrence holds an exact piece
hit; hits are found for all items at once by an Aho-Corasick automaton. Around the hits, windows are verified with
Myers' bit-parallel distance, in which the item's pattern may end anywhere in the window; the start comes from the same
run over the reversed text.

Items are taken in blocks of about ``BLOCK_CHARS`` characters of distinct items (one item at least), which bounds what the
driver and each task hold, whatever the size of the benchmark. A block goes out as a broadcast; where there are several,
each block's pass over the documents is written before the next block is read, so no task ever holds two automata.
Documents are never shuffled.

Items of fewer than ``MIN_CHARS`` characters in normal form are matched without edits and at word boundaries only (with
edits they would match by chance); scripts written without spaces have a boundary at every character.

Defined cases: null texts and items without characters in normal form match nothing. Repeated items or documents give repeated rows. Null ids are carried. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
SPACE = re.compile(r"\s+")
SCHEMA = "doc_id long, item_id long, start long, end long, distance int, item_chars int"


def normal(text: str) -> str:
    return SPACE.sub(" ", text.lower()).strip()


def offsets(text: str) -> np.ndarray:
    """For each character of ``normal(text)``, where it comes from in ``text``."""
    found, space = [], False
    for i, c in enumerate(text):
        if c.isspace():
            space = bool(found)
            continue
        if space:
            found.append(i - 1)
            space = False
        found += [i] * len(c.lower())
    return np.array(found, dtype=np.int64)


def budget(m: int, rate: float = RATE) -> int:
    return max(2, int(m * rate))


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters are of one word."""
    spaced = lambda c: (c.isalnum() or c == "_") and not (c >= "\u2e80" or "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff")
    return spaced(a) and spaced(b)


def stands_alone(text: str, start: int, end: int) -> bool:
    return not (start and _joins(text[start - 1], text[start])) and not (end < len(text) and _joins(text[end - 1], text[end]))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, k: int) -> list[tuple[int, int]]:
    """``(end, distance)`` for all ends in ``text`` at which ``pattern`` ends with at most ``k`` edits, its start free."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, found = full, 0, m, []
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | (~(xv | ph) & full), ph & xv
        if score <= k:
            found.append((j + 1, score))
    return found


def _best_ends(ends: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """From left to right, the best end within ``reach`` of the first that is left; those within ``reach`` after it go."""
    i = 0
    while i < len(ends):
        j = i
        while j < len(ends) and ends[j][0] <= ends[i][0] + reach:
            j += 1
        end, distance = min(ends[i:j], key=lambda x: (x[1], x[0]))
        yield end, distance
        while i < len(ends) and ends[i][0] <= end + reach:
            i += 1


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        import ahocorasick

        self.items = []
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text is None or not (item := normal(text)):
                continue
            k = budget(len(item), rate) if len(item) >= MIN_CHARS else 0
            for start, piece in pieces(item, k):
                at.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item_id, item, k))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """``(item_id, start, end, distance, item_chars)`` in the text's own positions, the best of each place."""
        if not text or not self.items:
            return []
        plain = normal(text)
        windows: dict[int, list[list[int]]] = {}
        found = []
        for end, (size, places) in self.automaton.iter(plain):
            for n, start in places:
                k, m = self.items[n][2], len(self.items[n][1])
                if m < MIN_CHARS:
                    if stands_alone(plain, end + 1 - m, end + 1):
                        found.append((self.items[n][0], end + 1 - m, end + 1, 0, m))
                    continue
                lo, hi = end + 1 - size - start - k, end + 1 - size - start + m + k
                of = windows.setdefault(n, [])
                if of and lo <= of[-1][1] and hi >= of[-1][0]:
                    of[-1] = [min(lo, of[-1][0]), max(hi, of[-1][1])]
                else:
                    of.append([lo, hi])
        for n, of in windows.items():
            item_id, item, k = self.items[n]
            of.sort()
            spans: list[list[int]] = []
            for lo, hi in of:
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                lo, hi = max(lo, 0), min(hi, len(plain))
                if hi - lo < len(item) - k:
                    continue
                window = plain[lo:hi]
                if (at := window.find(item)) >= 0 and len(window) < 2 * len(item):
                    found.append((item_id, lo + at, lo + at + len(item), 0, len(item)))
                    continue
                for end, distance in _best_ends(myers(item, window, k), len(item) // 2):
                    back = myers(item[::-1], window[max(0, end - len(item) - k) : end][::-1], distance)
                    start = end - max(e for e, d in back if d == distance)
                    found.append((item_id, lo + start, lo + end, distance, len(item)))
        if not found:
            return []
        place = offsets(text)
        return sorted(((i, int(place[a]), int(place[b - 1]) + 1, d, m) for i, a, b, d, m in found), key=lambda x: (x[1], x[2], str(x[0])))


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks, and the distinct items of each with their number of rows. The driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = -(-chars // BLOCK_CHARS) or 1
    block = lambda i: rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).orderBy("item_id", "text").collect()
    return count, ([(r["item_id"], r["text"], r["n"]) for r in block(i)] for i in range(count))


def _matching(items, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(k, text) for k, (_, text, _) in enumerate(items.value)], rate)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.int32()] * 2
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, *hit in matcher.find(text.as_py()):
                    item_id, _, n = items.value[k]
                    rows += [(doc_id, item_id, *hit)] * n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per occurrence of an item in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    count, blocks = _blocks(benchmark)
    for items in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(items)
        part = rows.transform(common.in_arrow, _matching(sent, rate), SCHEMA)
        if count > 1:
            part = common.stash(part, "matches")
            sent.destroy()
        found = part if found is None else found.unionAll(part)
    return found


def _clean(items, rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(k, text) for k, (_, text, _) in enumerate(items.value)], rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(text.as_py()) for text in batch.column(at)], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs."""
    count, blocks = _blocks(benchmark)
    for items in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.transform(common.in_arrow, _clean(sent, rate, docs.columns.index("text")), docs.schema)
        if count > 1:
            docs = common.stash(docs, "clean")
            sent.destroy()
    return docs
