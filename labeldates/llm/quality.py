"""Factorisation machine for text quality.

Inputs of a document: its hashed words (binary, scaled to unit length), structure statistics of the text (standardised)
and metadata columns that the caller names (by default the declared length). The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

whose last term is all pairwise interactions in linear time. Labels, language, source and ids are never inputs.

Training reads at most ``sample`` labelled documents (a documented bound; those of smallest hashed id), whose features
are made on the executors; the fit is numpy on the driver, seeded, and its size does not depend on the input. Scoring
reads every whole text in batches; the model (about 1.2 MB) goes out with the task.

Defined cases: null text counts as empty and has a score. Null or other labels than 0 and 1 are not learned from; of
repeated labels of an id the smallest counts, of repeated documents the smallest text. With no labels, or labels of one
kind only, the score is the share of label 1 (0.5 with none). Null ids are scored and not held out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 6000
BUCKETS = 1 << 15
RANK = 8
THRESHOLD = 0.7
STATS = 18


class WordHash(dict):
    """Word to bucket, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    n, m = len(text), len(words)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / max(len(raw), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in ".!?" for x in lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(n), np.log1p(m), n / (m + 1), *kinds, len(counts) / (m + 1), top / (m + 1), pairs / max(m - 1, 1), np.log1p(len(lines)), len(set(lines)) / (len(lines) + 1), ends / (len(lines) + 1),
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / (m + 1), sum(c for w, c in counts.items() if w[-1:] in "*#$%&!") / (m + 1), sum(c for w, c in counts.items() if w.isupper()) / (m + 1),
    ]


_CLASS = np.zeros(256, np.int64)  # 0 other bytes of the ASCII range, 1 lower case, 2 upper case, 3 digits, 4 white space, 5 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 13, 32]], _CLASS[128:] = 1, 2, 3, 4, 5


def features(text: str | None, extra: list, hashed: WordHash) -> tuple[np.ndarray, list[float]]:
    """Distinct buckets of the words, and the dense values."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    meta = [v for x in extra for v in ((float(np.log1p(max(x, 0))) if x is not None else 0.0), float(x is None))]
    return np.unique(np.fromiter((hashed[w] for w in counts), np.int32, len(counts))), structure(text, words, counts) + meta


@dataclass
class Machine:
    w0: float
    w: np.ndarray  # of buckets, then of dense values
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, values: np.ndarray) -> np.ndarray:
        return np.clip((values - self.mean) / self.scale, -4, 4)

    def raw(self, words: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of documents given by their buckets and dense values."""
        if not words:
            return np.empty(0)
        x = self.dense(values)
        lengths = np.array([len(a) for a in words])
        at = np.concatenate(words) if lengths.sum() else np.empty(0, np.int32)
        weight = np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths)
        starts = np.cumsum(lengths) - lengths
        vx = self.v[at] * weight[:, None]
        add = lambda a: np.where((lengths > 0).reshape(-1, *[1] * (a.ndim - 1)), np.add.reduceat(np.concatenate([a, np.zeros((1, *a.shape[1:]))]), np.minimum(starts, len(a)), axis=0), 0)
        vd, wd = self.v[BUCKETS:], self.w[BUCKETS:]
        total = add(vx) + x @ vd
        square = add((vx**2).sum(axis=1)) + (x**2) @ (vd**2).sum(axis=1)
        return self.w0 + add(self.w[at] * weight) + x @ wd + 0.5 * ((total**2).sum(axis=1) - square)

    def score(self, words: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(words, values), -30, 30)))


def fit(words: list[np.ndarray], values: np.ndarray, labels: np.ndarray, rank: int = RANK, rounds: int = 12, step: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Adam on the logistic loss; gradients of only the rows that a batch touches."""
    dims = BUCKETS + values.shape[1] if values.ndim == 2 else BUCKETS
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Machine(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(dims), np.zeros((dims, rank)), np.zeros(dims - BUCKETS), np.ones(dims - BUCKETS))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(dims), rng.normal(0, 0.05, (dims, rank)), values.mean(axis=0), values.std(axis=0) + 1e-6)
    dense = m.dense(values)
    both = np.zeros((dims, rank + 1)), np.zeros((dims, rank + 1))
    bias, t = [0.0, 0.0], 0
    for _ in range(rounds):
        for rows in np.array_split(order := rng.permutation(len(labels)), max(1, len(order) // 128)):
            t += 1
            lengths = np.array([len(words[i]) for i in rows])
            at = np.concatenate([words[i] for i in rows] + [np.empty(0, np.int32)]).astype(np.int64)
            doc = np.repeat(np.arange(len(rows)), lengths)
            k = values.shape[1]
            at = np.r_[at, np.tile(np.arange(BUCKETS, BUCKETS + k), len(rows))]
            doc = np.r_[doc, np.repeat(np.arange(len(rows)), k)]
            x = np.r_[np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths), dense[rows].ravel()]
            vx = m.v[at] * x[:, None]
            total = np.stack([np.bincount(doc, vx[:, f], len(rows)) for f in range(rank)], axis=1)
            raw = m.w0 + np.bincount(doc, m.w[at] * x, len(rows)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(doc, (vx**2).sum(axis=1), len(rows)))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            grad_v = (err[doc] * x)[:, None] * (total[doc] - vx)
            touched, slot = np.unique(at, return_inverse=True)
            g = np.stack([np.bincount(slot, err[doc] * x, len(touched))] + [np.bincount(slot, grad_v[:, f], len(touched)) for f in range(rank)], axis=1)
            g[:, 0] += decay * m.w[touched]
            g[:, 1:] += decay * m.v[touched]
            for held, new, keep in ((both[0], g, 0.9), (both[1], g**2, 0.999)):
                held[touched] = keep * held[touched] + (1 - keep) * new
            move = step * (both[0][touched] / (1 - 0.9**t)) / (np.sqrt(both[1][touched] / (1 - 0.999**t)) + 1e-8)
            m.w[touched] -= move[:, 0]
            m.v[touched] -= move[:, 1:]
            b = float(err.sum())
            bias = [0.9 * bias[0] + 0.1 * b, 0.999 * bias[1] + 0.001 * b * b]
            m.w0 -= step * (bias[0] / (1 - 0.9**t)) / (np.sqrt(bias[1] / (1 - 0.999**t)) + 1e-8)
    return m


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _inputs(docs: DataFrame, meta: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("double").alias(f"meta_{i}") for i, c in enumerate(meta)])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = WordHash()
    for batch in batches:
        meta = [c.to_pylist() for c in batch.columns[2:-1]]
        made = [features(text.as_py(), [m[i] for m in meta], hashed) for i, text in enumerate(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.columns[-1], pa.array([w for w, _ in made], pa.list_(pa.int32())), pa.array([d for _, d in made], pa.list_(pa.float64()))], names=["doc_id", "quality", "words", "dense"])


def train(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` of the labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    count = usable.agg(F.count_distinct("doc_id").alias("n")).first()["n"]
    near = usable.where(place <= F.lit(min(2**63 - 1, int(2**63 * 1.2 * (sample + 100) / max(count, 1))))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = near.orderBy(place, "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    chosen = _inputs(docs, meta).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"), *[F.min(f"meta_{i}").alias(f"meta_{i}") for i in range(len(meta))])
    rows = chosen.select("doc_id", "text", *[f"meta_{i}" for i in range(len(meta))], "quality").transform(common.in_arrow, _featured, "doc_id long, quality int, words array<int>, dense array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    words = [np.asarray(x.values, dtype=np.int32) for x in rows.column("words").combine_chunks()] if rows.num_rows else []
    dense = np.array(rows.column("dense").to_pylist(), dtype=float).reshape(len(words), STATS + 2 * len(meta))
    return fit(words, dense, np.array(rows.column("quality").to_pylist(), dtype=float))


def _scored(model: Machine):
    slim = Machine(model.w0, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                meta = [c.to_pylist() for c in part.columns[2:]]
                made = [features(text.as_py(), [m[i] for m in meta], hashed) for i, text in enumerate(part.column(1))]
                found = slim.score([w for w, _ in made], np.array([d for _, d in made], dtype=float).reshape(len(made), -1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Machine, meta: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    return _inputs(docs, meta).transform(common.in_arrow, _scored(model), "doc_id long, score double")


def _passing(model: Machine, threshold: float, text_at: int, meta_at: list[int]):
    inner = _scored(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [part.column(text_at), part.column(text_at).cast(pa.string()), *[part.column(i).cast(pa.float64()) for i in meta_at]]
                scores = np.concatenate([np.asarray(x.column(1)) for x in inner(iter([pa.RecordBatch.from_arrays(columns, names=list(map(str, range(len(columns)))))]))] + [np.empty(0)])
                yield part.filter(pa.array(scores >= threshold))

    return run


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, meta: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The rows of ``docs``, all columns, that score the threshold at least; no join by id, so repeated ids are safe."""
    at = docs.columns.index
    return docs.transform(common.in_arrow, _passing(model, threshold, at("text"), [at(c) for c in meta]), docs.schema)
