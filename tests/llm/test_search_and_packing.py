import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from labeldates.llm import packing, topk
from labeldates.llm.tokens import ByteBpe, default_paths


def brute(rows, queries, k=5):
    vec = {}
    for i, (ident, x) in enumerate(rows):
        if ident is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            vec[i] = (ident, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x])
    out = []
    for q, x in {(i, tuple(v)) for i, v in vec.values() if i in queries}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), ident) for ident, y in vec.values() if ident != q and len(y) == len(x))
        out += [(q, r + 1, ident, -s) for r, (s, ident) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 64).round(3).tolist()) for i in range(300)] + [(300 + i, [0.5] * 64) for i in range(40)] + [(400, None), (401, [1.0, float("nan")]), (402, [1.0, None]), (None, [0.1] * 64), (403, []), (450, []), (404, [2.0, 3.0]), (500, [1.0, 1.0]), (299, [0.25] * 64)]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute(rows, {i for i in range(0, 1000, 50)})
    for parts, budget in ((1, 10**9), (7, 2000)):
        got = topk.top_k(df.where("vec_id % 50 = 0"), df.repartition(parts), round_bytes=budget)
        assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df.where("vec_id = 0"), df.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.cumsum(rng.normal(0, 0.2, (500, 64)), axis=1))
    exact = x @ x.T
    last = None
    for s in (1, 2, 8, 32, 64):
        f = topk.statistics(x, s)
        bound = f @ f.T
        assert (bound >= exact - 1e-6 * np.abs(bound)).all()
        assert last is None or (bound <= last + 1e-6 * np.abs(last)).all()  # finer is never looser
        last = bound
    search = topk.Search(np.arange(20), x[:20])
    for a in range(0, 500, 50):
        search.add(np.arange(a, a + 50), x[a : a + 50])
    assert search.compared < 20 * 500  # some candidates never got an exact score


def test_tokens_agree_with_the_library():
    from tokenizers import Tokenizer

    json_path, ranks = default_paths()
    bpe, plain = ByteBpe(json_path, ranks), Tokenizer.from_file(json_path)
    rng = random.Random(2)
    pieces = ["the", " ", "  ", "\n", "\t", "'s", "É", "ñ", "ß", "12", "!!", "\x85", "\xa0", "\x1c", "ǅ", "&&&", "don't", "\r\n", "漢字", "😀", "<|endoftext|>", "ー", "ɐ"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert bpe.ids(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert bpe.ids(None) == []


def check_packing(pieces, texts, bpe):
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*bpe.ids(t), 1])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, wanted in want.items():
        ids = wanted[0]
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == sum(map(len, wanted))
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # nothing is padded
        assert {p["tier"] for p in own} == {at}
    return by_seq


def test_packing(spark, documents):
    bpe = ByteBpe(*default_paths())
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    pieces = packing.packed(documents).collect()
    check_packing(pieces, texts, bpe)
    assert packing.packed(documents.limit(0)).count() == 0
    rng = random.Random(3)
    many = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "xyzzy"]) for _ in range(int(rng.paretovariate(0.8) * 20) % 5000))) for i in range(400)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    made = packing.packed(df, group_tokens=4 * 2048).collect()
    by_seq = check_packing(made, many, bpe)
    groups = {}
    for own in by_seq.values():
        groups.setdefault((own[0]["tier"], own[0]["step_group"]), []).append(own)
    for tier in packing.TIERS:
        sizes = sorted(len(v) for (t, _), v in groups.items() if t == tier)
        assert all(n == 4 * 2048 // tier for n in sizes[1:])  # all but one group of a tier are full


def test_pieces_carry_their_ids(spark, documents):
    rows = packing.pack(documents.where("doc_id = 1"), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
