import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldates.llm import crf, decontam, pii, quality, rollups, secrets, simhash
from labeldates.llm.common import fresh_path
from labeldates.llm.tokens import ByteBpe, default_paths


# --- near-duplicates

def reference_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hs) * 2 > len(hs)) << b for b in range(64))


def reference_components(fps, radius=4):
    ids, parent = list(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(spark, documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                if c:
                    c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += ["", None, "  \n", "One Two", "one two", "É é", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {i: reference_fingerprint(t) for i, t in enumerate(texts)}
    want = reference_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df.repartition(5)).collect()}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(set(want.values()))
    odd = simhash.near_duplicates(documents).collect()
    assert len(odd) == 9 and {r["component_id"] for r in odd if r["doc_id"] in (2, 3)} == {2}
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None, 5, 6, 7, 8], key=str)
    assert simhash.one_of_each(documents.limit(0)).count() == 0


def test_large_shards_are_tiled(spark):
    """A dense cluster with a tile of a few fingerprints: same components, no more links than fingerprints by shard."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    center = rng.getrandbits(64)
    for _ in range(150):
        fps.add(center ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = reference_components({signed(x): x for x in fps})
    for tile in (7, 4096):
        links = simhash.links(df, tile=tile)
        roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        assert {k: v for k, v in want.items() if k in roots} == roots and all(v == k for k, v in want.items() if k not in roots)


def test_bk_forest_finds_all_pairs():
    rng = np.random.default_rng(6)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in rng.integers(0, 2**63, 20, dtype=np.uint64)]))
    shard = np.sort(rng.integers(0, 5, len(fps)))
    got = {(int(x), int(y)) for a, b in simhash.Forest(fps, shard).links(4) for x, y in zip(a, b, strict=True)}
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (shard[:, None] == shard[None])
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(200, 201), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {i: -40 for i in range(-40, 61)} | {200: 200, 201: 200}


# --- quality

def test_machine_equals_the_double_sum():
    rng = np.random.default_rng(7)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + 3), rng.normal(0, 0.3, (quality.BUCKETS + 3, 4)), np.zeros(3), np.ones(3))
    words, dense = [np.array([3, 9, 77], np.int32), np.array([], np.int32), np.array([5], np.int32)], rng.normal(0, 1, (3, 3))
    got = m.raw(words, dense)
    for k in range(3):
        x = {int(i): 1 / np.sqrt(len(words[k])) for i in words[k]} | {quality.BUCKETS + j: dense[k, j] for j in range(3)}
        want = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
        assert got[k] == pytest.approx(want)


def made_documents(spark, n=400):
    rng = random.Random(8)
    words = ["harbour", "window", "quiet", "morning", "letter", "garden", "stone", "under"]
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))).capitalize() + "."
        rows.append((i, text if good else " ".join(w + rng.choice(["***", "###"]) for w in text.split()), len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, documents):
    docs, labels = made_documents(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).withColumn("out", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").where("out").collect()
    assert len(rows) > 50 and np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) > 0.97
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(7), labels.repartition(3))).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in rows)
    odd = quality.score(documents, model).collect()
    assert len(odd) == 9 and all(0 <= r["score"] <= 1 for r in odd)
    kept = quality.keep_good(documents, model, threshold=0.0)
    assert kept.columns == documents.columns and kept.count() == 9 and quality.keep_good(documents, model, threshold=1.1).count() == 0


def test_labels_are_not_inputs_and_few_labels_do(spark):
    docs, labels = made_documents(spark, 60)
    m = quality.train(docs, labels)
    a = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), m).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    assert a == b
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, flipped).w0 == m.w0  # held-out labels are never learned from
    one = quality.train(docs, labels.withColumn("quality", F.lit(1)))
    assert quality.score(docs, one).first()["score"] > 0.99
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).first()["score"] == pytest.approx(0.5)
    twice = labels.unionByName(labels.withColumn("quality", F.lit(None).cast("int")))
    assert quality.train(docs.unionByName(docs), twice).w0 == pytest.approx(m.w0)


# --- decontamination

def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
        row = new
    return row


def test_myers_against_the_table():
    rng = random.Random(9)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, hi))) for hi in (80, 90))
        k = rng.randint(0, len(p))
        assert decontam.myers(p, t, k) == [(j, d) for j, d in enumerate(plain_distance(p, t)) if j and d <= k]


def test_matches_against_brute_force(spark, documents):
    rng = random.Random(10)
    words = ["thon", "ere", "blet", "and", "of", "innt", "reth", "shha"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, sentence(rng.randint(8, 30)).capitalize()) for i in range(12)] + [(100, "short"), (101, None), (102, "")]
    docs = []
    for n in range(60):
        text, item = sentence(rng.randint(0, 60)), rng.choice(items[:12])[1]
        if n % 2:
            edited = list(item)
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice(["", "x", "yz", edited[at]])
            text = f"{text}\n{''.join(edited).upper() if n % 4 == 1 else ''.join(edited)}  {sentence(5)}"
        docs.append((n, text))
    want = set()
    for n, text in docs:
        t = decontam.normal(text)
        for i, item in items[:12]:
            m = decontam.normal(item)
            if min(plain_distance(m, t)) <= decontam.budget(len(m)):
                want.add((n, i))
    rows = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 20
    for r in rows:
        part, item = decontam.normal(dict(docs)[r["doc_id"]][r["start"] : r["end"]]), decontam.normal(dict(items)[r["item_id"]])
        assert plain_distance(item, part)[-1] <= r["distance"]
    bench = spark.createDataFrame([(1, "jumps over the lazy dog and RUNS"), (2, None)], "item_id long, text string")
    left = decontam.without_leaks(documents, bench)
    assert left.columns == documents.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([2, 3, None, 5, 6, 7, 8], key=str)
    assert decontam.matches(documents, bench.limit(0)).count() == 0 and decontam.matches(documents.limit(0), bench).count() == 0


# --- rollups

def test_rollups(spark, documents):
    exact = rollups.token_counts(documents, "v1").cache()
    bpe = ByteBpe(*default_paths())
    want = {}
    for r in documents.collect():
        n, t, c = want.get((r["source"], r["lang"]), (0, 0, 0))
        want[r["source"], r["lang"]] = (n + 1, t + len(bpe.ids(r["text"])), c + len(r["text"] or ""))
    held = rollups.Rollup(spark, fresh_path(spark, "rollup-test"))
    assert held.totals().count() == 0
    guess = exact.withColumn("tokens", F.lit(3).cast("long"))
    assert held.commit("b1", rollups.inserts(guess)) and not held.commit("b1", rollups.inserts(guess))
    assert held.commit("b2", rollups.revisions(guess, exact)) and not held.commit("b2", rollups.revisions(guess, exact))
    totals = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"], r["chars"]) for r in held.totals().collect()}
    assert totals() == want
    assert held.compact("c1") and totals() == want and not held.commit("b1", rollups.inserts(guess)) and held.committed() == {"b1", "b2"}
    assert held.commit("b3", rollups.deletes(exact)) and totals() == {} and held.commit("empty", rollups.inserts(exact.limit(0)))
    with pytest.raises(ValueError):
        held.commit("a/b", rollups.inserts(exact))


# --- secrets and personal data

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_against_python(spark, documents):
    rng = random.Random(11)
    pieces = ["password", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "fedcba98", "x", "é", "😀", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["key zX9kQ2mN8pL4vB7wR1tY6uH3 and getUserNameFromTableIndexValue some_ordinary_identifier_name"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(rows).collect():
        t = texts[r["doc_id"]]
        want = base_secrets(t)
        written = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest(), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(written) <= set(r["spans"].split(",") if r["spans"] else [])
    assert r["spans"] == "random:4:28"
    odd = {x["doc_id"]: x for x in secrets.scan(documents).collect() if x["doc_id"] in (2, 3, 7)}
    assert odd[2]["spans"] == odd[3]["spans"] == "" and odd[7]["n_assign"] == odd[7]["n_access"] == odd[7]["n_hex"] == 1
    assert secrets.scan(documents.limit(0)).count() == 0


def test_random_strings_are_told_apart(spark):
    labelled = secrets.samples(spark)
    model = secrets.train(labelled)
    fresh = [hashlib.sha512(str(i).encode()).hexdigest()[: 24 + i % 20].upper() for i in range(100)]
    plain = ["_".join(random.Random(i).sample(secrets.WORDS, 3)) for i in range(100)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(fresh + [p for p in plain if len(p) >= 20])], "doc_id long, text string")
    found = {r["doc_id"]: "random" in r["spans"] for r in secrets.scan(rows, model).collect()}
    assert np.mean([found[i] for i in range(100)]) > 0.9 and np.mean([found[i] for i in found if i >= 100]) < 0.05


def test_personal_data_patterns():
    def plain(t):
        ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        mail = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
        return [(k, *m.span()) for k, ms in (("email", mail), ("ip", ip), ("card", card), ("phone", phone)) for m in ms]

    rng = random.Random(12)
    pieces = ["a.b", "@", "x-y.org", ".", "10", "255", "256", "0", "4111 1111 1111 1111", "4111", "-", " ", "+", "1 (555)", "555-0100", "(", ")", "%", "é", "1", "@@", ".com", "\n", "0012"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain(t), t
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "@")  # stays linear


@pytest.fixture(scope="module")
def reader():
    return pii.train()


def test_model_adds_what_patterns_miss(reader):
    t = "call me at (913) 555-3797 or mail ana (at) site (dot) org and 4111-1111-1111-1112. Version 1.2.3 of 2024-01-02, 12345678 items at 10:30; the harbour at dawn"
    base, every = next(pii.spans(reader, [t], pii.Shapes()))
    assert base == [] and [t[a:b] for _, a, b in every] == ["ana (at) site (dot) org", "4111-1111-1111-1112", "(913) 555-3797"]
    words = ["harbour", "At", "at", "dot", "Morning,", "letter.", "is***", "WAS!!", "|", "über", "17", "2024", "3.5"]
    rng = random.Random(13)
    clean = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)]
    assert not [e for _, e in pii.spans(reader, clean, pii.Shapes()) if e]


def test_spans_inside_a_text(reader):
    """Held-out rows one after the other in one chain: runs of a label begin and end where they should."""
    def runs(labels):
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
        return {(i, j, labels[i]) for i, j in zip(cuts, cuts[1:], strict=False) if labels[i]}

    rows, shapes = pii.labelled(3, seed=98), pii.Shapes()
    random.Random(15).shuffle(rows)
    n = np.array([sum(len(words) for words, _ in rows)])
    ids = pii._ids(np.array([shapes[w] for words, _ in rows for w in words]), n)
    want, got = runs(np.array([x for _, labels in rows for x in labels])), runs(reader.viterbi(reader.emissions(ids), n))
    assert len(want & got) > 0.87 * len(want) and len(want & got) > 0.93 * len(got), (len(want), len(got), len(want & got))


def test_scan_and_mask(spark, documents, reader):
    got = {r["doc_id"]: r for r in pii.scan(documents, reader).collect()}
    assert (got[5]["n_email"], got[5]["n_phone"], got[5]["n_ip"], got[5]["n_card"]) == (1, 1, 1, 0) and got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    made = {r["doc_id"]: r for r in pii.masked(documents, reader).collect()}
    assert made[5]["text"] == "write to <EMAIL> or <PHONE> now; <IP>" and made[5]["n_chars"] == len(made[5]["text"]) and made[2]["text"] is None and made[1]["n_chars"] == 57
    assert pii.masked(documents, reader).columns == documents.columns and pii.scan(documents.limit(0), reader).count() == 0


def test_viterbi_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(14)
    model = crf.Crf(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    lengths = np.array([3, 0, 1, 5, 2, 5])
    e = rng.normal(size=(int(lengths.sum()), 3))
    got, at = model.viterbi(e, lengths), 0
    for n in lengths:
        if n:
            score = lambda p: model.first[p[0]] + model.last[p[-1]] + sum(e[at + i, k] for i, k in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert tuple(got[at : at + n]) == max(product(range(3), repeat=int(n)), key=score)
        at += n


LONG = {"a": "a" * 300_000, "space": " " * 300_000, "digits": "7 " * 60_000, "at": "a@" * 100_000, "words": "word " * 60_000, "lines": "\n" * 200_000}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_take_time_in_proportion(reader, kind):
    import time

    text, began = LONG[kind], time.monotonic()
    ByteBpe(*default_paths()).ids(text)
    list(pii.spans(reader, [text], pii.Shapes()))
    simhash.fingerprint(text)
    quality.features(text, [None], quality.WordHash())
    decontam.Matcher([(1, "word word word word word word word word"), (2, "a" * 40)]).find(text)
    assert time.monotonic() - began < 30


def test_best_ends():
    assert list(decontam._best_ends([(5, 2), (6, 1), (7, 1), (30, 0), (31, 1)], 10)) == [(6, 1), (30, 0)] and list(decontam._best_ends([], 3)) == []


def test_op7_counts_documents_without_text(spark, documents, tmp_path):
    from labeldates.llm import queries

    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_token_rollups(spark, str(tmp_path)).collect()
    assert sum(r["docs"] for r in got) == documents.count() and any(r["source"] is None and r["docs"] == 1 for r in got)


def test_short_items_match_exactly():
    found = lambda text: [(i, text[a:b], d) for i, a, b, d, _ in decontam.Matcher([(1, "Who was  Ana?"), (2, "今天是星期几"), (3, "old cat"), (4, " ")]).find(text)]
    assert found("so who was ana? an old\ncat") == [(1, "who was ana?", 0), (3, "old\ncat", 0)]
    assert found("请问今天是星期几呢") == [(2, "今天是星期几", 0)]
    assert found("a bold cat, old cats, who was anna?") == []
