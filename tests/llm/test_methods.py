"""What the operators' methods promise: pruning, bounded tasks, linear time, safe commits; and the models held to plain versions."""

import math
import os
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeldates.llm import common, decontam, pii, quality, queries, rollups, secrets, simhash, topk, warc
from labeldates.llm.common import fresh_path
from tests.llm.test_text_operators import plain_distance, reference_components

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).parent / "sf0.1"
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no tables")


# --- top-k

@needs_tables
def test_bounds_prune_on_the_table():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{DATA}/embeddings.parquet")
    x = np.floor(256 * np.array(t["embedding"].to_pylist(), dtype=float))
    ids = np.array(t["vec_id"])
    asked = ids % 50 == 0
    search = topk.Search(ids[asked], x[asked])
    for a in range(0, len(ids), 500):
        search.add(ids[a : a + 500], x[a : a + 500])
    assert search.compared < 0.6 * search.pairs  # vectors without structure; more candidates prune more
    exact = x[asked] @ x.T
    exact[ids[asked][:, None] == ids] = -np.inf
    assert (np.sort(exact, axis=1)[:, : -topk.K - 1 : -1] == search.score).all()


def test_structure_prunes_nearly_all():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.cumsum(rng.normal(0, 0.2, (4000, 64)), axis=1))
    search = topk.Search(np.arange(40), x[:40])
    search.add(np.arange(4000), x)
    assert search.compared < 0.1 * search.pairs


# --- near-duplicates

@needs_tables
def test_trees_have_many_nodes_and_prune():
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()
    fps = np.unique(np.array([simhash.fingerprint(t) for t in texts[:4000]], np.uint64))
    agreeing, width = simhash.scheme(len(fps), simhash.RADIUS)
    shard = np.sort(fps & np.uint64((1 << width) - 1))
    fps = fps[np.argsort(fps & np.uint64((1 << width) - 1), kind="stable")]
    forest = simhash.Forest(fps, shard.astype(np.int64))
    list(forest.links(simhash.RADIUS))
    sizes = np.unique(shard, return_counts=True)[1]
    assert agreeing == 1 and sizes.mean() > 30 and forest.visits < 0.75 * (sizes**2).sum()


def test_scheme_keeps_trees_small():
    for n in (0, 1, 60, 10**4, 10**6, 10**7, 10**8, 10**10):
        agreeing, width = simhash.scheme(n, 4)
        assert agreeing <= 3 and n / 2 ** (agreeing * width) <= 16 * simhash.TREE and agreeing * width <= 64 // (4 + agreeing) * agreeing


def test_every_scheme_finds_all_links(spark):
    rng = random.Random(15)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = reference_components({signed(x): x for x in fps})
    for agreeing, width in ((1, 0), (1, 12), (2, 5), (3, 9)):
        keys = df.select("fp", F.explode(simhash._shard_keys(F.col("fp"), 4, agreeing, width)).alias("k"))
        assert keys.count() == len(fps) * (math.comb(4 + agreeing, agreeing) if width else 1)
    for tree in (1, 8, 10**6):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, tree=tree)).collect()}
        assert {k: v for k, v in want.items() if k in roots} == roots and all(v == k for k, v in want.items() if k not in roots)


def rows_by_task(df):
    """How many rows each task of the last stage reads, counted where the rows are."""
    return sorted(r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.fixture
def as_dealt(spark):
    """Joins by shuffle, its partitions left as they are."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_hot_keys_stay_where_they_are(spark, as_dealt):
    total = 40_000
    rows = spark.range(0, total, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    named = rows.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    got = common.join_named(rows, named, "k", total)
    assert got.count() == total and got.where("k = 7").agg(F.min("top")).first()[0] == total - 1 - (total - 1) % 3
    sizes = rows_by_task(got)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    assert common.join_named(rows, named.limit(0), "k", total, "left").count() == total


def test_one_payload_for_most_pages(spark, as_dealt):
    rows = spark.range(0, 6000, 1, 6).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).otherwise("error page").alias("html"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(warc.write(rows, fresh_path(spark, "warc-hot"))).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 5999 else ("revisit", 5999) for i in range(6000)}
    sizes = rows_by_task(warc.revisits(rows))
    assert sum(sizes) == 3999 and sizes[-1] < 3 * sizes[len(sizes) // 2]


# --- decontamination

def test_items_of_all_lengths_in_blocks(spark, monkeypatch):
    rng = random.Random(16)
    letters = "abcdefghij"
    item = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(n, item(n)) for n in (1, 5, 23, 24, 25, 60)] + [(60, "x"), (7, "fünf worte"), (7, "fünf worte"), (8, None)]
    docs = [(k, f"{item(30)} {text} {item(9)}") for k, (_, text) in enumerate(items) if text] + [(90, None), (91, "")]
    want = []
    for k, text in docs:
        for i, wanted in items:
            if text and wanted:
                t, m = decontam.normal(text), decontam.normal(wanted)
                exact = any(decontam.stands_alone(t, a, a + len(m)) for a in range(len(t)) if t.startswith(m, a))
                if exact if len(m) < decontam.MIN_CHARS else min(plain_distance(m, t)) <= decontam.budget(len(m)):
                    want.append((k, i))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 40):  # one block, or a block for an item or two
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        assert sorted(set((r["doc_id"], r["item_id"]) for r in decontam.matches(d, b).collect())) == sorted(set(want))
        assert decontam.matches(d, b).where("item_id = 7").count() == sum(i == 7 for _, i in want) == 4  # two rows of it in two documents
        left = {r["doc_id"] for r in decontam.without_leaks(d, b).collect()}
        assert left == {k for k, _ in docs} - {k for k, _ in want}


# --- rollups

def test_two_compactions_at_once_count_once(spark):
    held = rollups.Rollup(spark, fresh_path(spark, "rollup-race"))
    counts = spark.createDataFrame([("a", "en", "v", 5, 9)], "source string, lang string, tokenizer_version string, tokens long, chars long")
    assert held.commit("b1", rollups.inserts(counts))
    other = rollups.Rollup(spark, held.path)
    parts, mine = other._parts(), other._parts
    other._parts = lambda: parts  # has seen what was there before the first one committed
    assert held.compact("x")
    held.commit("b2", rollups.inserts(counts))
    try:
        assert not other.compact("y")
    except Exception as e:  # its files may be gone by now: then it fails and commits nothing
        assert "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e) or "does not exist" in str(e)
    other._parts = mine
    assert [tuple(r) for r in held.totals().collect()] == [("a", "en", "v", 2, 10, 18)]
    assert held.compact("z") and not held.compact("z") and held.committed() == {"b1", "b2"} and len(held._names("compact")) == 1
    assert [tuple(r) for r in held.totals().collect()] == [("a", "en", "v", 2, 10, 18)]


# --- secrets

def test_random_spans_by_a_plain_sum(spark):
    """Every ``random`` span redone: runs outside assignments, transitions added up one by one."""
    model = secrets.train(secrets.samples(spark))
    rng = random.Random(17)
    rand = lambda n: "".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(n))
    near = ["harbour_window_of_the_letter", "password=" + rand(30), "token: ab", "a" * 30, "-" * 40, "é", "😀", " ", "\n", "AKIA" + "A" * 20, "0123456789abcdef" * 2]
    texts = [" ".join(rng.choice([*near, rand(rng.randint(15, 50))]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    code = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    found = 0
    for i, text in enumerate(texts):
        bare = re.sub(secrets.ASSIGN.replace(r"\x20", " "), lambda m: "\x01" * len(m[0]) if len(m[2]) >= secrets.LEAST_VALUE else m[0], text)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", bare):
            if re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", m[0]):
                continue
            llr = sum(model[code[a] * secrets.SIDE + code[b]] for a, b in zip(m[0], m[0][1:]))
            if llr >= secrets.LEAST_RATIO and llr >= secrets.LEAST_BY_CHARACTER * len(m[0]):
                want.append(f"random:{m.start()}:{m.end()}")
        assert [x for x in got[i]["spans"].split(",") if x.startswith("random")] == want, text
        found += len(want)
    assert found > 100


ORDINARY = ["-" * 29, "A" * 24, "=-" * 15, "_" * 60, "123e4567-e89b-12d3-a456-426614174000", "550E8400-E29B-41D4-A716-446655440000", "/usr/local/share/applications", "getElementsByClassNameAndRole", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement_vraiment",
            "my_favourite_restaurant_in_town", "THE_QUICK_BROWN_FOX_JUMPED", "abcdefghijklmnopqrstuvwxyz", "2024-01-01T12-00-00_2024-02-02", "electroencephalographically", "kubernetes-ingress-nginx-controller", "ThreadPoolTaskSchedulerBuilder", "AbstractSingletonProxyFactoryBean", "desoxyribonucleic/acid/sequences"]


def test_words_outside_the_samples(spark):
    rng = random.Random(18)
    sixty_four = secrets.ALPHABET[:62]
    noise = ["".join(rng.choice(sixty_four) for _ in range(rng.randint(24, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(ORDINARY + noise)), "doc_id long, text string")
    found = {r["doc_id"]: "random" in r["spans"] for r in secrets.scan(rows).collect()}
    assert [ORDINARY[i] for i in range(len(ORDINARY)) if found[i]] == []
    assert np.mean([found[len(ORDINARY) + i] for i in range(200)]) >= 0.95


def test_long_runs_and_many_matches_in_proportion(spark):
    rng = random.Random(19)
    model = secrets.train(secrets.samples(spark))
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(300_000))
    hexes = " ".join(f"{rng.getrandbits(100):025x}" for _ in range(20_000))
    rows = spark.createDataFrame([(1, run), (2, hexes), (1, run)], "doc_id long, text string").repartition(1)
    began = time.monotonic()
    got = secrets.scan(rows, model).collect()
    assert time.monotonic() - began < 15
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2] and {r["n_hex"] for r in got if r["doc_id"] == 2} == {20_000}
    assert all("random:" in r["spans"] for r in got if r["doc_id"] == 1)
    want = ",".join(f"hex:{26 * i}:{26 * i + 25}" for i in range(20_000))
    assert [r["spans"] for r in got if r["doc_id"] == 2] == [want]


# --- personal data

@pytest.fixture(scope="module")
def reader():
    return pii.train()


WRITTEN_BY_HAND = {
    "please call 0171 234567 tomorrow": ["0171 234567"], "Tel. 02 12 34 56 78": ["02 12 34 56 78"], "030/1234567": ["030/1234567"], "Sie erreichen mich unter 030/1234567 am Abend": ["030/1234567"], "appelez le 01 98 76 54 32 demain": ["01 98 76 54 32"],
    "llame al 912 345 678 por la tarde": ["912 345 678"], "write to john dot smith at gmail dot com please": ["john dot smith at gmail dot com"], "schreib an petra punkt klein at web punkt de bitte": ["petra punkt klein at web punkt de"], "écrivez à luc arobase poste point fr": ["luc arobase poste point fr"],
    "mi correo : ana arroba sitio punto es": ["ana arroba sitio punto es"], "mail ana (at) site (dot) org today": ["ana (at) site (dot) org"], "We look at the dot on the page": [], "At noon they met at the mill . Rain fell": [], "im Jahr 1998 waren es 12 Boote": [], "en 2004 il y avait 17 maisons": [], "she paid 4512 in all on 12.03.2019": [],
}


def test_four_languages(reader):
    for text, want in WRITTEN_BY_HAND.items():
        _, every = next(pii.spans(reader, [text], pii.Shapes()))
        assert [text[a:b] for _, a, b in every] == want, text


def test_recall_and_precision_on_held_out_rows(reader):
    hit = missed = wrong = 0
    for words, labels in pii.labelled(4, seed=77):
        text, at, want, i = " ".join(words), 0, [], 0
        place = []
        for w in words:
            place.append((at, at + len(w)))
            at += len(w) + 1
        while i < len(words):
            j = i + 1
            while labels[i] and j < len(words) and labels[j] == labels[i]:
                j += 1
            if labels[i]:
                want.append((pii.LABELS[labels[i]], place[i][0], place[j - 1][1]))
            i = j
        _, got = next(pii.spans(reader, [text], pii.Shapes()))
        covers = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
        hit += sum(any(covers(w, g) and abs(w[1] - g[1]) + abs(w[2] - g[2]) <= 3 for g in got) for w in want)
        missed += sum(not any(covers(w, g) for g in got) for w in want)
        wrong += sum(not any(covers(g, w) for w in want) for g in got)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.95


def test_added_spans_by_sweep():
    rng = random.Random(20)
    for _ in range(500):
        span = lambda: ("phone", a := rng.randint(0, 60), a + rng.randint(1, 9))
        base, more = [span() for _ in range(rng.randint(0, 6))], [span() for _ in range(rng.randint(0, 6))]
        want = [x for x in more if not any(x[1] < b and a < x[2] for _, a, b in base)]
        assert sorted(pii._added(base, more)) == sorted(want)
    began = time.monotonic()
    pii._added([("ip", i * 10, i * 10 + 9) for i in range(100_000)], [("card", i * 10 + 5, i * 10 + 12) for i in range(100_000)])
    assert time.monotonic() - began < 2


def test_long_words_keep_their_shape():
    assert pii.shape("ana.b+" * 20 + "x@y.org") != pii.shape("1-" * 40 + "1") != "long"


# --- quality

def test_repeated_labels_do_not_shrink_the_sample(spark):
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit(9).alias("n_chars"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    many = labels.crossJoin(spark.range(10)).drop("id")
    a, b = quality.train(docs, labels, sample=500), quality.train(docs, many, sample=500)
    assert (a.w == b.w).all() and a.w0 == b.w0


# --- the registered queries

@needs_tables
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_queries_answer_for_every_row(spark, name):
    """One row per document, page or query vector of the whole table, and the contract's columns first."""
    small = str(DATA.parent / "sf0.001")
    got = queries.QUERIES[name](spark, small)
    columns = {
        "op1_topk": ["query_id", "rank", "vec_id", "score"], "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op3_quality": ["doc_id", "held_out", "score", "predicted"],
        "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op6_simhash": ["doc_id", "fingerprint", "component_id"], "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op10_html_text": ["page_id", "url", "text", "n_chars"],
    }.get(name)
    assert columns is None or got.columns[: len(columns)] == columns
    rows = got.collect()
    size = lambda table: spark.read.parquet(f"{small}/{table}.parquet").count()
    if name in ("op3_quality", "op6_simhash", "op8_secrets", "op9_pii"):
        assert len(rows) == len({r["doc_id"] for r in rows}) == size("documents")
    if name in ("op5_warc", "op10_html_text"):
        assert len(rows) == len({r["page_id"] for r in rows}) == size("pages")
    if name == "op2_packing":
        assert len({r["doc_id"] for r in rows}) == size("documents") and sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    if name == "op7_token_rollups":
        assert sum(r["docs"] for r in rows) == size("documents")
    if name == "op6_simhash":
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
        assert {r["doc_id"]: r["component_id"] for r in rows} == reference_components(fps)
    if name == "op3_quality":
        label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
        held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
        assert np.mean([a == b for a, b in held]) > 0.9
