import random
from collections import Counter

from labeldates.llm import alike, simhash
from tests.llm.test_text_operators import reference_fingerprint


def reference_sets(texts):
    sets = {}
    for i, t in texts.items():
        words = simhash.WORD.findall((t or "").translate(simhash.LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return sets


def reference_roots(texts):
    sets, parent = reference_sets(texts), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def made():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(9))
    texts = []
    for n in (3, 8, 40, 120, 300):
        for _ in range(8):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base) + " " + line)
            for edits in (0, 1, 2, 3, 5):
                c = list(base)
                for _ in range(edits):
                    c[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(c) + " " + line)
    crowd = [rng.choice(words) for _ in range(90)]  # many near copies of one text, some only near to some others
    for _ in range(90):
        c = list(crowd)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(c))
    texts += ["", None, " \n", "One Two", "one two", "É é", "very long " * 500]
    return dict(enumerate(texts))


def test_pipeline_stage_takes_near_copies_of_five_word_shingles(spark):
    """Pairs that 4 bits of the 4-word digest do not tell go too; those of lesser similarity stay."""
    import corpus_pipeline

    texts = made()
    want = reference_roots(texts)
    fps = {i: reference_fingerprint(t) for i, t in texts.items()}
    assert sum(want[i] != i and all((fps[i] ^ fps[j]).bit_count() > 4 for j in texts if j != i and want[j] == want[i]) for i in texts) > 10
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got) == sorted(set(want.values()))


def test_large_groups_in_rounds(spark, monkeypatch):
    """Groups of more than three sets in leading sets and rounds, without a list of frequent shingles: the same components."""
    texts = made()
    want = reference_roots(texts)
    monkeypatch.setattr(alike, "OFTEN", 0)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(alike.common, "HOT_SHARE", 10**9)
    for crowd in (10_000, 5):  # in one task by shingle, or apart
        of = {}
        for r in alike.near_copies(df, small=3, crowd=crowd).collect():
            of.setdefault(r["root"], []).append(r["doc_id"])
        assert {i: min(x) for x in of.values() for i in x} == want


def test_written_tables_have_few_files(spark, monkeypatch, tmp_path):
    """Steps that return few rows from many tasks don't leave a file of each task."""
    monkeypatch.setattr(alike.common, "shared_dir", lambda spark: f"file://{tmp_path}")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(list(made().items()), "doc_id long, text string")
        assert alike.near_copies(df).count() == len(made())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    files = Counter({p.name: len(list(p.glob("*.parquet"))) for p in tmp_path.iterdir()})
    assert {name.rsplit("-", 1)[0] for name in files} >= {"candidates", "near-parities", "links"}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files
