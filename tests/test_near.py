import random

import pytest

from labeldates.operators import sampling


def most_rows(df) -> int:
    """The most rows that a node of the executed plan made."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        inside = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        below = node.children()
        made = node.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(walk, inside), *(walk(below.apply(i)) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def table(spark, rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return spark.createDataFrame([(i, h and [signed(x) for x in h]) for i, h in rows], "image_id string, h array<bigint>")


def test_a_common_hash_makes_no_row_for_each_pair(spark):
    pool, used = (table(spark, [(f"{side}{i}", [12345]) for i in range(1000)]) for side in "pu")
    near = sampling.nearest_used(pool, used, most=12, bits=64)
    assert most_rows(near) <= 3000
    assert {tuple(r) for r in near.collect()} == {(f"p{i}", "u0", 0) for i in range(1000)}
    assert most_rows(sampling.far_from(pool, used, most=12, bits=64)) <= 3000


@pytest.mark.parametrize("words, most", [(1, 12), (4, 20)])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, words, most):
    monkeypatch.setattr(sampling, "BLOCK", 16)
    monkeypatch.setattr(sampling, "HELD", 40)
    rng = random.Random(words)
    pool = [(f"p{i}", [rng.getrandbits(64) for _ in range(words)]) for i in range(90)]
    used = [(f"u{i}", [x ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 3, 5, 13]))) for x in pool[i % 60][1]]) for i in range(120)]
    gap = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    want = {(p, u, gap(a, b)) for p, a in pool for u, b in used if gap(a, b) <= most}
    a, b = table(spark, [*pool, ("p-none", None)]), table(spark, [*used, ("u-none", None)])
    assert sorted(map(tuple, sampling.near_pairs(a, b, most, 64 * words).collect())) == sorted(want)
    first = {p: min((n, u) for q, u, n in want if q == p) for p, _, _ in want}
    assert {(r["image_id"], (r["distance"], r["near_id"])) for r in sampling.nearest_used(a, b, most, 64 * words).collect()} == set(first.items())
    assert {r["image_id"] for r in sampling.far_from(a, b, most, 64 * words).collect()} == {p for p, _ in pool} - set(first) | {"p-none"}
    assert sampling.nearest_used(a, b.limit(0), most, 64 * words).count() == 0
