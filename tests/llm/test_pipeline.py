import os
from pathlib import Path

import pytest

from labeldates.llm import decontam, pii, quality, simhash
from labeldates.llm.common import table
from labeldates.llm.tokens import ByteBpe, default_paths
from tests.llm.test_alike import reference_roots
from tests.llm.test_search_and_packing import check_packing

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_pipeline_against_plain_python(spark):
    """Every stage redone on the driver by its definition; the result of the last is checked piece by piece."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    docs = table(spark, str(DATA), "documents")
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
    model = quality.train(docs, table(spark, str(DATA), "labels"))
    import numpy as np

    made = [quality.features(t, [n], quality.WordHash()) for _, t, n in rows]
    slim = quality.Machine(model.w0, model.w.astype(np.float32), model.v.astype(np.float32), model.mean, model.scale)
    scores = slim.score([w for w, _ in made], np.array([d for _, d in made]))
    kept = {i: t for (i, t, _), s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
    roots = reference_roots(kept)  # the contract of stages on word shingles: five words, Jaccard similarity 0.8
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    items = [(r["item_id"], decontam.normal(r["text"])) for r in table(spark, str(DATA), "benchmark").collect()]
    matcher = decontam.Matcher(items)
    leaks = {i for i, t in kept.items() if matcher.find(t)}
    assert {i for i, t in kept.items() if any(x in decontam.normal(t) for _, x in items)} <= leaks
    kept = {i: t for i, t in kept.items() if i not in leaks}
    reader, shapes = pii.train(), pii.Shapes()
    masked = [(i, pii.mask(t, every)) for (i, t), (_, every) in zip(kept.items(), pii.spans(reader, list(kept.values()), shapes), strict=True)]
    result = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r["doc_id"] for r in result} == set(kept)
    check_packing(result, masked, ByteBpe(*default_paths()))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_stages_keep_columns_and_take_empty_tables(spark, documents):
    import corpus_pipeline

    for docs in (documents, documents.limit(0)):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(DATA))
            assert at.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, at, str(DATA)).count()
    assert simhash.one_of_each(documents).count() == 7
