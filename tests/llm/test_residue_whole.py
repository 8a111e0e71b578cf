"""The models are fitted on all documents, however they are dealt to tasks."""

import numpy as np

from sedimark.llm.residue import find_residue, judge, train, train_table
from tests.llm.test_residue import PROSE


def test_models_see_every_document(spark):
    texts = [f"{p} Entry {i}." for i, p in enumerate(PROSE)] * 61 + ["404 Not Found", "Content coming soon."] * 3
    assert len(texts) > 6000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = train(texts)
    for n in (1, 5):
        models = train_table(rows.repartition(n), "text")
        assert np.array_equal(models.counts, whole.counts) and np.array_equal(models.logs, whole.logs)
    want = sorted((i, j[0]) for i, j in enumerate(judge(texts, whole)) if j[0])
    assert sorted((r.doc_id, r.kind) for r in find_residue(rows).collect()) == want


def test_windows_are_judged_apart():
    models = train(PROSE)
    ratios = models.ratios(["404 Not Found", PROSE[0], "404 Not Found"])
    assert np.allclose(ratios[0], ratios[2], atol=1e-4)


def test_short_filler_comes_out():
    models = train(PROSE)
    for text in ("TBD", "TODO", "TBA", "TBD\n\nTBD"):
        assert judge([text], models)[0][0] == "filler", text
    assert [j[0] for j in judge(["Notes", "Ledger", "x", "42", "1.", "-"], models)] == [None] * 6


def test_phrases_that_no_seed_holds():
    """With every seed phrase that the documents hold left out, the models still find what they did."""
    import os

    import pytest

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    import pyarrow.parquet as pq

    from sedimark.llm import residue

    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    whole = {i for i, j in enumerate(judge(texts, train(texts))) if j[0] in ("filler", "notice")}
    held = {w.lower() for t in texts if t for w in residue.windows(residue.running(t))}
    seeds, labelled = residue._SEEDS, residue._LABELLED
    try:
        residue._SEEDS = {k: [w for w in ws if w.lower() not in held] for k, ws in seeds.items()}
        residue._LABELLED = {w: k for w, k in labelled.items() if w not in held}
        bare = {i for i, j in enumerate(judge(texts, train(texts))) if j[0] in ("filler", "notice")}
    finally:
        residue._SEEDS, residue._LABELLED = seeds, labelled
    assert len(whole & bare) >= 0.9 * len(whole) and len(bare - whole) <= 0.02 * len(whole)
