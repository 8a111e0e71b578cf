"""The inverted index, budgets, nearest vectors of many queries, and access to versioned tables."""

import numpy as np

from sedimark.operators import search, text_index, windows
from sedimark.sources.versions import VersionedTable, tables


def test_index_scores_as_a_scan_does(spark, tmp_path):
    texts = ["alpha beta beta", "beta gamma", None, "", "Alpha-ALPHA alpha", "delta"] * 3
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, scope string")
    held = VersionedTable(spark, f"{tmp_path}/p", by="bucket")
    held.commit(text_index.postings(rows, keep=("scope",)), append=True)
    size = text_index.lengths(rows).selectExpr("count(n_terms) as n", "avg(n_terms) as mean").first()
    for query in ("beta alpha", "delta", "nothing here", "!!"):
        want = sorted(map(tuple, search.bm25(rows, query).collect()))
        assert sorted(map(tuple, text_index.bm25(held.read(), size[0], size[1], query).collect())) == want
    plan = text_index.bm25(held.read(), size[0], size[1], "delta")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert text_index.postings(rows.limit(0)).count() == 0
    # a term that every row holds is as many postings as rows
    assert text_index.postings(rows).where("term = 'beta'").count() == 6


def test_replaced_postings(spark, tmp_path):
    held = VersionedTable(spark, f"{tmp_path}/p", by="bucket")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, text string")
    held.commit(text_index.postings(frame((1, "old words"), (2, "stay"))), append=True)
    held.commit(text_index.postings(frame((1, "new"))), frame((1, "")).select("id"), append=True)
    assert {(r.id, r.term) for r in held.read().collect()} == {(1, "new"), (2, "stay")}
    held.commit(deletes=frame((1, ""), (2, "")).select("id"))
    held.compact()
    assert held.count() == 0


def test_budget_drops_early_and_exactly(spark):
    rows = [(g, i, (i * 7 + g) % 50) for g in (1, 2) for i in range(500)] + [(None, 1, 5), (None, 2, 100), (3, 1, 101), (3, 2, 0), (4, 1, None), (4, 2, 3)]
    df = spark.createDataFrame(rows, "g int, i int, n int").repartition(7)
    got = sorted((r.g or 0, r.i) for r in windows.within_budget(df, "i", "n", 100, "g").collect() if r.n is not None)
    want = []
    for g in (None, 1, 2, 3, 4):
        total = 0
        for _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += n or 0
            if total > 100:
                break
            if n is not None:
                want.append((g or 0, i))
    assert got == sorted(want)
    assert windows.within_budget(df.limit(0), "i", "n", 100, "g").count() == 0 and windows.within_budget(df.where("n is not null"), "i", "n", 100).count() > 0


def test_nearest_of_many_queries(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((700, 6)).round(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, [1.0])], "id long, vector array<float>").repartition(3)
    queries = rows.where("id % 50 = 0").selectExpr("id as query_id", "vector").where("size(vector) = 6")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.vector_topk_many(rows, queries, 5, block=4).collect()}
    stored = vectors.astype(np.float32).astype(np.float64)
    for q in range(0, 700, 50):
        dist = np.round(np.sqrt(((stored - stored[q]) ** 2).sum(axis=1)), 6)
        for rank, i in enumerate(np.lexsort((np.arange(700), dist))[:5], 1):
            assert got[q, rank] == (i, dist[i])
    assert len(got) == 14 * 5


def test_tables_are_listed_read_and_dropped(spark, tmp_path):
    held = VersionedTable(spark, f"{tmp_path}/one")
    assert tables(spark, str(tmp_path)) == [] and held.count() == 0 and held.get([1]) is None
    held.commit(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"))
    assert tables(spark, str(tmp_path)) == ["one"] and held.count() == 3
    assert [tuple(r) for r in held.get([2, 9], columns=["v"]).collect()] == [("b",)]
    assert held.get(where="v > 'a'", limit=1).count() == 1
    held.drop()
    assert tables(spark, str(tmp_path)) == [] and held.version() == 0
