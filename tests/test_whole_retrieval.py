"""The flagship query searches all chunks, by text and by vector."""

from sedimark.operators import search
from sedimark.plans.reference_queries import CODE_QUERY, _probe, hybrid_retrieval


def test_hybrid_retrieval_is_whole(spark, tmp_path):
    rows = [(f"a{i}", "s/a.ts", i + 1, i + 1, f"export class service export class n{i}") for i in range(40)]
    rows += [(f"b{i}", "s/b.ts", i + 1, i + 1, f"ledger ticket ledger ticket n{i}") for i in range(40)]
    # all terms, but so long that the text list has it last: only its vector, the one asked for, brings it
    rows.append(("long", "s/long.ts", 1, 1, f"{CODE_QUERY} " + "w " * 3000))
    rows.append(("null", None, 1, 1, CODE_QUERY))
    rows.append(("null", None, 1, 1, CODE_QUERY))  # delivered twice
    chunks = spark.createDataFrame(rows, "id string, source string, start_line int, end_line int, text string")
    chunks.write.parquet(f"{tmp_path}/code_chunks.parquet")
    far = [[(9.0 if j == i % 64 else 0.0) for j in range(64)] for i in range(40)]
    vectors = [("long", _probe(1)), ("long", _probe(1)), ("gone", _probe(1)), ("a1", [float("nan")] * 64), ("a2", None), ("a3", [1.0])] + [(f"b{i}", v) for i, v in enumerate(far)]
    spark.createDataFrame(vectors, "chunk_id string, vector array<float>").write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    by_text = {r.id for r in search.text_topk(chunks.dropDuplicates(["id"]), CODE_QUERY, 30).collect()}
    assert "long" not in by_text and "null" in by_text
    found = {(r.source, r.start_line) for r in hybrid_retrieval(spark, str(tmp_path)).collect()}
    assert {("s/long.ts", 1), (None, 1)} <= found
