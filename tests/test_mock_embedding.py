"""The query of the stand-in vectors: what it moves between machines, what it finds, and the numbers themselves."""

import hashlib
import random

from pyspark.sql import functions as F

from sedimark.operators import search
from sedimark.plans.reference_queries import mock_embedding


def documents(spark, folder):
    rows = [(1, "same"), (2, "same"), (3, "other"), (4, None), (5, ""), (6, "same"), (7, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_vectors_are_neither_broadcast_nor_shuffled(spark, tmp_path):
    df = mock_embedding(spark, documents(spark, tmp_path))
    assert sorted(map(tuple, df.collect())) == [(i, 768, True, True) for i in range(1, 8)]
    made = df._jdf.queryExecution()
    assert "Broadcast" not in made.executedPlan().toString()
    join = made.optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    assert not any("array" in side.schema().simpleString() for side in (join.left(), join.right()))


def test_unlike_vectors_of_a_text_come_out(spark, tmp_path, monkeypatch):
    unlike = F.when(F.col("doc_id") == 7, F.array(F.lit(0.5), F.lit(-2.0))).otherwise(F.array(F.lit(0.5), F.lit(0.25))).cast("array<float>")
    monkeypatch.setattr(search, "embed", lambda rows: rows.withColumn("vector", unlike))
    got = {r.doc_id: (r.dim, r.inside, r.alike) for r in mock_embedding(spark, documents(spark, tmp_path)).collect()}
    assert got[3][2] != got[7][2] and got[7][1] is False and all(got[i] == (2, True, True) for i in (1, 2, 4, 5, 6))


def test_numbers_are_those_of_the_seeded_stream(spark):
    texts = ["x", "", "é\n", "a" * 5000]
    want = []
    for text in texts:
        stream = random.Random(hashlib.sha256(text.encode()).hexdigest())
        want.append([stream.uniform(-1.0, 1.0) for _ in range(768)])
    assert search.mock_vectors(texts).tolist() == want == [search.mock_embedding(t) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.vector for r in search.embed(rows).withColumn("vector", F.col("vector").cast("array<double>")).collect()}
    assert all(abs(a - b) < 1e-7 for i, v in enumerate(want) for a, b in zip(got[i], v, strict=True))
