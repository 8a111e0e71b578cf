import numpy as np

from sedimark.llm.neighbours import Forest, most_similar, search_similar, similar_pairs


def brute(vectors: dict[int, np.ndarray], k: int) -> dict[int, list[tuple[float, int]]]:
    ids = sorted(vectors)
    m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    out = {}
    for a, i in enumerate(ids):
        s = np.round(m @ m[a], 6)
        out[i] = [(float(s[b]), ids[b]) for b in sorted((x for x in range(len(ids)) if x != a), key=lambda x: (-s[x], ids[x]))[:k]]
    return out


def table(spark, vectors, extra=()):
    rows = [(int(i), [float(x) for x in v], "x", 0) for i, v in vectors.items()] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, vector array<float>, id string, v int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    vectors = {i: (centres[i % 12] + 0.35 * rng.standard_normal(16)).astype(np.float32).astype(np.float64) for i in range(600)}
    got: dict[int, set] = {}
    for r in most_similar(table(spark, vectors), dim=16, k=10, leaf_rows=80, trees=4).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    truth = brute(vectors, 10)
    recall = np.mean([len(got[i] & {n for _, n in truth[i]}) / 10 for i in vectors])
    assert recall >= 0.95 and all(len(x) == 10 for x in got.values())


def test_equal_vectors_and_unusable_ones(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8).astype(np.float32).astype(np.float64)
    vectors = {i: base * (1 + i % 3) for i in range(1, 40)} | {100: rng.standard_normal(8).astype(np.float32).astype(np.float64)}
    bad = [(200, [0.0] * 8, "z", 0), (201, [float("nan")] * 8, "z", 0), (202, [1.0] * 7, "z", 0), (203, None, "z", 0), (204, [float("inf")] + [1.0] * 7, "z", 0), (None, [1.0] * 8, "z", 0), (1, [float(x) for x in vectors[1]], "x", 0), (205, [None] + [1.0] * 7, "z", 0)]
    got: dict[int, list] = {}
    for r in most_similar(table(spark, vectors, bad), dim=8, k=5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert set(got) == set(vectors)
    assert got[1] == [2, 3, 4, 5, 6] and got[3] == [1, 2, 4, 5, 6] and got[39] == [1, 2, 3, 4, 5] and got[100] == [1, 2, 3, 4, 5]


def test_pairs_and_small_tables(spark):
    vectors = {1: np.array([1.0, 0.0]), 2: np.array([1.0, 0.1]), 3: np.array([0.0, 1.0])}
    pairs = {tuple(r) for r in similar_pairs(table(spark, vectors), dim=2, k=10).collect()}
    assert pairs == {(1, 2)}
    assert most_similar(table(spark, {1: np.array([1.0, 0.0])}), dim=2).count() == 0
    assert most_similar(table(spark, vectors).limit(0), dim=2).count() == 0


def test_greedy_search_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 12))
    vectors = {i: (centres[i % 8] + 0.4 * rng.standard_normal(12)).astype(np.float32).astype(np.float64) for i in range(400)}
    vectors[401] = vectors[0] * 2  # the same direction
    asked = {i: vectors[i] for i in range(0, 400, 20)} | {5000: centres[3].astype(np.float32).astype(np.float64)}  # one that is not in the table
    queries = table(spark, asked, [(6000, [0.0] * 12, "unusable", 0), (None, [1.0] * 12, "no key", 0)])
    got: dict[int, list] = {}
    for r in search_similar(table(spark, vectors), queries, dim=12, k=10).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert set(got) == set(asked) and all(len(x) == 10 for x in got.values()) and got[0][:2] == [0, 401]
    ids = sorted(vectors)
    m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    hits = 0
    for q, v in asked.items():
        s = np.round(m @ (v / np.linalg.norm(v)), 6)
        hits += len(set(got[q]) & {ids[j] for j in np.lexsort((np.array(ids), -s))[:10]})
    assert hits >= 0.9 * 10 * len(asked)
    assert search_similar(table(spark, vectors), queries.limit(0), dim=12).count() == 0
    assert search_similar(table(spark, vectors).limit(0), queries, dim=12).count() == 0


def test_leaves_stay_small_where_the_sample_is(spark):
    """A forest fitted on few vectors cuts on by random directions, so leaves do not grow with the table."""
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((4000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = Forest(unit[:200], 4000, 2, 50, 1)
    assert forest.extra > 0
    for row in forest.leaves(unit):
        assert np.bincount(row).max() <= 8 * 50 and row.min() >= 0
    blocks = forest.leaves(unit, 1)[0] >> forest.shift(4000, 500)
    assert 4 <= len(np.unique(blocks)) <= 16 and Forest(unit[:0], 0, 2, 50, 1).leaves(unit[:0]).shape == (2, 0)
    assert (Forest(unit[:300], 300, 1, 1000, 1).leaves(unit[:300], 1)[0] == 0).all()
