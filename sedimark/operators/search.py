"""Retrieval: vector search, full-text search, rank fusion, reranking and the relevance gate."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.config import DEFAULTS

#: vectors that a worker holds at once, whatever the size of an Arrow batch
EMBED_ROWS = 512


class InvalidQuery(ValueError):
    pass


def sanitize_query(text: str, limit: int = DEFAULTS.max_query_chars) -> str:
    """Without control characters but tabs and line ends; empty and too long queries are refused."""
    out = "".join(c for c in text if c in "\t\n" or (ord(c) >= 32 and ord(c) != 127)).strip()
    if not out:
        raise InvalidQuery("the query is empty")
    if len(out) > limit:
        raise InvalidQuery(f"the query has more than {limit} characters")
    return out


def check_k(k: int) -> int:
    if k <= 0:
        raise InvalidQuery("k must be positive")
    return k


def mock_embedding(text: str, dim: int = DEFAULTS.dimensions) -> list[float]:
    """Deterministic stand-in vector: a Mersenne stream seeded with the text's SHA-256, uniform in -1..1."""
    return mock_vectors([text], dim)[0].tolist()


def mock_vectors(texts: list[str], dim: int = DEFAULTS.dimensions, kind: type = np.float64) -> np.ndarray:
    """The stand-in vectors of ``texts``: the numbers of ``random.Random(SHA-256 in hex).uniform(-1.0, 1.0)``, drawn a row at a time."""
    out, stream = np.empty((len(texts), dim), dtype=kind), np.random.RandomState()
    for row, text in zip(out, texts, strict=True):
        name = hashlib.sha256(text.encode()).hexdigest().encode()
        stream.seed(np.frombuffer((name + hashlib.sha512(name).digest())[::-1], dtype="<u4"))  # as random.Random seeds itself with a string
        row[:] = 2.0 * stream.random_sample(dim) - 1.0
    return out


def embed(df: DataFrame, text: str = "text", out: str = "vector", model: Callable[[list[str]], list[list[float]]] | None = None, dim: int = DEFAULTS.dimensions) -> DataFrame:
    """``out`` of every text by ``model`` (called on ``EMBED_ROWS`` texts at most; the worker keeps it warm) or the stand-in."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [t or "" for t in texts]
            for some in (values[at : at + EMBED_ROWS] for at in range(0, len(values), EMBED_ROWS)):
                yield pd.Series(model(some))

    @F.arrow_udf("array<float>")
    def stand_ins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in (texts[at : at + EMBED_ROWS] for at in range(0, len(texts), EMBED_ROWS)):
                numbers = mock_vectors([t or "" for t in some.to_pylist()], dim, np.float32)
                yield pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * dim, numbers.ravel())

    return df.withColumn(out, (vectors if model else stand_ins)(F.col(text)))


def matches(**equal: str | None) -> Column:
    """Conjunction of equalities; a None stands for no condition (D1). Values are literals, never spliced into SQL."""
    out = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_topk(rows: DataFrame, query: list[float], k: int, id: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query``: ``id, distance, rank`` (J4, H1). The filter comes before the limit.

    A partial top-k per partition and one merge of k rows each (TakeOrderedAndProject); nothing is shuffled.
    """
    check_k(k)
    rows = rows.where(where) if where is not None else rows
    scored = rows.where(F.size(vector) == len(query)).select(F.col(id).alias("id"), F.round(l2(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6).alias("distance"))
    best = scored.orderBy("distance", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "id")))


def vector_topk_many(rows: DataFrame, queries: DataFrame, k: int, id: str = "id", vector: str = "vector", block: int = 8192) -> DataFrame:
    """The ``k`` nearest rows of each query: ``query_id, id, distance, rank``.

    ``queries``: ``query_id, vector``, a stated set that passes through the driver in blocks of ``block`` (their vectors
    are a matrix of a fixed size in each task); every task gives each query's k best of its rows, and one shuffle
    merges those.
    """
    check_k(k)
    spark = rows.sparkSession
    asked = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator()
    parts = []
    while some := list(islice(asked, block)):
        names = [r[0] for r in some]
        matrix = spark.sparkContext.broadcast(np.array([r[1] for r in some], dtype=np.float64))

        def nearest(batches, names=names, matrix=matrix):
            q = matrix.value
            own = (q * q).sum(axis=1)
            best = (np.zeros(0, dtype=np.int64), np.zeros(0), [])  # query, distance, id
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    # squared distances as one matrix product say which rows come into question; those are measured exactly
                    rough = own[:, None] + (m * m).sum(axis=1)[None, :] - 2.0 * (q @ m.T)
                    take = min(k, part.num_rows)
                    least = np.partition(rough, take - 1, axis=1)[:, take - 1]
                    a, b = np.nonzero(rough <= (least + 1e-4 * (1.0 + np.abs(least)))[:, None])
                    exact = np.round(np.sqrt(((m[b] - q[a]) ** 2).sum(axis=1)), 6)
                    ids = part.column(0).take(pa.array(b)).to_pylist()
                    who, far, what = np.concatenate([best[0], a]), np.concatenate([best[1], exact]), [*best[2], *ids]
                    order = sorted(range(len(who)), key=lambda i: (who[i], far[i], what[i])) if what and isinstance(what[0], str) else np.lexsort((np.array(what), far, who))
                    who, far, what = who[order], far[order], [what[i] for i in order]
                    first = np.searchsorted(who, who)
                    keep = np.flatnonzero(np.arange(len(who)) - first < k)
                    best = (who[keep], far[keep], [what[i] for i in keep])
            yield pa.RecordBatch.from_pydict({"query_id": [names[i] for i in best[0]], "id": best[2], "distance": best[1]})

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema[id].dataType.simpleString()}, distance double"
        dim = len(some[0][1])
        parts.append(rows.where(F.size(vector) == dim).select(id, vector).mapInArrow(nearest, kinds))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def bm25(rows: DataFrame, query: str, id: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of the rows that hold a term of the query.

    Term counts are taken row by row with array functions; the only aggregate is one row of corpus statistics (rows,
    mean length, and the document frequency of each query term), taken first and put into the plan as numbers.
    """
    asked = query_terms(query)
    if not asked:
        return rows.select(F.col(id).alias("id"), F.lit(0.0).alias("score")).limit(0)
    cut = rows.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), terms(F.col(text)).alias("t"))
    is_term = lambda q: lambda x: x == F.lit(q)
    tf = [F.size(F.filter("t", is_term(q))).alias(f"f{i}") for i, q in enumerate(asked)]
    counted = cut.select("id", F.size("t").alias("dl"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    known = stats.first()
    held = counted.where(" or ".join(f"f{i} > 0" for i in range(len(asked))))
    return held.select("id", score_bm25(known["n"], known["avgdl"], [known[f"df{i}"] for i in range(len(asked))], k1, b).alias("score"))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, in order."""
    return sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))


def score_bm25(n: int, mean: float | None, dfs: list[int], k1: float, b: float) -> Column:
    """The score from the columns ``dl`` and ``f0``, ``f1``, ... (how often the text holds each term)."""
    score = F.lit(0.0)
    for i, df in enumerate(dfs):
        f = F.col(f"f{i}")
        idf = F.log(F.lit(1 + (float(n) - float(df) + 0.5) / (float(df) + 0.5)))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(float(mean or 1))))
    return F.round(score, 6)


def text_topk(rows: DataFrame, query: str, k: int, id: str = "id", text: str = "text") -> DataFrame:
    """``id, score, rank`` of the ``k`` best rows by full-text score."""
    check_k(k)
    return ranked(bm25(rows, query, id, text), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the highest ``score`` with their ``rank``; equal scores rank by id (H1)."""
    best = scored.orderBy(F.col("score").desc(), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))


def fuse_ranks(left: DataFrame, right: DataFrame, k: int, constant: int = DEFAULTS.rrf_constant) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``id, rank``: ``id, score, score_kind, rank``."""
    both = left.select("id", F.col("rank").alias("a")).join(right.select("id", F.col("rank").alias("b")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    best = both.select("id", F.round(part("a") + part("b"), 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
    return best.withColumn("score_kind", F.lit("rrf")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))


def hybrid(rows: DataFrame, query: str, vector: list[float], k: int, id: str = "id", text: str = "text", vectors: str = "vector", where: Column | None = None) -> DataFrame:
    """Vector and full-text search fused by rank (J6); the filter applies to both before their limits."""
    rows = rows.where(where) if where is not None else rows
    return fuse_ranks(vector_topk(rows, vector, k, id, vectors), text_topk(rows, query, k, id, text), k)


def overlap_logit(query: str, text: Column) -> Column:
    """Stand-in for a reranking model: the share of the query's terms that a text holds, on a scale of -10 to 10."""
    asked = query_terms(query)
    have = F.array_distinct(terms(text))
    return F.round(F.size(F.array_intersect(have, F.array(*(F.lit(x) for x in asked)))) * (20.0 / max(1, len(asked))) - 10.0, 6)


def rerank(candidates: DataFrame, query: str, k: int, text: str = "text", least: float = DEFAULTS.min_score, model: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """The candidates that score at least ``least``, best first, ``k`` of them, with ``score`` and ``rank``.

    ``model`` scores (query, texts) in Arrow batches; without one the stand-in is used, which stays in the JVM. When
    a model fails, callers keep the first k candidates unfiltered (:func:`sedimark.api.query`).
    """
    check_k(k)
    if model is None:
        score = overlap_logit(query, F.col(text))
    else:

        @F.pandas_udf("double")
        def judged(texts: pd.Series) -> pd.Series:
            return pd.Series(model(query, list(texts)))

        score = judged(F.col(text))
    kept = candidates.drop("score", "rank").withColumn("score", score).where(F.col("score") >= least)
    best = kept.orderBy(F.col("score").desc(), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))
