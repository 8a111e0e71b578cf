"""An inverted index over texts: postings in folders by term, so that a query reads those of its own terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.search import query_terms, score_bm25, terms

BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, id: str = "id", text: str = "text", keep: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """``id, term, tf, dl``, the columns of ``keep`` and ``bucket``: how often each text holds each of its terms.

    ``dl`` is the number of terms of the text. Counts combine before the shuffle, which is on (id, term), so a term that
    all texts hold is no hot group. Null texts have none.
    """
    cut = rows.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), *keep, terms(F.col(text)).alias("_t"))
    each = cut.select("id", *keep, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy("id", *keep, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("bucket", bucket(F.col("term"), buckets))


def lengths(rows: DataFrame, text: str = "text", out: str = "n_terms") -> DataFrame:
    """The rows with the number of terms of their text, null where that is null."""
    return rows.withColumn(out, F.when(F.col(text).isNotNull(), F.size(terms(F.col(text)))))


def bm25(index: DataFrame, n: int, mean: float, query: str, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS) -> DataFrame:
    """``id, score`` of the texts that hold a term of the query, as :func:`sedimark.operators.search.bm25` gives it.

    ``n`` and ``mean``: the number of texts and their mean length. Only the folders of the query's terms are read, once
    for the document frequencies (one row, which becomes part of the plan) and once for the scores.
    """
    asked = query_terms(query)
    if not asked:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    spark = index.sparkSession
    own = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(bucket(F.col("t"), buckets)).distinct().collect()]
    held = index.where(F.col("bucket").isin(*own) & F.col("term").isin(*asked))
    known = held.agg(*(F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(asked))).first()
    each = held.groupBy("id").agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, t in enumerate(asked)))
    return each.select("id", score_bm25(n, mean, [known[f"df{i}"] or 0 for i in range(len(asked))], k1, b).alias("score"))
