"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.llm.bpe import decode_table, encode_table
from sedimark.llm.mixing import mix
from sedimark.llm.neighbours import most_similar, search_similar, similar_pairs, usable
from sedimark.llm.origin import judge_origin
from sedimark.llm.residue import find_residue
from sedimark.llm.splitting import oversized, split_oversized
from sedimark.llm.syntax import judge_files, rates
from sedimark.operators.search import vector_topk_many
from sedimark.plans.registry import Registry, table

registry = Registry()


@registry.query()
def p2_found(spark, d):
    """Files that are not valid in the language of their extension."""
    return judge_files(table(spark, d, "code_chunks")).where("not valid").select("source")


@registry.query()
def p2_rates(spark, d):
    """Invalid files per scope and language."""
    return rates(judge_files(table(spark, d, "code_chunks")))


@registry.query()
def p2_failures(spark, d):
    """Where invalid files stop making sense, and why."""
    return judge_files(table(spark, d, "code_chunks")).where("not valid").select("source", "language", "line", "col", "cause")


@registry.query()
def p3_found(spark, d):
    """Files written by a program, minified, copied from another project or nothing but data."""
    return judge_origin(table(spark, d, "code_chunks")).where("kind is not null").select("source")


@registry.query()
def p3_kinds(spark, d):
    """Files per scope and kind; hand-written ones have the kind "hand"."""
    judged = judge_origin(table(spark, d, "code_chunks"))
    return judged.groupBy("scope", F.coalesce("kind", F.lit("hand")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


_OVER = "length(text) > 4000 or length(text) - length(replace(text, chr(10), '')) + case when text = '' or right(text, 1) = chr(10) then 0 else 1 end > 50"


@registry.query(f"select distinct id from code_chunks where {_OVER}")
def p5_found(spark, d):
    """Chunks over the limit, each of which the operator cuts into pieces."""
    return split_oversized(table(spark, d, "code_chunks")).select("id").distinct()


@registry.query()
def p5_pieces(spark, d):
    """The pieces of the chunks over the limit with their lines."""
    return split_oversized(table(spark, d, "code_chunks"))


@registry.query(
    f"""with o as (select distinct on (id) id, start_line, text from code_chunks where id is not null and ({_OVER})), n as (select *, length(text) - length(replace(text, chr(10), '')) + case when right(text, 1) = chr(10) then 0 else 1 end as n from o)
    select id, md5(text) as text_md5, 0::bigint as over_limit, coalesce(start_line, 1)::int as first_line, (coalesce(start_line, 1) + n - 1)::int as last_line, 0::bigint as gaps from n"""
)
def p5_whole(spark, d):
    """What the pieces of a chunk must be together: its text once, without gaps, each within the limits."""
    pieces = split_oversized(table(spark, d, "code_chunks"))
    own = F.struct("piece", F.expr("substring(text, shared_chars + 1)").alias("t"), "start_line", "end_line")
    rows = pieces.groupBy("id").agg(
        F.array_sort(F.collect_list(own)).alias("p"),
        F.count_if((F.length("text") > 4000) | (F.col("end_line") - F.col("start_line") >= 50)).alias("over_limit"),
        F.min("start_line").alias("first_line"),
        F.max("end_line").alias("last_line"),
    )
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    gaps = F.size(F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.col("p")[i]["start_line"] > F.col("p")[i - 1]["end_line"] + 1))
    return rows.select("id", F.md5(whole.cast("binary")).alias("text_md5"), "over_limit", "first_line", "last_line", gaps.cast("long").alias("gaps"))


@registry.query(f"select scope, count(*) as over_limit, max(length(text)) as longest from (select distinct id, scope, text from code_chunks where {_OVER}) group by scope")
def p5_by_scope(spark, d):
    """Chunks over the limit per scope."""
    rows = oversized(table(spark, d, "code_chunks").select("id", "scope", "text")).distinct()
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("over_limit"), F.max(F.length("text")).alias("longest"))


@registry.query()
def p8_ids(spark, d):
    """The ids of each document under the byte-level vocabulary of 50,000 entries."""
    return encode_table(table(spark, d, "documents")).select("doc_id", "ids")


@registry.query()
def p8_counts(spark, d):
    """Documents, tokens and characters per source."""
    counted = encode_table(table(spark, d, "documents"), keep=("source", "n_chars"), with_ids=False)
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("n_chars").alias("chars"), F.max("n_tokens").alias("longest"))


@registry.query("select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def p8_decoded(spark, d):
    """The texts that the ids decode to, which are those that were encoded."""
    return decode_table(encode_table(table(spark, d, "documents")), keep=("doc_id",)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@registry.query()
def p9_mix(spark, d):
    """The mix: blocks of tokens, each source with its target share."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@registry.query()
def p9_shares(spark, d):
    """The share each source was to have and the share it reached."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@registry.query(
    """with own as (select source, max((target_share, max_repeats)) as t from mix_targets where source is not null group by source),
    held as (select source, t[1] as share, source in (select source from documents where coalesce(text, '') <> '') as texts from own)
    select source, case when texts then round(share / sum(case when texts then share else 0 end) over (), 9) else 0 end as target_share, true as reached, true as capped from held"""
)
def p9_reached(spark, d):
    """Whether each source that has texts reached its share, within four blocks and two thousandths of the mix, and its caps hold."""
    mixed, report = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    live = F.when(F.col("source_tokens") > 0, F.col("target_share")).otherwise(0.0)
    rows = report.withColumn("want", F.round(live / F.sum(live).over(Window.partitionBy(F.lit(0))), 9))  # one row per listed source
    used = mixed.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times")).groupBy("source").agg(F.max("times").alias("most"))
    rows = rows.join(used, "source", "left")
    near = F.abs(F.col("actual_share") - F.col("want")) <= 0.002 + 256.0 / F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", F.col("want").alias("target_share"), near.alias("reached"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"))


#: all pairs, which only small tables allow
_BRUTE = """with u as (select vec_id, min(vector)::double[] as v from chunk_vectors where vec_id is not null and len(vector) = 64
    and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by vec_id),
  s as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as c from u a join u b on a.vec_id <> b.vec_id),
  r as (select a, b, c, row_number() over (partition by a order by c desc, b) as n from s)
  select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from r where n <= 10 and c >= 0.85"""


@registry.query(_BRUTE)
def p7_found(spark, d):
    """Pairs of similarity 0.85 or more of which one is among the other's ten nearest."""
    return similar_pairs(table(spark, d, "chunk_vectors"))


@registry.query()
def p7_degree(spark, d):
    """How often vectors are among others' ten nearest, by number of times."""
    near = most_similar(table(spark, d, "chunk_vectors"))
    return near.groupBy("neighbour").agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("vectors"))


@registry.query()
def p7_search(spark, d):
    """The ten nearest of every vector whose id is divisible by 20, itself included, by greedy search over the graph."""
    vectors = table(spark, d, "chunk_vectors")
    return search_similar(vectors, vectors.where("vec_id % 20 = 0"))


@registry.query(
    """select count(*) as queries, true as most from (select distinct vec_id from chunk_vectors where vec_id % 20 = 0 and len(vector) = 64
    and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0)"""
)
def p7_recall(spark, d):
    """Whether the greedy search finds nine of ten of the neighbours that a comparison with all vectors finds."""
    vectors = table(spark, d, "chunk_vectors")
    found = search_similar(vectors, vectors.where("vec_id % 20 = 0")).select(F.col("query").alias("query_id"), F.col("neighbour").alias("id"), F.lit(1).alias("hit"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = usable(vectors, "vec_id", "vector", 64).select("id", F.transform("v", lambda x: x.cast("double") / norm).alias("v"))
    every = vector_topk_many(units, units.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), 10, "id", "v")
    rows = every.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return rows.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("most"))


@registry.query()
def p10_found(spark, d):
    """Documents with unfilled places, and those that are filler, an error message or a notice."""
    return find_residue(table(spark, d, "documents")).select("doc_id")


@registry.query()
def p10_kept(spark, d):
    """Documents that remain per source, and those left out per kind."""
    documents = table(spark, d, "documents")
    out = find_residue(documents).select("doc_id", "kind")
    judged = documents.select("doc_id", "source").join(out, "doc_id", "left")
    return judged.groupBy("source", F.coalesce("kind", F.lit("kept")).alias("kind")).agg(F.count(F.lit(1)).alias("documents"))
