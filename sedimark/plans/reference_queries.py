"""Queries of the retrieval and analysis operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedimark.functions import code
from sedimark.operators import loc, project_map, search, styles, text_index, windows
from sedimark.operators import audit as layout
from sedimark.operators import edges as relations
from sedimark.plans.data_queries import UP
from sedimark.plans.registry import Registry, table
from sedimark.session import shared_folder
from sedimark.sources.versions import VersionedTable

registry = Registry()
QUERY = "stylesheets wrap rule panels"
ASKED = ("panels", "rule", "stylesheets", "wrap")


def _chunks(spark, d):
    """The chunk table without rows delivered twice."""
    return table(spark, d, "code_chunks").dropDuplicates(["id"])


_CHUNKS = "chunks as (select distinct on (id) * from code_chunks)"

# -- windows, lines, fusion --------------------------------------------------------------------------------------------

_LINES = """ls as (select doc_id, case when text = '' then []::varchar[] when right(text, 1) = chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from documents where text is not null)"""


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with {_LINES}, s as (select doc_id, l, len(l) as n, unnest(range(0, greatest(len(l) - 1, 0) + 1, {step})) as s from ls where len(l) > 0)
    select doc_id, (s + 1)::int as start_line, least(s + {size}, n)::int as end_line, array_to_string(l[s + 1:s + {size}], chr(10)) as text from s where s = 0 or s < n - {overlap}"""


@registry.query(_windows_sql(50, 10))
def line_windows(spark, d):
    """Windows of 50 lines that share ten."""
    return windows.line_windows(table(spark, d, "documents"), "doc_id")


@registry.query(_windows_sql(5, 1))
def line_windows_small(spark, d):
    """Windows of five lines that share one."""
    return windows.line_windows(table(spark, d, "documents"), "doc_id", size=5, overlap=1)


@registry.query(f"with {_LINES} select len(l) <= 50 as single, count(*) as documents, sum(len(l))::bigint as lines from ls group by 1")
def small_file_gate(spark, d):
    """How many texts are a single chunk and how many are cut (B1, B2)."""
    n = F.size(code.lines(F.col("text")))
    return table(spark, d, "documents").where("text is not null").groupBy((n <= 50).alias("single")).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("lines"))


@registry.query(
    f"""with {_CHUNKS}, p as (select source, start_line, case when right(text, 1) = chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from chunks where text <> ''),
    n as (select source, start_line + i - 1 as line_no, max(l[i]) as line from (select *, unnest(range(1, len(l) + 1)) as i from p) group by all)
    select source, md5(string_agg(line, chr(10) order by line_no)) as content_md5, count(*) as lines from n group by source"""
)
def file_reassembly(spark, d):
    """Each file put together from its chunks, line by line."""
    whole = windows.reassemble(_chunks(spark, d).where("text != ''"))
    return whole.select("source", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("lines").cast("long").alias("lines"))


@registry.query(
    f"""with {_CHUNKS}, h as (select source, start_line, text, row_number() over (partition by source order by end_line - start_line desc, id) as rank from chunks where text <> ''),
    p as (select source, rank, start_line, case when right(text, 1) = chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from h),
    n as (select source, start_line + i - 1 as line_no, l[i] as line, rank from (select *, unnest(range(1, len(l) + 1)) as i from p)),
    w as (select source, line_no, arg_max(line, rank) as line from n group by source, line_no),
    g as (select *, line_no - row_number() over (partition by source order by line_no) as island from w)
    select source, min(line_no)::int as start_line, max(line_no)::int as end_line, md5(string_agg(line, chr(10) order by line_no)) as content_md5 from g group by source, island"""
)
def fuse_lines(spark, d):
    """Hits of each file fused into blocks of consecutive lines; a later rank wins on shared lines."""
    w = Window.partitionBy("source").orderBy((F.col("end_line") - F.col("start_line")).desc(), "id")
    hits = _chunks(spark, d).where("text != ''").withColumn("rank", F.row_number().over(w))
    blocks = windows.fuse(hits.select("source", "start_line", "text", "rank"), keep_order=False)
    return blocks.select("source", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@registry.query(
    """with t as (select source, doc_id, length(text) as n, sum(length(text)) over (partition by source order by doc_id rows unbounded preceding) as total from documents where text is not null and source is not null)
    select source, count(*) as kept, max(total)::bigint as used from t where total <= 15000 group by source"""
)
def char_budget(spark, d):
    """Per source the documents before the first that does not fit into 15,000 characters."""
    rows = table(spark, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.length("text").alias("n"))
    kept = windows.within_budget(rows, "doc_id", "n", 15_000, "source")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("used"))


# -- lines of code -----------------------------------------------------------------------------------------------------

_LOC = f"""{_CHUNKS}, f as (
  select source, max(end_line) as lines_total, sum(coalesce(lines_code, 0))::bigint as lines_code, count(*) as chunks_count from chunks where trim(source) <> '' group by source),
  files as (select *, case when j >= 400 then 'CRITICAL' when j >= 200 then 'WARNING' else 'OK' end as risk_level from (select *, case when lines_code > 0 then lines_code else lines_total end as j from f))"""


@registry.query(f"with {_LOC} select source, lines_total, lines_code, chunks_count, risk_level from files")
def loc_by_file(spark, d):
    """Lines, code lines, chunks and risk band of each file (F1)."""
    return loc.loc_by_file(_chunks(spark, d))


@registry.query(f"with {_LOC} select source, lines_total, risk_level from files where lines_total >= 200")
def loc_exceeding(spark, d):
    """Files of 200 lines or more."""
    return loc.exceeding(loc.loc_by_file(_chunks(spark, d))).select("source", "lines_total", "risk_level")


@registry.query(f"with {_LOC} select source, lines_total, lines_code from files order by lines_total desc, source limit 10")
def loc_top10(spark, d):
    """The ten longest files (H3)."""
    return loc.largest(loc.loc_by_file(_chunks(spark, d))).select("source", "lines_total", "lines_code")


@registry.query(f"with {_LOC} select coalesce(nullif(lower(regexp_extract(source, '[^/.](\\.[^./]*)$', 1)), ''), 'unknown') as ext, count(*) as file_count, sum(lines_total)::bigint as total_lines from files group by 1")
def loc_by_extension(spark, d):
    """Files and lines per extension."""
    return loc.loc_by_extension(loc.loc_by_file(_chunks(spark, d)))


@registry.query(f"with {_LOC} select count(*) as total_files, count_if(lines_total >= 200)::bigint as files_exceeding_threshold, 200::int as min_lines_threshold, sum(lines_total)::bigint as total_lines_codebase from files")
def loc_totals(spark, d):
    """Totals of the code base."""
    return loc.loc_totals(loc.loc_by_file(_chunks(spark, d)))


@registry.query(f"with {_LOC} select risk_level, count(*) as files from files group by 1")
def loc_risk_bands(spark, d):
    """Files per risk band."""
    return loc.loc_by_file(_chunks(spark, d)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("files"))


@registry.query(
    """select id, case when regexp_matches(source, '\\.css$') then len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S') and not regexp_matches(x, '^\\s*(/\\*|\\*|//)')))
    else len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S') and not regexp_matches(x, '^\\s*(//|#|/\\*|\\*)'))) end::int as lines_code from (select distinct on (id) * from code_chunks)"""
)
def code_line_counts(spark, d):
    """Code lines of each chunk."""
    rows = _chunks(spark, d)
    n = F.when(F.col("source").endswith(".css"), code.css_code_lines(F.col("text"))).otherwise(code.code_lines(F.col("text")))
    return rows.select("id", n.alias("lines_code"))


@registry.query(
    f"""with {_CHUNKS}, a as (select source, sum(end_line - start_line + 1)::bigint as counted, max(end_line)::bigint as lines from chunks group by source)
    select sum(counted)::bigint as counted, sum(lines)::bigint as lines, count_if(counted > lines)::bigint as files from a"""
)
def chunk_overlap_double_count(spark, d):
    """How far sums over chunks exceed the files' lines, since chunks overlap."""
    files = _chunks(spark, d).groupBy("source").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("counted"), F.max("end_line").cast("long").alias("lines"))
    return files.agg(F.sum("counted").alias("counted"), F.sum("lines").alias("lines"), F.count_if(F.col("counted") > F.col("lines")).alias("files"))


# -- project map -------------------------------------------------------------------------------------------------------

_CATEGORY = "case " + " ".join(f"when suffix(class_name, '{s}') then '{c}'" for s, c in code.CATEGORIES.items()) + " else 'Other' end"
_CLASSES = f"cl as (select coalesce(scope, 'unknown') as scope, trim(class_name) as class_name, min(source) as source from code_chunks where trim(coalesce(class_name, '')) <> '' group by all), cc as (select *, {_CATEGORY} as category from cl)"


@registry.query(f"with {_CLASSES} select scope, category, class_name, source, array_to_string(string_split(source, '/')[-2:], '/') as path from cc")
def project_map_classes(spark, d):
    """Each class once per scope with its category and path."""
    return project_map.classes(table(spark, d, "code_chunks"))


@registry.query(f"with {_CLASSES} select scope, category, string_agg(class_name, ', ' order by class_name) as classes, count(*) as n from cc group by all")
def project_map_categories(spark, d):
    """The classes of each scope by category, as text."""
    return project_map.category_lists(table(spark, d, "code_chunks")).drop("place")


@registry.query("select coalesce(scope, 'unknown') as scope, count(distinct source) as files from code_chunks where source <> '' group by 1")
def project_map_scopes(spark, d):
    """Files per scope."""
    return project_map.scope_files(table(spark, d, "code_chunks"))


@registry.query(
    """with m as (select distinct trim(models) as m from code_chunks where trim(coalesce(models, '')) <> ''),
    x as (select trim(unnest(case when json_valid(m) and m like '[%' then from_json(m, '["varchar"]') else string_split(m, ',') end)) as model from m) select distinct model from x where model <> ''"""
)
def project_map_models(spark, d):
    """The models that chunks name."""
    return project_map.models(table(spark, d, "code_chunks"))


@registry.query(
    """with f as (select distinct source, string_split(source, '/') as p from code_chunks where source is not null), x as (select p, unnest(range(1, len(p))) as i from f)
    select array_to_string(p[:i], '/') as path, count(*) as files, i::int as depth from x group by path, i"""
)
def dir_tree(spark, d):
    """Every folder with its depth and the files below it."""
    return project_map.directories(table(spark, d, "code_chunks"))


# -- retrieval ---------------------------------------------------------------------------------------------------------

_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


def _bm25_sql(asked=ASKED, rows="documents", key="doc_id") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) as f{i}" for i, q in enumerate(asked))
    df = ", ".join(f"count_if(f{i} > 0) as df{i}" for i in range(len(asked)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(asked)))
    some = " or ".join(f"f{i} > 0" for i in range(len(asked)))
    return f"""cut as (select {key}, {_TERMS} as t from {rows} where text is not null), counted as (select {key}, len(t) as dl, {tf} from cut),
    stats as (select count(*) as n, avg(dl) as avgdl, {df} from counted), scored as (select {key} as id, round({score}, 6) as score from counted, stats where {some})"""


@registry.query(f"with {_bm25_sql()} select id, score from scored")
def bm25_scores(spark, d):
    """Full-text scores of all documents that hold a term."""
    return search.bm25(table(spark, d, "documents"), QUERY, "doc_id")


@registry.query(f"with {_bm25_sql()} select id, score, row_number() over (order by score desc, id)::int as rank from scored order by score desc, id limit 10")
def bm25_topk(spark, d):
    """The ten best documents by full text."""
    return search.text_topk(table(spark, d, "documents"), QUERY, 10, "doc_id")


def _probe(n: int) -> list[float]:
    return [round(((i * 7 + n * 3) % 11 - 5) / 10.0, 3) for i in range(64)]


def _l2_sql(vector: str, probe: list[float]) -> str:
    return f"round(sqrt(list_sum(list_transform(range(1, 65), lambda i: ({vector}[i]::double - ({probe}::double[])[i]) * ({vector}[i]::double - ({probe}::double[])[i])))), 6)"


@registry.query(f"select vec_id as id, {_l2_sql('embedding', _probe(1))} as distance, row_number() over (order by {_l2_sql('embedding', _probe(1))}, vec_id)::int as rank from embeddings order by distance, id limit 10")
def vector_topk(spark, d):
    """The ten nearest vectors."""
    return search.vector_topk(table(spark, d, "embeddings"), _probe(1), 10, "vec_id", "embedding")


@registry.query(f"select vec_id as id, {_l2_sql('embedding', _probe(2))} as distance, row_number() over (order by {_l2_sql('embedding', _probe(2))}, vec_id)::int as rank from embeddings where label = 3 order by distance, id limit 5")
def vector_topk_filtered(spark, d):
    """The five nearest vectors of one label: the filter comes before the limit."""
    return search.vector_topk(table(spark, d, "embeddings"), _probe(2), 5, "vec_id", "embedding", F.col("label") == 3)


@registry.query(
    """with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i]::double - embedding[i]::double) * (v[i]::double - embedding[i]::double)))), 6) as distance from q, embeddings),
    r as (select *, row_number() over (partition by query_id order by distance, id)::int as rank from s) select * from r where rank <= 5"""
)
def vector_topk_multi(spark, d):
    """The five nearest of every vector whose id is divisible by 20, against all."""
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_topk_many(rows, queries, 5, "vec_id", "embedding")


_RERANK = f"""with {_bm25_sql()}, c as (select id from scored order by score desc, id limit 30),
    j as (select c.id, round(len(list_filter({list(ASKED)}, lambda q: list_contains({_TERMS}, q))) * 5.0::double - 10.0, 6) as score from c join documents on doc_id = c.id)"""


@registry.query(f"{_RERANK} select id, score, row_number() over (order by score desc, id)::int as rank from j where score >= -2.0 order by score desc, id limit 4")
def rerank_threshold(spark, d):
    """Thirty candidates reranked, those under the threshold dropped, the best four kept."""
    documents = table(spark, d, "documents")
    found = search.text_topk(documents, QUERY, 30, "doc_id")
    texts = found.join(documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return search.rerank(texts, QUERY, 4).select("id", "score", "rank")


@registry.query("select 'NO_CONTEXT' as status, 0::bigint as hits")
def no_context(spark, d):
    """A query that nothing answers: the gate leaves no row, and the status says so."""
    documents = table(spark, d, "documents")
    found = search.text_topk(documents, "zzzzqq xxyyzz", 30, "doc_id").join(documents.select(F.col("doc_id").alias("id"), "text"), "id")
    kept = search.rerank(found, "zzzzqq xxyyzz", 4)
    return kept.agg(F.count(F.lit(1)).alias("hits")).select(F.when(F.col("hits") > 0, "OK").otherwise("NO_CONTEXT").alias("status"), "hits")


CODE_QUERY = "export class service ledger ticket"
_CODE_ASKED = tuple(sorted(CODE_QUERY.split()))
_FUSED = f"""with chunks as (select distinct on (id) * from code_chunks where id is not null and text is not null), {_bm25_sql(_CODE_ASKED, "chunks", "id")},
  vectors as (select chunk_id as id, min(vector) as v from chunk_vectors where chunk_id in (select id from chunks) and len(vector) = 64 and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 group by chunk_id),
  near as (select id, {_l2_sql("v", _probe(1))} as distance from vectors),
  a as (select id, row_number() over (order by distance, id) as a from near order by a limit 30), b as (select id, row_number() over (order by score desc, id) as b from scored order by b limit 30),
  f as (select coalesce(a.id, b.id) as id, round(coalesce(1.0::double / (60 + a), 0) + coalesce(1.0::double / (60 + b), 0), 9) as score from a full join b on a.id = b.id order by score desc, id limit 30)"""
_RETRIEVED = f"""{_FUSED},
  j as (select c.*, round(len(list_filter({list(_CODE_ASKED)}, lambda q: list_contains({_TERMS}, q))) * {20.0 / len(_CODE_ASKED)}::double - 10.0, 6) as judged from f join chunks c using (id)),
  best as (select *, row_number() over (order by judged desc, id) as rank from j where judged >= -2.0 order by judged desc, id limit 8),
  p as (select source, rank, start_line, case when right(text, 1) = chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as l from best),
  n as (select source, start_line + i - 1 as line_no, l[i] as line, rank from (select *, unnest(range(1, len(l) + 1)) as i from p)),
  w as (select source, line_no, arg_max(line, rank) as line from n group by source, line_no),
  g as (select *, line_no - row_number() over (partition by source order by line_no) as island from w), o as (select source, min(rank) as file_rank from best group by source)
  select g.source as source, min(line_no)::int as start_line, max(line_no)::int as end_line, string_agg(line, chr(10) order by line_no) as content, any_value(file_rank)::int as file_rank from g join o on g.source is not distinct from o.source group by g.source, island"""


def _fused(spark, d):
    """Chunks, and the thirty best by vector and text with their ``score`` and ``rank``."""
    chunks = table(spark, d, "code_chunks").where("id is not null and text is not null").dropDuplicates(["id"])
    v = F.col("vector")
    fine = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = table(spark, d, "chunk_vectors").where(fine).groupBy(F.col("chunk_id").alias("id")).agg(F.min("vector").alias("vector")).join(chunks.select("id"), "id", "left_semi")
    return chunks, search.fuse_ranks(search.vector_topk(vectors, _probe(1), 30), search.text_topk(chunks, CODE_QUERY, 30), 30)


@registry.query(f"{_FUSED} select id, score, 'rrf' as score_kind, row_number() over (order by score desc, id)::int as rank from f")
def hybrid_rrf(spark, d):
    """Chunks by vector and by text, fused by reciprocal rank."""
    return _fused(spark, d)[1]


@registry.query(_RETRIEVED)
def hybrid_retrieval(spark, d):
    """The whole read path over chunks with stored vectors: vector and text search fused, reranked, gated, fused into blocks."""
    chunks, hits = _fused(spark, d)
    best = search.rerank(chunks.join(F.broadcast(hits.select("id")), "id"), CODE_QUERY, 8)  # at most 30 rows
    return windows.fuse(best.select("source", "start_line", "text", "rank")).orderBy("file_rank", "source", "start_line")


@registry.query(f"with {_bm25_sql()} select id, score, row_number() over (order by score desc, id)::int as rank from scored order by score desc, id limit 10")
def index_topk(spark, d):
    """The ten best documents by full text from an inverted index, half of whose rows were replaced since."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    held = VersionedTable(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", by="bucket")
    held.commit(text_index.postings(rows.withColumn("text", F.when(F.col("id") % 2 == 0, F.concat(F.lit("panels panels "), F.col("id").cast("string"))).otherwise(F.col("text")))), append=True)
    again = rows.where("id % 2 = 0")
    held.commit(text_index.postings(again), again.select("id"), append=True)
    size = text_index.lengths(rows).agg(F.count("n_terms"), F.avg("n_terms")).first()
    return search.ranked(text_index.bm25(held.read(), size[0], size[1], QUERY), 10)


@registry.query("select term, count(*) as documents, sum(tf)::bigint as times from (select doc_id, term, count(*) as tf from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from documents where text is not null) group by all) group by term")
def index_terms(spark, d):
    """Documents and occurrences of every term, from the postings."""
    return text_index.postings(table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("times"))


@registry.query("select lang, count(*) as n from documents where lang = 'en' and source = 'runbooks' group by lang")
def filter_equalities(spark, d):
    """Conjunction of equalities with literals."""
    return table(spark, d, "documents").where(search.matches(lang="en", source="runbooks", doc_kind=None)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# -- text formatting ---------------------------------------------------------------------------------------------------


@registry.query(
    "select doc_id, md5(replace(replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\p{Cf}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as escaped_md5 from documents where text is not null"
)
def xml_escape(spark, d):
    """Texts with markup escaped and control characters gone (C20)."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(code.xml_escape(F.col("text")).cast("binary")).alias("escaped_md5"))


_COMPRESS = """with c as (select distinct on (id) id, source, text from code_chunks where text <> ''),
  l as (select id, regexp_extract(source, '\\.[^./]*$') as ext, case when right(text, 1) = chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as ls from c),
  k as (select id, list_transform(list_filter(ls, lambda x: not (case
     when ext in ('.ts', '.js', '.tsx', '.prisma') then (regexp_matches(x, '^\\s*//') and not regexp_matches(x, '^\\s*//\\s*@(ts-|eslint-|ng)')) or regexp_matches(x, '^\\s*/\\*.*\\*/\\s*$')
     when ext = '.py' then regexp_matches(x, '^\\s*#') and not regexp_matches(x, '^\\s*#\\s*(type:|pylint:|coding:)')
     when ext in ('.html', '.htm') then regexp_matches(x, '^\\s*<!--.*-->\\s*$') else false end)), lambda x: regexp_replace(x, '\\s+$', '')) as ks from l)
  select id, md5(array_to_string(list_transform(list_filter(range(1, len(ks) + 1), lambda i: ks[i] <> '' or i = 1 or ks[i - 1] <> ''), lambda i: ks[i]), chr(10))) as compressed_md5 from k"""


@registry.query(_COMPRESS)
def compress_comments(spark, d):
    """Chunks without whole-line comments and repeated blank lines."""
    rows = _chunks(spark, d).where("text != ''")
    return rows.select("id", F.md5(code.compress_code(F.col("text"), code.extension(F.col("source"))).cast("binary")).alias("compressed_md5"))


@registry.query("select doc_id, case when length(t) <= 400 then t when strpos(left(t, 400), '</file>') > 0 then left(left(t, 400), 400 - strpos(reverse(left(t, 400)), '>elif/<') + 1) || chr(10) || '[TRUNCATED]' else left(t, 400) || chr(10) || '[TRUNCATED]' end as cut from (select doc_id, '<file>' || left(text, 120) || '</file>' || substr(text, 121) as t from documents where text is not null)")
def truncate_safe(spark, d):
    """Contexts cut behind the last closing tag within a limit."""
    t = F.concat(F.lit("<file>"), F.substring("text", 1, 120), F.lit("</file>"), F.expr("substring(text, 121)"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", code.truncate_safe(t, 400).alias("cut"))


@registry.query(
    f"""with {_CHUNKS}, e as (select id, text, lower(regexp_extract(source, '[^/.](\\.[^./]*)$', 1)) as ext from chunks where text is not null)
    select id, not regexp_matches(case when ext in ('.ts', '.js') then regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g') when ext = '.prisma' then regexp_replace(text, '//[^\\n]*', '', 'g')
      when ext = '.html' then regexp_replace(text, '(?s)<!--.*?-->', '', 'g') when ext = '.css' then regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g') else text end, '\\S') as blank from e"""
)
def blank_chunks(spark, d):
    """Chunks without anything but comments and white space."""
    rows = _chunks(spark, d).where("text is not null")
    return rows.select("id", code.comment_only(F.col("text"), code.extension(F.col("source"))).alias("blank"))


@registry.query("select content_hash, count(*) as documents from (select sha256(text) as content_hash from documents where text is not null) group by 1 having count(*) > 1")
def content_hash_dupes(spark, d):
    """Texts that are there more than once, by content hash."""
    hashed = table(spark, d, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


# -- HTML and CSS ------------------------------------------------------------------------------------------------------

_HTML = "h as (select source, string_agg(text, chr(10) order by start_line, id) as html from (select distinct on (id) * from code_chunks) where source like '%.html' group by source)"


def _html(spark, d):
    rows = _chunks(spark, d).where("source like '%.html'")
    parts = F.array_sort(F.collect_list(F.struct("start_line", "id", "text")))
    return rows.groupBy("source").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("html"))


@registry.query(f"with {_HTML}, t as (select unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) as tag from h) select tag, count(*) as n from t group by tag")
def html_tag_counts(spark, d):
    """Element names and how often they open."""
    return _html(spark, d).select(F.explode(code.html_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    f"""with {_HTML}, v as (select source, unnest(list_concat(regexp_extract_all(html, '(?:className|class|\\[ngClass\\]|:class)\\s*=\\s*"([^">]+)"', 1), regexp_extract_all(html, '(?:className|class|\\[ngClass\\]|:class)\\s*=\\s*''([^''>]+)''', 1))) as v from h),
    w as (select source, unnest(regexp_split_to_array(regexp_replace(v, '\\$?\\{{[^}}]+\\}}', ' ', 'g'), '\\s+')) as cls from v
      union all select source, unnest(regexp_extract_all(html, '\\[class\\.([a-zA-Z0-9_-]+)\\]', 1)) from h union all select source, unnest(regexp_extract_all(html, 'class:([a-zA-Z0-9_-]+)', 1)) from h)
    select distinct source, cls from w where regexp_matches(cls, '^[a-zA-Z_][A-Za-z0-9_-]*$')"""
)
def html_classes(spark, d):
    """The classes of each HTML file."""
    return _html(spark, d).select("source", F.explode(code.html_classes(F.col("html"))).alias("cls"))


@registry.query(f"with {_HTML}, t as (select source, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) as tag from h) select distinct source, tag as directive from t where tag like '%-%'")
def html_directives(spark, d):
    """Elements with a hyphen in their name."""
    return _html(spark, d).select("source", F.explode(code.html_directives(F.col("html"))).alias("directive"))


_BARE = "regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), 'url\\([^)]+\\)', '', 'g')"
_CSS = f"c as (select source, {_BARE} as css from (select distinct on (id) * from code_chunks) where source like '%.css' and text is not null)"


@registry.query(f"with {_CSS}, v as (select source, unnest(regexp_extract_all(css, '(--[a-zA-Z0-9_-]+)', 1)) as variable from c) select distinct source, variable from v")
def css_variables(spark, d):
    """Custom properties per style sheet."""
    rows = _chunks(spark, d).where("source like '%.css' and text is not null")
    return rows.select("source", F.explode(code.css_variables(F.col("text"))).alias("variable")).distinct()


@registry.query(
    f"""with {_CSS}, q as (select source, string_split(css, '.') as p from c), i as (select source, p, unnest(range(2, len(p) + 1)) as i from q),
    n as (select source, regexp_extract(p[i], '^([a-zA-Z_][a-zA-Z0-9_-]*)(?:[ \\t\\r\\n:,>+~\\[]|$)', 1) as cls, right(p[i - 1], 1) as before, i from i)
    select source, cls, count(*) > 0 as named from n where cls <> '' and not regexp_matches(before, '[0-9]') and (before <> '' or i = 2) group by source, cls"""
)
def css_class_names(spark, d):
    """The classes that the selectors of each style sheet's pieces name."""
    rows = _chunks(spark, d).where("source like '%.css' and text is not null")
    return rows.select("source", F.explode(code.css_classes(F.col("text"))).alias("cls")).distinct().withColumn("named", F.lit(True))


_RULES = """rules as (select source as css_file, r.selector as selector, r.classes as classes, r.start_line as start_line, r.end_line as end_line, r.properties as properties, r.media_query as media_query
  from (select source, unnest(from_json(css_rules, '[{"selector":"varchar","classes":["varchar"],"start_line":"integer","end_line":"integer","properties":"map(varchar, varchar)","media_query":"varchar"}]')) as r
        from (select distinct source, css_rules from code_chunks where coalesce(css_rules, '') <> '' and json_valid(css_rules))))"""
_RULE_ROWS = f"{_RULES}, ruled as (select distinct css_file, selector, array_to_string(classes, ' ') as cls, start_line, end_line, media_query, map_entries(properties) as p from rules)"


@registry.query(f"with {_RULES} select css_file, count(distinct (selector, start_line)) as rules from rules group by css_file")
def css_rules_by_file(spark, d):
    """Rules per style sheet from the packed column (C11)."""
    rules = styles.rules_of(table(spark, d, "code_chunks"))
    return rules.groupBy("css_file").agg(F.count_distinct("selector", "start_line").alias("rules"))


@registry.query(f"with {_RULES} select property, count(*) as rules from (select distinct css_file, selector, start_line, unnest(map_keys(properties)) as property from rules) group by property")
def css_properties(spark, d):
    """How many rules set each property."""
    rules = styles.rules_of(table(spark, d, "code_chunks"))
    return rules.select("css_file", "selector", "start_line", F.explode(F.map_keys("properties")).alias("property")).distinct().groupBy("property").agg(F.count(F.lit(1)).alias("rules"))


@registry.query()
def component_css_trace(spark, d):
    """How many rules style each component, by class."""
    chunks = table(spark, d, "code_chunks")
    return styles.trace_summary(styles.consumed(chunks), styles.rules_of(chunks))


@registry.query()
def component_css_rules(spark, d):
    """The rules of every component of a repository, one row each, and its classes without a rule."""
    chunks = table(spark, d, "code_chunks")
    return styles.component_trace(styles.consumed(chunks), styles.rules_of(chunks), within_repository=True)


@registry.query()
def dead_css(spark, d):
    """Classes that style sheets declare and nothing uses."""
    chunks = table(spark, d, "code_chunks")
    return styles.dead_classes(styles.declared(chunks), styles.consumed(chunks))


@registry.query()
def audit_issues(spark, d):
    """All six layout-risk checks over the rules."""
    chunks = table(spark, d, "code_chunks")
    return layout.audit(styles.rules_of(chunks), layout.ancestors(styles.component_texts(chunks)))


@registry.query()
def audit_counts(spark, d):
    """Issues per category and severity."""
    chunks = table(spark, d, "code_chunks")
    issues = layout.audit(styles.rules_of(chunks), layout.ancestors(styles.component_texts(chunks)))
    return issues.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("issues"))


_PROPS = ", ".join(f"lower(coalesce(properties['{p}'], '')) as {p.replace('-', '_')}" for p in layout.PROPERTIES)
_RESETS = ", ".join(f"'{x}'" for x in layout.RESETS)
_R = f"""{_RULES}, r as (select distinct css_file, trim(selector) as selector, lower(trim(selector)) as low, start_line, end_line, coalesce(media_query, '') as media, {_PROPS} from rules),
  every as (select * from r where low not in ({_RESETS}) and low not like '*%'), live as (select * from every where not regexp_matches(low, '{layout.PSEUDO}'))"""


def _words(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SCROLLS = "(" + " or ".join(_words(c, ("hidden", "auto", "scroll")) for c in ("overflow", "overflow_x", "overflow_y")) + ")"
_FIXED = "(suffix(width, 'px') and suffix(height, 'px'))"
_ROW = "css_file as file, start_line, end_line, selector"


@registry.query(
    f"""with {_R} select {_ROW} from every where (contains(display, 'flex') or contains(display, 'grid') or flex <> '' or flex_grow in ('1', '2', '3') or contains(low, 'flex'))
    and not (flex_shrink = '0' or contains(flex, '0 0 ') or flex = 'none') and not {_FIXED} and not (min_width in ('0', '0px', '0%', 'none') or min_height in ('0', '0px', '0%', 'none') or {_SCROLLS}) and {_words('low', layout.SHRINKING)}"""
)
def audit_flex(spark, d):
    """Boxes that cannot shrink below their content, however severe."""
    rows = layout.with_mitigation(layout.prepared(styles.rules_of(table(spark, d, "code_chunks"))), spark.createDataFrame([], "child string, parent string"))
    return layout.flex_overflow(rows).select("file", "start_line", "end_line", "selector")


@registry.query(f"with {_R} select {_ROW} from live where contains(display, 'flex') and not contains(flex_direction, 'column') and {_words('low', layout.COLLECTIONS)} and flex_wrap not in ('wrap', 'wrap-reverse') and not {_SCROLLS} and not {_FIXED}")
def audit_wrap(spark, d):
    """Horizontal boxes of many items that do not wrap."""
    rows = layout.with_mitigation(layout.prepared(styles.rules_of(table(spark, d, "code_chunks"))), spark.createDataFrame([], "child string, parent string"))
    return layout.flex_wrap(rows).select("file", "start_line", "end_line", "selector")


def _px_sql(column: str) -> str:
    return f"coalesce(try_cast(regexp_extract(trim({column}), '(?i)^([0-9.]+)\\s*(?:px|rem|em)$', 1) as double) * case when regexp_matches(trim({column}), '(?i)px$') then 1 else 16 end, 0)"


_LIMIT = "try_cast(regexp_extract(media, '(?i)max-width\\s*:\\s*([0-9.]+)\\s*(?:px|rem|em)', 1) as double) * case when lower(regexp_extract(media, '(?i)max-width\\s*:\\s*[0-9.]+\\s*(px|rem|em)', 1)) = 'px' then 1 else 16 end"


@registry.query(
    f"""with {_R}, w as (select *, {_LIMIT} as lim, greatest({_px_sql('min_width')}, {_px_sql('width')}, coalesce(list_sum(list_transform(regexp_extract_all(grid_template_columns, '([0-9.]+)\\s*px', 1), lambda x: try_cast(x as double))), 0)) as wide from live)
    select {_ROW} from w where lim is not null and wide > 0 and wide >= lim"""
)
def audit_breakpoint(spark, d):
    """Widths that reach the limit of their media query."""
    return layout.breakpoint_width(layout.prepared(styles.rules_of(table(spark, d, "code_chunks")))).select("file", "start_line", "end_line", "selector")


@registry.query(f"with {_R} select {_ROW} from live where {_words('low', layout.DYNAMIC_TEXT)} and not {_words('low', layout.COMPACT)} and word_break not in ('break-word', 'break-all') and overflow_wrap not in ('break-word', 'anywhere') and not contains(text_overflow, 'ellipsis')")
def audit_text_break(spark, d):
    """Boxes of running text without a rule for long words."""
    return layout.text_break(layout.prepared(styles.rules_of(table(spark, d, "code_chunks")))).select("file", "start_line", "end_line", "selector")


@registry.query(f"with {_R} select css_file as file, start_line, end_line, selector from live where suffix(width, 'px') and max_width = '' and try_cast(regexp_replace(width, '[^0-9]', '', 'g') as bigint) > 400")
def audit_fixed_width(spark, d):
    """Rules of a fixed width over 400 px without a maximum (P5)."""
    return layout.fixed_width(layout.prepared(styles.rules_of(table(spark, d, "code_chunks")))).select("file", "start_line", "end_line", "selector")


@registry.query(f"with {_R} select css_file as file, start_line, end_line, selector from live where z_index <> '' and try_cast(regexp_replace(z_index, '[^0-9-]', '', 'g') as bigint) >= 100 and isolation <> 'isolate' and position not in ('relative', 'absolute', 'fixed', 'sticky')")
def audit_zindex(spark, d):
    """Rules of a high z-index without a stacking context."""
    return layout.z_index(layout.prepared(styles.rules_of(table(spark, d, "code_chunks")))).select("file", "start_line", "end_line", "selector")


# -- edges, upserts, snapshots -----------------------------------------------------------------------------------------


@registry.query("select relationship_type, count(*) as edges, count(distinct source_file) as files, count(distinct target_symbol) as targets from (select distinct source_file, target_symbol, relationship_type from code_relationships) group by 1")
def edge_counts(spark, d):
    """Distinct edges per type."""
    edges = table(spark, d, "code_relationships").select("source_file", "target_symbol", "relationship_type").distinct()
    return edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source_file").alias("files"), F.count_distinct("target_symbol").alias("targets"))


@registry.query()
def edges_extract(spark, d):
    """Edges from the packed fields of the chunks."""
    return relations.extract(table(spark, d, "code_chunks"))


@registry.query(
    """with h as (select source as source_file, source as rank from (select distinct source from code_chunks where source like '%-beacon.service.ts')),
    e as (select distinct h.rank, r.source_file, trim(r.target_symbol, ' "''`') as target from code_relationships r join h using (source_file) where relationship_type = 'depends_on'),
    k as (select distinct trim(class_name) as target, min(source) as file from code_chunks where trim(coalesce(class_name, '')) <> '' and class_name not like '%,%' group by 1),
    j as (select e.rank, e.target, k.file from e join k using (target) where regexp_matches(e.target, '^[A-Z]') and k.file not in (select source_file from h)),
    f as (select file, min((rank, target)) as m from j group by file)
    select file, m[1] as rank, m[2] as target from f order by m[1], m[2], file limit 15"""
)
def edges_enrich_top15(spark, d):
    """Files that hits depend on, each once in order of the hits, fifteen at most."""
    chunks, edges = table(spark, d, "code_chunks"), table(spark, d, "code_relationships")
    hits = chunks.where("source like '%-beacon.service.ts'").select("source").distinct()
    hits = hits.withColumn("rank", F.col("source"))
    return relations.dependency_files(hits, edges, chunks, 15)


_TRIMMED = "regexp_replace(target_symbol, '^[\\s\"''`]+|[\\s\"''`]+$', '', 'g')"
_NO_MODELS = ", ".join(f"'{x}'" for x in relations.PRISMA_TYPES)
_IMPORTS = f"""t as (select distinct source_file as source, {_TRIMMED} as t from code_relationships where relationship_type = 'import' and source_file is not null),
  r as (select *, case when contains(source, '/') then regexp_replace(source, '/[^/]*$', '') else '' end as folder, length(regexp_extract(t, '(?:from|import)\\s+(\\.+)', 1)) as dots,
    replace(regexp_extract(t, '(?:from|import)\\s+\\.+([A-Za-z_][A-Za-z0-9_.]*)', 1), '.', '/') as module from t),
  z as (select *, {UP.replace("(x,", "(folder || '/' || t,")} as path, array_to_string(list_filter([nullif(array_to_string(string_split(folder, '/')[1:greatest(len(string_split(folder, '/')) - dots + 1, 0)], '/'), ''), nullif(module, '')], lambda x: x is not null), '/') as base from r),
  c as (select source, t, case when dots > 0 then [base || '.py', base || '/__init__.py', base] when starts_with(t, '.') then list_transform(['', '.ts', '.tsx', '.js', '/index.ts', '/index.tsx', '/index.js'], lambda e: path || e) else [] end as files from z),
  x as (select source, t, unnest(files) as file, unnest(range(1, len(files) + 1)) as pos from c)"""


def _every_file(edges):
    return edges.where("source_file is not null").select(F.col("source_file").alias("source")).distinct().withColumn("rank", F.col("source"))


@registry.query(f"with {_IMPORTS} select source as rank, t as target, arg_min(file, pos) as file from x where file in (select source from code_chunks where source is not null) group by source, t")
def edges_imports(spark, d):
    """For every file, the files that its relative imports mean."""
    edges = table(spark, d, "code_relationships")
    return relations.import_files(_every_file(edges), edges, table(spark, d, "code_chunks")).select("rank", "target", "file")


@registry.query(
    f"""with e as (select distinct source_file as rank, {_TRIMMED} as target from code_relationships where relationship_type = 'depends_on' and source_file is not null),
    k as (select trim(class_name) as target, min(source) as file from code_chunks where class_name is not null and trim(class_name) <> '' and not contains(trim(class_name), ',') group by 1)
    select rank, target, file from e join k using (target) where regexp_matches(target, '^[A-Z]') and target not in ({_NO_MODELS})"""
)
def edges_classes(spark, d):
    """For every file, the first files of the classes that it depends on."""
    edges = table(spark, d, "code_relationships")
    return relations.class_files(_every_file(edges), edges, table(spark, d, "code_chunks")).select("rank", "target", "file")


@registry.query(
    f"""with e as (select distinct source_file as rank, {_TRIMMED} as target from code_relationships where relationship_type = 'depends_on' and source_file like '%.prisma'),
    n as (select source, trim(unnest(string_split(class_name, ','))) as target from code_chunks where source like '%.prisma' and class_name is not null), k as (select target, min(source) as file from n where target <> '' group by 1)
    select rank, target, file from e join k using (target) where regexp_matches(target, '^[A-Z]') and target not in ({_NO_MODELS})"""
)
def edges_models(spark, d):
    """For every schema, the files of the models that it names."""
    edges = table(spark, d, "code_relationships")
    return relations.model_files(_every_file(edges), edges, table(spark, d, "code_chunks")).select("rank", "target", "file")


@registry.query("select source_file, target_symbol, relationship_type, false as fresh from code_relationships where split_part(source_file, '/', 2) <> 'src' union all select distinct source_file, 'again', 'import', true from code_relationships where split_part(source_file, '/', 2) = 'src'")
def edges_replaced(spark, d):
    """The edges after some files were read again: theirs are replaced, the others stay."""
    edges = table(spark, d, "code_relationships").where("source_file is not null").select("id", "source_file", "target_symbol", "relationship_type", F.lit(False).alias("fresh"))
    fresh = edges.where("split_part(source_file, '/', 2) = 'src'").select("source_file").distinct().select(F.col("source_file").alias("id"), "source_file", F.lit("again").alias("target_symbol"), F.lit("import").alias("relationship_type"), F.lit(True).alias("fresh"))
    return relations.replace_edges(edges, fresh).select("source_file", "target_symbol", "relationship_type", "fresh")


@registry.query(
    """with old as (select doc_id, text from documents where doc_id % 10 <> 3), new as (select doc_id, case when doc_id % 7 = 2 then coalesce(text, '') || '!' else text end as text from documents where doc_id % 11 <> 5)
    select case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.text is not distinct from n.text then 'kept' else 'changed' end as change, count(*) as documents from old o full join new n using (doc_id) group by 1"""
)
def snapshot_diff(spark, d):
    """Two snapshots compared: added, changed, removed and kept records."""
    from sedimark.operators.incremental import record_delta

    rows = table(spark, d, "documents").select("doc_id", "text")
    old = rows.where("doc_id % 10 != 3")
    new = rows.where("doc_id % 11 != 5").withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    delta = record_delta(old, new, "doc_id").select("doc_id", F.col("_change").alias("change"))
    every = old.select("doc_id").unionByName(new.select("doc_id")).distinct().join(delta, "doc_id", "left")
    return every.groupBy(F.coalesce("change", F.lit("kept")).alias("change")).agg(F.count(F.lit(1)).alias("documents"))


@registry.query("select doc_id, md5(coalesce(case when doc_id % 5 = 0 then 'new ' || doc_id else text end, '')) as text_md5 from documents where doc_id % 13 <> 4")
def upsert_and_delete(spark, d):
    """A versioned table after an upsert of every fifth record and a delete of others, compacted."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    held = VersionedTable(spark, f"{shared_folder(spark)}/upserted-{uuid.uuid4().hex}", "doc_id")
    held.commit(rows, append=True)
    held.commit(rows.where("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("new "), F.col("doc_id").cast("string"))))
    held.commit(deletes=rows.where("doc_id % 13 = 4").select("doc_id"))
    held.compact()
    return held.read().select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@registry.query("select doc_id, 768::int as dim, true as inside, true as alike from documents")
def mock_embedding(spark, d):
    """The stand-in vectors of the documents (J2): 768 numbers within -1..1, equal for equal texts."""
    rows = search.embed(table(spark, d, "documents").select("doc_id", "text"))
    # digests are compared, and merged by hint: the optimiser counts a list as one number and would broadcast lists of 768
    rows = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_text"), F.size("vector").alias("dim"), F.forall("vector", lambda x: (x >= -1) & (x <= 1)).alias("inside"), F.xxhash64("vector").alias("_digest"))
    first = rows.groupBy("_text").agg(F.min("_digest").alias("_first"))
    return rows.join(first.hint("merge"), "_text").select("doc_id", "dim", "inside", (F.col("_digest") == F.col("_first")).alias("alike"))
