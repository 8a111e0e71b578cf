"""Queries of the general data-processing operators over the driver's tables."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from sedimark.operators.incremental import diff_manifests, manifest_of_chunks, manifest_of_runs
from sedimark.operators.orphans import code_orphans, code_references
from sedimark.operators.packed import split_fields
from sedimark.plans.registry import Registry, table
from sedimark.session import shared_folder
from sedimark.sources.versions import VersionedTable, pending_files, process_new

registry = Registry()

_CONTENT = """
known as (
  select regexp_replace(regexp_replace(replace(trim(rel_path), chr(92), '/'), '/(\\.?/)+', '/', 'g'), '^(\\./|/)+', '') as path,
         regexp_replace(lower(trim(sha256)), '^sha-?256[:=]\\s*', '') as digest, r.finished_at, f.recorded_at, r.scope
  from file_state f join ingest_runs r using (run_id)
  where r.status = 'success' and r.finished_at is not null and trim(coalesce(sha256, '')) <> ''),
state as (
  select path, max_by(digest, (finished_at, recorded_at, digest)) as digest from known
  where digest <> '' and split_part(path, '/', 1) = scope group by path),
pieces as (
  select source, start_line, string_split(text, chr(10)) as ls, deleted_at from code_chunks where source is not null and text is not null),
numbered as (
  select source, start_line + i - 1 as n, max(ls[i]) as line, bool_and(deleted_at is not null) as gone
  from (select *, unnest(range(1, len(ls) + 1)) as i from pieces) group by source, start_line + i - 1),
files as (
  select source, sha256(string_agg(line, chr(10) order by n)) as digest, bool_and(gone) as gone from numbered group by source)
"""


@registry.query(f"with {_CONTENT} select f.source from files f left join state s on s.path = f.source where not f.gone and (s.digest is null or s.digest <> f.digest)")
def p1_found(spark, d):
    """Files that exist and are new or changed since the last successful run of their scope."""
    return pending_files(table(spark, d, "code_chunks"), table(spark, d, "file_state"), table(spark, d, "ingest_runs")).select(F.col("path").alias("source"))


@registry.query(
    f"""with {_CONTENT}, live as (select * from files where not gone),
    diff as (select coalesce(f.source, s.path) as path,
      case when s.path is null then 'added' when f.source is null then 'removed' when s.digest = f.digest then 'kept' else 'changed' end as change
      from live f full join state s on s.path = f.source)
    select split_part(path, '/', 1) as scope, change, count(*) as files from diff group by all"""
)
def p1_changes(spark, d):
    """Per scope, how many files the manifests' difference adds, changes, removes and keeps."""
    old = manifest_of_runs(table(spark, d, "file_state"), table(spark, d, "ingest_runs"))
    delta = diff_manifests(old, manifest_of_chunks(table(spark, d, "code_chunks")))
    return delta.groupBy(F.substring_index("path", "/", 1).alias("scope"), "change").agg(F.count(F.lit(1)).alias("files"))


@registry.query(
    """with v2 as (select doc_id, case when doc_id % 5 <> 0 then text when doc_id % 2 = 0 then 'new ' || doc_id end as text, case when doc_id % 5 = 0 then 2 else 1 end as run from documents where doc_id % 5 = 0 or doc_id % 13 <> 4)
    select doc_id, md5(text) as text_md5, run::int as run from v2 where text is not null and doc_id % 17 <> 3"""
)
def p1_records(spark, d):
    """What a consumer holds of a table that was changed, compacted and rebuilt between its runs, one of which died.

    ``run`` is the run that processed the record: a record fed twice would have a later one, a lost delete would be a
    row too many, and so would the old output of a record whose new text is null, which the consumer leaves out.
    """
    rows = table(spark, d, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    source, target = VersionedTable(spark, f"{folder}/source", "doc_id"), VersionedTable(spark, f"{folder}/target", "doc_id")

    def run(number: int, fails: bool = False) -> None:
        def fn(delta):
            if fails:
                raise InterruptedError
            return delta.where("text is not null").withColumn("run", F.lit(number))

        process_new(source, target, fn)

    source.commit(rows, append=True)
    run(1)
    fresh = rows.where("doc_id % 5 = 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new "), F.col("doc_id").cast("string"))))
    source.commit(fresh, rows.where("doc_id % 13 = 4").select("doc_id"))
    source.compact()
    with contextlib.suppress(InterruptedError):
        run(2, fails=True)
    run(2)
    source.commit(source.read().where("doc_id % 17 != 3"), append=True, rebuild=True)
    run(3)
    return target.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "run")


UP = "x"
for _ in range(8):
    UP = f"regexp_replace({UP}, '(^|/)(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\.(/|$)', '\\1')"
UP = UP.replace("(x,", "(regexp_replace(regexp_replace(x, '(/\\.)+(/|$)', '\\2', 'g'), '^\\./', ''),", 1)

_ORPHANS = f"""
refs as (
  select id, min(recorded_at) as seen, any_value(source_file) as source_file, any_value(relationship_type) as kind,
    regexp_replace(any_value(target_symbol), '^[\\s"''`]+|[\\s"''`]+$', '', 'g') as t
  from code_relationships group by id),
r as (
  select *, split_part(source_file, '/', 1) as scope, regexp_replace(source_file, '/[^/]*$', '') as folder,
    regexp_matches(t, '^(from|import)\\s') as py, length(regexp_extract(t, '^from\\s+(\\.+)', 1)) as dots,
    replace(regexp_extract(t, '^from\\s+\\.+([^\\s.]\\S*)', 1), '.', '/') as module
  from refs where t <> '' and kind in ('import', 'depends_on') and not (kind = 'depends_on' and starts_with(t, '--'))),
resolved as (
  select *, {UP.replace("(x,", "(folder || '/' || t,")} as path,
    array_to_string(string_split(folder, '/')[1:len(string_split(folder, '/')) - dots + 1], '/') || case when module <> '' then '/' || module else '' end as pymodule
  from r),
keys as (
  select id, seen, kind, unnest(case
    when kind = 'depends_on' then ['class:' || scope || '/' || t]
    when py and dots > 0 then ['file:' || pymodule || '.py', 'file:' || pymodule || '/__init__.py']
    when py then ['package:' || regexp_extract(t, '^(?:from|import)\\s+([^\\s,;.]+)', 1)]
    when starts_with(t, '.') then list_transform(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], lambda e: 'file:' || path || e)
    when starts_with(t, '@') then ['package:' || split_part(t, '/', 1) || '/' || split_part(t, '/', 2)]
    else ['package:' || split_part(t, '/', 1)] end) as key
  from resolved),
parents as (
  select distinct 'file:' || source as key, indexed_at as since, deleted_at as until from code_chunks where source is not null
  union all
  select distinct 'class:' || split_part(source, '/', 1) || '/' || trim(name), indexed_at, deleted_at
  from (select source, indexed_at, deleted_at, unnest(string_split(class_name, ',')) as name from code_chunks where class_name is not null) where trim(name) <> ''
  union all
  select 'package:' || package_name, listed_at, removed_at from package_index),
met as (select distinct k.id from keys k join parents p on p.key = k.key and p.since <= k.seen and (p.until is null or k.seen < p.until)),
lost as (select distinct id, kind, seen from keys where id not in (select id from met))
"""


@registry.query(f"with {_ORPHANS} select id from lost")
def p4_found(spark, d):
    """References whose file, class or package was not there when they were recorded."""
    return code_orphans(table(spark, d, "code_relationships"), table(spark, d, "code_chunks"), table(spark, d, "package_index")).select("id")


@registry.query(
    f"""with {_ORPHANS}, every as (select distinct id, kind, seen from keys)
    select e.kind as relationship_type, strftime(e.seen, '%Y-%m') as month, count(*) as refs, count(l.id) as orphans
    from every e left join lost l on l.id = e.id group by all"""
)
def p4_counts(spark, d):
    """Orphans and references per relationship type and month of the reference."""
    edges = table(spark, d, "code_relationships")
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    found = code_orphans(edges, table(spark, d, "code_chunks"), table(spark, d, "package_index"))
    lost = found.groupBy("relationship_type", month("recorded_at")).agg(F.count(F.lit(1)).alias("orphans"))
    every = code_references(edges).groupBy(F.col("ref.kind").alias("relationship_type"), month("at")).agg(F.count(F.lit(1)).alias("refs"))
    return every.join(lost, ["relationship_type", "month"], "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))


PACKED = ["imports", "dependencies", "tags", "models"]


@registry.query()
def p6_found(spark, d):
    """One row per value of the packed fields, with its position."""
    rows = split_fields(table(spark, d, "code_chunks"), "id", PACKED, ("imports",), "source")
    return rows.select("id", "field_name", "pos", "item")


@registry.query()
def p6_flags(spark, d):
    """Values per field and error flag."""
    rows = split_fields(table(spark, d, "code_chunks"), "id", PACKED, ("imports",), "source")
    return rows.groupBy("field_name", "error").agg(F.count(F.lit(1)).alias("items"), F.max("pos").alias("longest"))
