"""Incremental ingest of a repository, and of a stream of files."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.config import DEFAULTS, Settings
from sedimark.operators import search, text_index
from sedimark.operators.chunkers import chunk_files
from sedimark.operators.incremental import ADDED, CHANGED, KEPT, REMOVED, diff_manifests
from sedimark.sources import files as sources
from sedimark.sources.versions import VersionedTable


log = logging.getLogger(__name__)


class NoRoot(ValueError):
    """No folder of the repository marks a project root."""


class Index:
    """The chunk, posting, edge and file-state tables of a repository, each a versioned table under one folder.

    Chunks hold their vector and number of terms, so a query embeds and reads no text but its own and its hits'.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.settings = spark, settings
        self.chunks = VersionedTable(spark, f"{folder}/chunks")
        self.edges = VersionedTable(spark, f"{folder}/relationships")
        self.state = VersionedTable(spark, f"{folder}/file_state", key="rel_path")
        self.postings = VersionedTable(spark, f"{folder}/postings", by="bucket")

    def exists(self) -> bool:
        return self.state.version() > 0

    def check(self) -> tuple[bool, str]:
        """Whether the index fits the settings, and if not, why (A10)."""
        if not self.exists():
            return False, "missing"
        meta = self.state.manifest()["meta"]
        if not meta:
            return False, "no_meta"
        if meta.get("schema_version") != self.settings.schema_version:
            return False, "schema_version"
        if meta.get("embedding_model") != self.settings.embedding_model:
            return False, "embedding_model"
        return True, "ok"


def edges_of(chunks: DataFrame) -> DataFrame:
    """Edges of chunks whose imports and dependencies are lists."""
    one = lambda c, kind: chunks.select(F.col("source").alias("source_file"), F.explode(c).alias("target_symbol"), F.lit(kind).alias("relationship_type"))
    rows = one("imports", "import").unionByName(one("dependencies", "depends_on")).distinct()
    return rows.select(F.concat_ws("#", "source_file", "target_symbol", "relationship_type").alias("id"), "source_file", "target_symbol", "relationship_type")


def scan(spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The repository's files with scopes. Raises :class:`NoRoot` where nothing marks a root."""
    listed = sources.list_files(root, settings)
    marks = [x for x in _marks(root)]
    if not marks:
        raise NoRoot(root)
    roots = sources.find_roots(spark.createDataFrame([(m,) for m in marks], "rel_path string"))
    return sources.assign_scopes(sources.read_listed(spark, root, listed, settings), roots)


def _marks(root: str) -> list[str]:
    out = []
    for folder in ["", *sorted(e.name for e in os.scandir(root) if e.is_dir())]:
        out += [f"{folder}/{name}".lstrip("/") for name in sources.SIGNATURES if os.path.exists(os.path.join(root, folder, name))]
    return out


def indexed(chunks: DataFrame, settings: Settings = DEFAULTS, embedder: Callable | None = None) -> DataFrame:
    """Chunks with ``vector`` and ``n_terms``, as the chunk table holds them."""
    return text_index.lengths(search.embed(chunks, model=embedder, dim=settings.dimensions))


def _either(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b)


def ingest(spark: SparkSession, root: str, index: Index, force: bool = False, progress: Callable[[str], None] | None = None, embedder: Callable | None = None) -> dict[str, int]:
    """Bring the index up to date with the repository; returns the counters.

    New and changed files are chunked, deleted ones dropped, everything else stays. A mismatch of schema or model
    rebuilds. The file state is committed last: a run that dies before it is repeated whole, and since chunks are
    replaced by source, the repetition changes nothing twice.
    """
    def say(message: str) -> None:
        log.info(message)
        if progress:
            progress(message)

    ok, reason = index.check()
    rebuild = force or (not ok and reason != "missing")
    files = scan(spark, root, index.settings).cache()
    try:
        if files.isEmpty():
            return dict.fromkeys(("processed", "new", "modified", "deleted", "unchanged", "chunks"), 0)
        now = files.select(F.col("rel_path").alias("path"), F.col("sha256").alias("digest"), F.lit(False).alias("deleted"))
        state = None if rebuild else index.state.read()
        stored = None if rebuild else index.chunks.read()
        if state is not None and stored is not None:
            # a file that is known but has no chunk counts as new, unless it never had any
            old = state.join(stored.select(F.col("source").alias("rel_path")).distinct().withColumn("_c", F.lit(True)), "rel_path", "left").where("_c or empty")
            old = old.select(F.col("rel_path").alias("path"), F.col("sha256").alias("digest"), F.lit(False).alias("deleted"))
        else:
            old = now.limit(0)
        delta = diff_manifests(old, now).cache()
        counts = {r[0]: r[1] for r in delta.groupBy("change").count().collect()}
        say(f"files: {counts}")
        fresh = files.join(delta.where(F.col("change").isin(ADDED, CHANGED)).select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
        touched = delta.where(F.col("change") != KEPT).select(F.col("path").alias("source"))
        made = indexed(chunk_files(fresh.select(F.col("rel_path").alias("source"), "scope", "content"), index.settings), index.settings, embedder).cache()
        n = made.count()
        changed = sum(counts.get(c, 0) for c in (ADDED, CHANGED, REMOVED))
        if changed or rebuild or not index.exists():
            gone = stored.join(touched, "source", "left_semi").select("id") if stored is not None else None
            # those of a run that died after this commit go too
            index.postings.commit(text_index.postings(made, keep=("scope",)), _either(made.select("id"), gone), append=True, rebuild=rebuild)
            index.chunks.commit(made, gone, rebuild=rebuild)
            say("chunks committed")
            known = None if rebuild else index.edges.read()
            lost = known.join(touched.withColumnRenamed("source", "source_file"), "source_file", "left_semi").select("id") if known is not None else None
            index.edges.commit(edges_of(made), lost, rebuild=rebuild)
            rows = fresh.join(made.select(F.col("source").alias("rel_path")).distinct().withColumn("_c", F.lit(True)), "rel_path", "left")
            rows = rows.select("rel_path", "sha256", "mtime", "size", F.col("_c").isNull().alias("empty"))
            removed = delta.where(F.col("change") == REMOVED).select(F.col("path").alias("rel_path"))
            index.state.commit(rows, None if rebuild else removed, rebuild=rebuild, meta={"schema_version": index.settings.schema_version, "embedding_model": index.settings.embedding_model})
        delta.unpersist()
        made.unpersist()
        return {"processed": files.count(), "new": counts.get(ADDED, 0), "modified": counts.get(CHANGED, 0), "deleted": counts.get(REMOVED, 0), "unchanged": counts.get(KEPT, 0), "chunks": n}
    finally:
        files.unpersist()


def sync(spark: SparkSession, root: str, index: Index, embedder: Callable | None = None) -> dict:
    """Freshness before a query: ``updated, reason, changed_count``; -1 where the index was rebuilt (M2, M3)."""
    ok, reason = index.check()
    if reason == "missing":
        return {"updated": False, "reason": "no_index", "changed_count": 0}
    if not ok:
        ingest(spark, root, index, force=True, embedder=embedder)
        return {"updated": True, "reason": "forced", "changed_count": -1}
    counts = ingest(spark, root, index, embedder=embedder)
    changed = counts["new"] + counts["modified"] + counts["deleted"]
    return {"updated": bool(changed), "reason": "synced" if changed else "clean", "changed_count": changed}


def ingest_stream(files: DataFrame, index: Index, checkpoint: str, once: bool = True, embedder: Callable | None = None):
    """Chunk a stream of files ``source, scope, content`` into the index: chunks, postings, edges and file state.

    The batch number is in each table's commit (``processed``), so of a batch that is delivered again after a failure
    only the tables that did not get it are written. Of several contents of a file in a batch the last by ``seen`` (if
    there is such a column) counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = lambda t: t.manifest()["processed"].get("stream", -1) >= number
        mark = {"stream": number}
        if done(index.state):  # written last
            return
        last = F.max_by(F.struct("scope", "content"), "seen" if "seen" in batch.columns else F.length("content"))
        latest = batch.groupBy("source").agg(last.alias("f")).select("source", "f.scope", "f.content").persist()
        made = indexed(chunk_files(latest, index.settings), index.settings, embedder).persist()
        if not done(index.postings):
            stored = index.chunks.read()  # postings are written before chunks
            gone = stored.join(latest.select("source"), "source", "left_semi").select("id") if stored is not None else None
            index.postings.commit(text_index.postings(made, keep=("scope",)), _either(made.select("id"), gone), append=True, processed=mark)
        if not done(index.chunks):
            stored = index.chunks.read()
            gone = stored.join(latest.select("source"), "source", "left_semi").select("id") if stored is not None else None
            index.chunks.commit(made, gone, processed=mark)
        if not done(index.edges):
            known = index.edges.read()
            lost = known.join(latest.select(F.col("source").alias("source_file")), "source_file", "left_semi").select("id") if known is not None else None
            index.edges.commit(edges_of(made), lost, processed=mark)
        state = latest.join(made.select("source").distinct().withColumn("_c", F.lit(True)), "source", "left")
        content = F.coalesce("content", F.lit("")).cast("binary")
        rows = state.select(F.col("source").alias("rel_path"), F.sha2(content, 256).alias("sha256"), F.current_timestamp().alias("mtime"), F.length(content).cast("long").alias("size"), F.col("_c").isNull().alias("empty"))
        index.state.commit(rows, processed=mark, meta={"schema_version": index.settings.schema_version, "embedding_model": index.settings.embedding_model})
        made.unpersist()
        latest.unpersist()

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
