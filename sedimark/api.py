"""The Python API over an index: query, project map, metrics, styles, audit, sync (O1-O9, S)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark import render
from sedimark.config import DEFAULTS, Settings
from sedimark.operators import audit as layout
from sedimark.operators import edges as relations
from sedimark.operators import loc, project_map, search, text_index, windows
from sedimark.operators.styles import component_trace, dead_classes, property_matches
from sedimark.streaming.ingest import Index, ingest, sync

OK, NO_INDEX, NO_DATA, NO_CONTEXT = "OK", "NO_INDEX", "NO_DATA", "NO_CONTEXT"


class Engine:
    """Everything about one project. Read failures are raised; only a missing or empty index is a status."""

    def __init__(self, spark: SparkSession, project: str, index: str | None = None, settings: Settings = DEFAULTS, embedder: Callable | None = None, reranker: Callable | None = None, generator: Callable[[str], str] | None = None) -> None:
        project = os.path.abspath(project)
        if project == "/" or any(project == p or project.startswith(p + "/") for p in ("/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/sbin", "/sys", "/usr")):
            raise PermissionError(f"{project} is a system folder")
        if not os.path.isdir(project):
            raise FileNotFoundError(project)
        self.spark, self.project, self.settings = spark, project, settings
        self.index = Index(spark, index or os.path.join(project, ".sedimark"), settings)
        self.embedder, self.reranker, self.generator = embedder, reranker, generator

    def ingest(self, force: bool = False, progress: Callable[[str], None] | None = None) -> dict:
        return ingest(self.spark, self.project, self.index, force, progress, self.embedder)

    def sync(self) -> dict:
        return sync(self.spark, self.project, self.index, self.embedder)

    def chunks(self) -> DataFrame | None:
        return self.index.chunks.read() if self.index.exists() else None

    def _status(self, rows: DataFrame | None) -> str:
        return NO_INDEX if rows is None else NO_DATA if rows.isEmpty() else OK

    # -- retrieval -------------------------------------------------------------------------------------------------
    def retrieve(self, text: str, scope: str | None = None, k: int | None = None) -> DataFrame | None:
        """The best chunks for a query, with ``score`` and ``rank``: hybrid search, reranking, the gate (Q1)."""
        s = self.settings
        text, k = search.sanitize_query(text, s.max_query_chars), search.check_k(k or s.k)
        rows = self.chunks()
        if rows is None:
            return None
        rows = rows.where(search.matches(scope=scope))
        vector = self.embedder([text])[0] if self.embedder else search.mock_embedding(text, s.dimensions)
        size = rows.agg(F.count("n_terms"), F.avg("n_terms")).first()
        held = self.index.postings.read()
        listed = search.ranked(text_index.bm25(held.where(search.matches(scope=scope)), size[0], size[1], text), s.candidates) if held is not None else None
        near = search.vector_topk(rows, vector, s.candidates)
        found = (search.fuse_ranks(near, listed, s.candidates) if listed is not None else near).select("id", F.col("rank").alias("_found"))
        candidates = rows.join(F.broadcast(found), "id")  # at most ``candidates`` rows
        if self.reranker is None:
            return search.rerank(candidates, text, k, least=s.min_score)
        try:
            kept = search.rerank(candidates, text, k, least=s.min_score, model=self.reranker).cache()
            kept.count()  # a model that fails does so here
            return kept
        except Exception:  # any failure of the model falls back to the first k, unfiltered
            return candidates.orderBy("_found").limit(k).withColumn("rank", F.col("_found"))

    def query(self, text: str, scope: str | None = None, k: int | None = None) -> dict:
        """``query, scope, status, retrieved_chunks, context, response``; without a hit no context and a refusal."""
        kept = self.retrieve(text, scope, k)
        if kept is None:
            return {"query": text, "scope": scope, "status": NO_INDEX, "retrieved_chunks": [], "response": "There is no index yet."}
        hits = kept.select("id", "source", "start_line", "end_line", "text", "rank").cache()
        blocks = render.file_blocks(windows.fuse(hits.select("source", "start_line", "text", "rank")), self.settings.compress)
        rows = [r.asDict() for r in blocks.orderBy("file_rank", "source", "start_line").collect()]  # at most k chunks
        if not rows:
            return {"query": text, "scope": scope, "status": NO_CONTEXT, "retrieved_chunks": [], "response": "The project holds nothing on this question."}
        own = sum(len(r["block"]) for r in rows)
        more = [r["block"] for r in self.enriched(hits.select("source", "rank"), self.settings.max_context_chars - own).collect()]
        hits.unpersist()
        whole = render.context([r["block"] for r in rows] + more)
        answer = self.generator(render.prompt(text, whole)) if self.generator else render.result_header(rows)
        return {"query": text, "scope": scope, "status": OK, "retrieved_chunks": rows, "context": whole, "response": answer}

    def enriched(self, hits: DataFrame, budget: int) -> DataFrame:
        """Blocks of files one hop from the hits, at most the quota, until the first that does not fit."""
        chunks, edges = self.chunks(), self.index.edges.read()
        per_file = hits.groupBy("source").agg(F.min("rank").alias("rank"))
        found = relations.enrich(per_file, edges, chunks, self.settings.max_enriched_files)
        texts = windows.reassemble(chunks.join(found.select(F.col("file").alias("source")), "source", "left_semi")).select(F.col("source").alias("file"), "content").where(F.trim("content") != "")
        blocks = render.related_blocks(found.join(texts, "file"), self.settings.max_enriched_chars).withColumn("n", F.length("block"))
        placed = relations.numbered(blocks.withColumnRenamed("rank", "hit"), "hit", "branch", "target", "file")
        return windows.within_budget(placed, "rank", "n", max(0, budget)).orderBy("rank").select("block")

    # -- analysis --------------------------------------------------------------------------------------------------
    def code_metrics(self, min_lines: int = 200) -> dict:
        rows = self.chunks()
        if (status := self._status(rows)) != OK:
            return {"status": status}
        files = loc.loc_by_file(rows, min_lines).cache()
        try:
            plain = lambda df: [r.asDict() for r in df.collect()]
            return {
                "status": OK,
                "summary": loc.loc_totals(files, min_lines).first().asDict(),
                "exceeding_files": plain(loc.exceeding(files, min_lines).orderBy(F.col("lines_total").desc(), "source")),
                "top_10_largest_files": plain(loc.largest(files)),
                "by_extension": {r["ext"]: {"file_count": r["file_count"], "total_lines": r["total_lines"]} for r in loc.loc_by_extension(files).orderBy(F.col("total_lines").desc(), "ext").collect()},
            }
        finally:
            files.unpersist()

    def project_map(self) -> dict:
        rows = self.chunks()
        if (status := self._status(rows)) != OK:
            return {"status": status}
        listed = rows.withColumn("models", F.array_join("models", ","))
        lists = [r.asDict() for r in project_map.category_lists(listed).orderBy("scope", "place", "category").collect()]
        files = {r["scope"]: r["files"] for r in project_map.scope_files(listed).collect()}
        models = sorted(r["model"] for r in project_map.models(listed).collect())
        return {"status": OK, "categories": lists, "files": files, "models": models, "text": render.map_text(lists, files, models)}

    def _style_tables(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        rules = rows.where("size(css_rules) > 0").groupBy(F.col("source").alias("css_file")).agg(F.first("css_rules").alias("r")).select("css_file", F.explode("r").alias("r")).select("css_file", "r.*")
        declared = rows.where(F.col("source").rlike(r"\.(css|scss|less|sass)$")).select(F.explode("tags").alias("cls"), "source").groupBy("cls").agg(F.min("source").alias("css_file"))
        used = rows.where(F.col("source").rlike(r"\.(tsx|jsx|js|html|vue|svelte|astro)$")).select("source", F.explode("tags").alias("cls")).distinct()
        dynamic = F.col("cls").startswith("[BEM]")
        return rules, declared, used.select("source", F.when(dynamic, F.expr("substring(cls, 6)")).otherwise(F.col("cls")).alias("cls"), dynamic.alias("dynamic"))

    def styles_map(self, component: str | None = None, cls: str | None = None, prop: str | None = None) -> dict:
        rows = self.chunks()
        if (status := self._status(rows)) != OK:
            return {"status": status}
        rules, declared, used = self._style_tables(rows)
        sheets = rows.where(F.col("source").endswith(".css")).groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dependencies")))).alias("v"))
        unused: dict[str, list[str]] = {}
        for r in dead_classes(declared, used).orderBy("css_file", "cls").collect():
            unused.setdefault(r[0], []).append(r[1])
        return {
            "status": OK,
            "files": {r[0]: {"classes": r[1], "variables": [v for v in r[2] if v.startswith("--")]} for r in sheets.collect()},
            "unused": unused,
            "trace": [r.asDict() for r in component_trace(used, rules, component, cls, prop).orderBy("component", "cls", "css_file", "start_line").collect()],
            "property_matches": [r.asDict() for r in property_matches(rules, prop).orderBy("css_file", "start_line").collect()] if prop else [],
            "filters": {"component": component, "class": cls, "property": prop},
        }

    def audit(self, severity: str = "ALL", files: str | None = None) -> dict:
        rows = self.chunks()
        if (status := self._status(rows)) != OK:
            return {"status": status}
        rules, _, _ = self._style_tables(rows)
        texts = windows.reassemble(rows.where(F.col("source").rlike(r"\.(js|jsx|tsx|html|vue|svelte)$"))).select("source", "content")
        issues = [r.asDict() for r in layout.audit(rules, layout.ancestors(texts), severity, files).collect()]
        return {"status": OK, "total_issues": len(issues), "issues": issues, "severity_filter": severity}
