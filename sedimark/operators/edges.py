"""The edge table and one-hop enrichment of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.scripts import PRISMA_TYPES
from sedimark.operators.orphans import _inside
from sedimark.operators.packed import split_fields


def extract(chunks: DataFrame) -> DataFrame:
    """``id, source_file, target_symbol, relationship_type`` of the packed imports and dependencies, each once."""
    items = split_fields(chunks, "source", ["imports", "dependencies"], ("imports",), "source")
    kind = F.when(F.col("field_name") == "imports", "import").otherwise("depends_on")
    edges = items.select(F.col("source").alias("source_file"), F.col("item").alias("target_symbol"), kind.alias("relationship_type")).distinct()
    return edges.select(F.concat_ws("#", "source_file", "target_symbol", "relationship_type").alias("id"), "source_file", "target_symbol", "relationship_type")


def replace_edges(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edges of files that ``fresh`` has edges of are replaced by those."""
    return edges.join(fresh.select("source_file").distinct(), "source_file", "left_anti").unionByName(fresh.select(*edges.columns), allowMissingColumns=True)


def _targets(hits: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    own = edges.where(F.col("relationship_type") == kind).select(F.col("source_file").alias("source"), F.regexp_replace("target_symbol", "^[\\s\"'`]+|[\\s\"'`]+$", "").alias("target"))
    return hits.select("source", "rank").join(own, "source").distinct()


def import_candidates(source, target):
    """The files that an import may mean, in the order in which they are tried (C22). Packages have none."""
    folder = F.when(F.contains(source, F.lit("/")), F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    path = _inside(folder, target)
    script = F.array(*(F.concat(path, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", "/index.js")))
    dots = F.length(F.regexp_extract(target, r"(?:from|import)\s+(\.+)", 1))
    module = F.replace(F.regexp_extract(target, r"(?:from|import)\s+\.+([A-Za-z_][\w.]*)", 1), F.lit("."), F.lit("/"))
    parts = F.split(folder, "/")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    base = F.concat_ws("/", F.when(up != "", up), F.when(module != "", module))
    python = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), base)
    none = F.array().cast("array<string>")
    return F.when(dots > 0, python).when(target.startswith("."), F.coalesce(script, none)).otherwise(none)


def import_files(hits: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file, rank, target``: for each relative import of a hit the first candidate that exists."""
    wanted = _targets(hits, edges, "import").select("source", "rank", "target", F.posexplode(import_candidates(F.col("source"), F.col("target"))).alias("pos", "file"))
    there = chunks.select(F.col("source").alias("file")).distinct()
    return wanted.join(there, "file", "left_semi").groupBy("source", "rank", "target").agg(F.min_by("file", "pos").alias("file")).select("file", "rank", "target")


def class_files(hits: DataFrame, edges: DataFrame, chunks: DataFrame, joined_names: bool = True) -> DataFrame:
    """``file, rank, target``: for each class that a hit depends on its first file (E5).

    With ``joined_names`` a chunk of several classes is known by its joined name only, as ever; else by each of them.
    """
    names = F.array(F.trim("class_name")) if joined_names else F.transform(F.split("class_name", ","), lambda x: F.trim(x))
    known = chunks.where("class_name is not null").select(F.explode(names).alias("target"), "source").where("target != ''" + (" and not contains(target, ',')" if joined_names else ""))
    first = known.groupBy("target").agg(F.min("source").alias("file"))
    wanted = _targets(hits, edges, "depends_on").where(F.col("target").rlike("^[A-Z]") & ~F.col("target").isin(*PRISMA_TYPES))
    return wanted.join(first, "target").select("file", "rank", "target")


def model_files(hits: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file, rank, target`` of schema models that a hit names and that are declared elsewhere."""
    prisma = chunks.where(F.col("source").endswith(".prisma"))
    return class_files(hits.where(F.col("source").endswith(".prisma")), edges, prisma, False)


def _once(found: DataFrame, hits: DataFrame, quota: int, order: list[str]) -> DataFrame:
    """Each file once, at its first mention, without the hits' own files; ``quota`` of them in order of mention."""
    fresh = found.join(hits.select(F.col("source").alias("file")).distinct(), "file", "left_anti")
    first = fresh.groupBy("file").agg(F.min(F.struct(*order)).alias("m")).select("file", *(F.col(f"m.{c}").alias(c) for c in order))
    return first.orderBy(*order, "file").limit(quota)


def dependency_files(hits: DataFrame, edges: DataFrame, chunks: DataFrame, quota: int = 15) -> DataFrame:
    """``file, rank, target`` of the files that hits depend on by class."""
    return _once(class_files(hits, edges, chunks), hits, quota, ["rank", "target"])


def enrich(hits: DataFrame, edges: DataFrame, chunks: DataFrame, quota: int = 15) -> DataFrame:
    """``file, rank, branch, target``: files one hop from the hits by import, class or model, each once.

    Branches are tried in this order for each hit; a file named earlier blocks later mentions and takes one place.
    """
    branches = ((0, import_files(hits, edges, chunks)), (1, class_files(hits, edges, chunks)), (2, model_files(hits, edges, chunks)))
    every = None
    for number, found in branches:
        rows = found.withColumn("branch", F.lit(number))
        every = rows if every is None else every.unionByName(rows)
    return _once(every, hits, quota, ["rank", "branch", "target"])


def edges_or_fields(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The edge table, and for files without edges those of their packed fields."""
    missing = chunks.join(edges.select(F.col("source_file").alias("source")).distinct(), "source", "left_anti")
    return edges.select("id", "source_file", "target_symbol", "relationship_type").unionByName(extract(missing))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
