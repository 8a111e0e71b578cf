"""Scanning a repository into a table of files with scopes."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.config import DEFAULTS, Settings

# fixed values: files that mark a root, in order of precedence of what they mark
SIGNATURES = {"next.config.ts": "nextjs-app", "next.config.js": "nextjs-app", "next.config.mjs": "nextjs-app", "angular.json": "angular", "nest-cli.json": "nestjs", "pyproject.toml": "python"}
PRECEDENCE = ("nextjs-app", "angular", "nestjs", "python")
FILES = "path string, rel_path string, content string, sha256 string, mtime timestamp, size long"


def relative(path: str, root: str) -> str:
    """The path under the root with forward slashes; the path itself where it is elsewhere."""
    path, root = path.replace("\\", "/"), root.replace("\\", "/").rstrip("/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else path


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file; negations are not supported and are left out (A2)."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "!"))]


def is_ignored(path: str, patterns: list[str]) -> bool:
    """Whether a relative path matches: patterns without a slash by any segment, others by the path or any of its ends (A3)."""
    segments = path.split("/")
    for pattern in patterns:
        p = pattern.strip("/")
        if "/" not in p:
            if any(fnmatch.fnmatchcase(s, p) for s in segments):
                return True
        elif any(fnmatch.fnmatchcase(end, p) or fnmatch.fnmatchcase(end, p + "/*") for end in ("/".join(segments[i:]) for i in range(len(segments)))):
            return True
    return False


def list_files(root: str, settings: Settings = DEFAULTS) -> list[str]:
    """Relative paths depth first, files of a folder before its subfolders; links to folders are not followed (A1).

    The driver lists names only; contents are read by the executors.
    """
    out: list[str] = []

    def walk(folder: str, inherited: list[tuple[str, list[str]]]) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        own = next((e for e in entries if e.name == ".gitignore" and e.is_file()), None)
        if own:
            with open(own.path, encoding="utf-8", errors="ignore") as file:
                inherited = [*inherited, (folder, ignore_patterns(file.read()))]
        hidden = lambda e: any(is_ignored(relative(e.path, base), p) for base, p in inherited)
        for e in entries:
            if e.is_file() and os.path.splitext(e.name)[1] in settings.extensions and not hidden(e):
                out.append(relative(e.path, root))
        for e in entries:
            if e.is_dir(follow_symlinks=False) and e.name not in settings.ignored_dirs and not hidden(e):
                walk(e.path, inherited)

    walk(root, [])
    return out


def read_listed(spark: SparkSession, root: str, paths: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``path, rel_path, content, sha256, mtime, size`` of listed files, read by the executors from storage they share.

    Contents are UTF-8 without malformed bytes; of files over the limit only hash and size are read, their content is null.
    """
    names = spark.createDataFrame([(p,) for p in paths], "rel_path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rel in batch.column(0).to_pylist():
                path = os.path.join(root, rel)
                digest, size, parts = hashlib.sha256(), os.path.getsize(path), []
                with open(path, "rb") as file:
                    while piece := file.read(1 << 20):
                        digest.update(piece)
                        if size <= settings.max_file_bytes:
                            parts.append(piece)
                content = b"".join(parts).decode("utf-8", "ignore") if size <= settings.max_file_bytes else None
                rows.append((path, rel, content, digest.hexdigest(), int(os.path.getmtime(path) * 1e6), size))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "rel_path", "content", "sha256", "mtime", "size"])

    return names.mapInArrow(run, FILES)


def read_store(spark: SparkSession, root: str, settings: Settings = DEFAULTS, patterns: list[str] | None = None) -> DataFrame:
    """The same table from any store that Spark reads, listed in parallel (A1 at scale).

    Spark leaves out names that begin with ``_`` or a dot; :func:`list_files` keeps them.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in settings.extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")
    rows = raw.select("path", rel.alias("rel_path"), "content", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rows = rows.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*(F.lit(d) for d in settings.ignored_dirs))))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, p in enumerate(batch.column(1).to_pylist()) if not is_ignored(p, patterns or [])]
            batch = batch.take(pa.array(keep, pa.int64()))
            big = [s > settings.max_file_bytes for s in batch.column(5).to_pylist()]
            text = [None if b else bytes(x).decode("utf-8", "ignore") for x, b in zip(batch.column(2).to_pylist(), big)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), *batch.columns[3:]], batch.schema.names)

    return rows.mapInArrow(decode, FILES)


def find_roots(paths: DataFrame) -> DataFrame:
    """``folder, scope, precedence, depth`` of roots: the first folder of each kind whose signature lies at most two levels deep (A4).

    ``paths``: ``rel_path`` of all files, those that are not scanned too.
    """
    name = F.element_at(F.split("rel_path", "/"), -1)
    depth = F.size(F.split("rel_path", "/")) - 1
    kind = F.lit(None).cast("string")
    for signature, scope in SIGNATURES.items():
        kind = F.when(name == signature, scope).otherwise(kind)
    folder = F.when(depth > 0, F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("")
    hits = paths.select(folder.alias("folder"), kind.alias("scope"), depth.alias("depth")).where("scope is not null and depth <= 1")
    first = hits.groupBy("scope").agg(F.min(F.struct("depth", "folder")).alias("m")).select("scope", F.col("m.depth").alias("depth"), F.col("m.folder").alias("folder"))
    order = F.array_position(F.array(*(F.lit(p) for p in PRECEDENCE)), F.col("scope"))
    return first.withColumn("precedence", order)


def assign_scopes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The files with the ``scope`` of the deepest root above them; equal depths go by precedence; files under no root are left out (A5).

    Each file is joined by its own few ancestor folders, an equi join with a table of at most four roots.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.withColumn("folder", F.explode(F.array_distinct(above))).join(F.broadcast(roots.select("folder", "scope", "precedence", "depth")), "folder")
    best = Window.partitionBy("rel_path").orderBy(F.col("depth").desc(), "precedence")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "folder", "precedence", "depth")
