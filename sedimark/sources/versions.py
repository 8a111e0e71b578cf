"""A versioned table on plain Parquet: immutable data folders, deletion vectors and one manifest per version.

Built-in file tables have no row-level delete or upsert, so a version is a manifest (JSON) that lists

* ``data``: folders of Parquet files, never rewritten once a manifest names them,
* ``deletes``: folders with the keys that are masked from the data folders older than them,
* ``step``: the folders that this version itself added (none for a compaction), from which deltas are made,
* ``processed``: for each upstream table, the version of it that led to this one,
* ``meta``: free entries such as the schema version and the embedding model.

A commit puts one manifest in place, which fails if the version is there already, so of two writers one wins, and a
writer that dies leaves only folders that no manifest names. Readers pin a version and need no lock. Paths go through
Hadoop's file system classes. On a local disk the manifest is linked into place, on a distributed file system renamed;
both are atomic. Object stores have no atomic rename: there a table takes one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators.incremental import REMOVED, manifest_of_chunks, manifest_of_runs, record_delta
from sedimark.session import shared_folder


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class VersionedTable:
    """A keyed table with snapshots. ``key`` names the column that upserts and deletes go by; ``by``, if given, the
    column whose values are folders of their own, so that filters on it read those alone."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", by: str | None = None) -> None:
        self.spark, self.root, self.key, self.by = spark, root.rstrip("/"), key, by
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests -------------------------------------------------------------------------------------------------
    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def version(self) -> int:
        """The latest committed version; 0 when nothing was committed."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "data": [], "deletes": [], "step": {}, "processed": {}, "meta": {}}
        stream = self._fs.open(self._path(self._manifest_path(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        target = self._path(self._manifest_path(manifest["version"]))
        if self._fs.exists(target):
            raise CommitConflict(f"version {manifest['version']} of {self.root} exists")
        body = json.dumps(manifest).encode()
        if self._fs.getUri().getScheme() == "file":
            self._link(target.toUri().getPath(), body)
            return manifest["version"]
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(body))
        stream.close()
        if not self._fs.rename(temporary, target):  # on a distributed store this fails where the target is there
            self._fs.delete(temporary, False)
            raise CommitConflict(f"version {manifest['version']} of {self.root} exists")
        return manifest["version"]

    def _link(self, target: str, body: bytes) -> None:
        """On a POSIX file system a rename would replace the target, so the manifest is linked into place instead."""
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temporary = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(temporary, "wb") as file:
            file.write(body)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(temporary, target)
        except FileExistsError:
            raise CommitConflict(target) from None
        finally:
            os.unlink(temporary)

    # -- reading ---------------------------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, or None where it has no data. Masked keys go by one anti join per data generation."""
        manifest = self.manifest(version)
        parts = []
        for entry in manifest["data"]:
            part = self._data(entry["folder"])
            if part is None:
                continue
            later = [f"{self.root}/{d['folder']}" for d in manifest["deletes"] if d["since"] > entry["since"]]
            if later:
                part = part.join(self.spark.read.parquet(*later).distinct(), self.key, "left_anti")
            parts.append(part)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def get(self, ids: list | None = None, where=None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame | None:
        """Some rows by key or condition, with some columns (A14); None where the table has no data."""
        rows = self.read()
        if rows is None:
            return None
        rows = rows.where(F.col(self.key).isin(*ids)) if ids is not None else rows
        rows = rows.where(where) if where is not None else rows
        rows = rows.select(*columns) if columns else rows
        return rows.limit(limit) if limit is not None else rows

    def count(self) -> int:
        rows = self.read()
        return 0 if rows is None else rows.count()

    def drop(self) -> None:
        """Delete the table with all its versions."""
        self._fs.delete(self._path(self.root), True)

    def _data(self, folder: str) -> DataFrame | None:
        """A data folder; None where a table in folders by value got no row."""
        path = f"{self.root}/{folder}"
        if self.by and not any(x.isDirectory() for x in self._fs.listStatus(self._path(path))):
            return None
        return self.spark.read.parquet(path)

    def changes(self, old: int, new: int | None = None) -> DataFrame | None:
        """Record deltas between two versions: rows with ``_change`` ``upsert`` or ``delete``; None where the table was never written to.

        Each version's manifest names the folders that it added itself, and those of the versions in between are read;
        what was there before is not touched, and a compaction, which adds no record, yields nothing. Of several
        changes of a key the last counts. Where the table was rebuilt in between, or ``old`` is 0, the rows of the two
        versions are compared.
        """
        last = self.manifest(new)
        if not old or last.get("rebuilt_since", 0) > old:
            return self._compared(old, last["version"])
        steps = [self.manifest(v)["step"] | {"since": v} for v in range(old + 1, last["version"])] + ([last["step"] | {"since": last["version"]}] if last["version"] > old else [])
        keys = lambda step: [f"{self.root}/{step[k]}" for k in ("deletes", "mask") if step.get(k)]
        parts, gone = [], []
        for i, step in enumerate(steps):
            if step.get("data"):
                rows = self._data(step["data"])
                if rows is None:
                    continue
                later = [k for x in steps[i + 1 :] for k in keys(x)]
                if later:
                    rows = rows.join(self.spark.read.parquet(*later).distinct(), self.key, "left_anti")
                parts.append(rows.withColumn("_change", F.lit("upsert")))
            if step.get("deletes"):
                gone.append(f"{self.root}/{step['deletes']}")
        upserts = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None
        if not gone:
            if upserts is None and (rows := self.read(new)) is not None:
                upserts = rows.limit(0).withColumn("_change", F.lit("upsert"))
            return upserts
        deletes = self.spark.read.parquet(*gone).distinct().withColumn("_change", F.lit("delete"))
        if upserts is None:
            return deletes
        deletes = deletes.join(upserts.select(self.key).distinct(), self.key, "left_anti")
        return upserts.unionByName(deletes, allowMissingColumns=True)

    def _compared(self, old: int, new: int) -> DataFrame | None:
        """:meth:`changes` from the rows of both versions, whose folders are never rewritten."""
        before, after = self.read(old), self.read(new)
        if before is None:
            return after.withColumn("_change", F.lit("upsert")) if after is not None else None
        if after is None:
            return before.select(self.key).distinct().withColumn("_change", F.lit("delete"))
        if lost := [c for c in before.schema if c.name not in after.columns]:  # a column that is gone changes the rows that had it
            after = after.select("*", *(F.lit(None).cast(c.dataType).alias(c.name) for c in lost))
        if more := [c for c in after.schema if c.name not in before.columns]:
            before = before.select("*", *(F.lit(None).cast(c.dataType).alias(c.name) for c in more))
        delta = record_delta(before, after, self.key).drop(*(c.name for c in lost))
        return delta.withColumn("_change", F.when(F.col("_change") == REMOVED, "delete").otherwise("upsert"))

    # -- writing ---------------------------------------------------------------------------------------------------
    def commit(
        self,
        upserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        *,
        append: bool = False,
        rebuild: bool = False,
        processed: dict[str, int] | None = None,
        meta: dict | None = None,
    ) -> int:
        """Write rows to upsert and keys to delete, then commit both, with the upstream versions, as one new version.

        ``append`` says that no key of ``upserts`` is there yet, which saves the mask. ``rebuild`` starts from nothing.
        Of several rows with one key in ``upserts`` any one stays.
        """
        last = self.manifest()
        now = last["version"] + 1
        out = {
            "version": now,
            "data": [] if rebuild else list(last["data"]),
            "deletes": [] if rebuild else list(last["deletes"]),
            "processed": {**last["processed"], **(processed or {})},
            "meta": {**last["meta"], **(meta or {})},
            "rebuilt_since": now if rebuild else last.get("rebuilt_since", 0),
            "step": {},
        }
        if deletes is not None and not rebuild:
            folder = f"deletes/{uuid.uuid4().hex}"
            deletes.select(self.key).distinct().write.parquet(f"{self.root}/{folder}")
            out["deletes"].append({"folder": folder, "since": now})
            out["step"]["deletes"] = folder
        if upserts is not None:
            folder = f"data/{uuid.uuid4().hex}"
            rows = upserts if append else upserts.dropDuplicates([self.key])
            self._write(rows, folder)
            if not append and not rebuild and out["data"]:
                mask = f"deletes/{uuid.uuid4().hex}"
                self.spark.read.parquet(f"{self.root}/{folder}").select(self.key).write.parquet(f"{self.root}/{mask}")
                out["deletes"].append({"folder": mask, "since": now})
                out["step"]["mask"] = mask
            out["data"].append({"folder": folder, "since": now})
            out["step"]["data"] = folder
        return self._commit(out)

    def _write(self, rows: DataFrame, folder: str) -> None:
        writer = rows.repartition(self.by).write.partitionBy(self.by) if self.by else rows.write
        writer.parquet(f"{self.root}/{folder}")

    def compact(self, files: int | None = None) -> int:
        """Rewrite the live rows into one data folder without masks; no row changes, so consumers get an empty delta."""
        last = self.manifest()
        rows = self.read()
        if rows is None:
            return last["version"]
        folder = f"data/{uuid.uuid4().hex}"
        self._write(rows.coalesce(files) if files else rows, folder)
        return self._commit({**last, "version": last["version"] + 1, "data": [{"folder": folder, "since": last["version"] + 1}], "deletes": [], "step": {}})


def process_new(
    source: VersionedTable, target: VersionedTable, fn: Callable[[DataFrame], DataFrame], name: str | None = None
) -> int | None:
    """Apply ``fn`` to the records of ``source`` that changed since the version named in ``target``'s last commit.

    The output and the processed version are one commit, so a failure before it repeats the same delta and a failure
    after it repeats nothing. What the target held of a changed record goes in the same commit, so a record that
    ``fn`` now leaves out leaves no old output behind. ``fn`` keeps the key. Returns the new version of ``target``, or
    None when there was nothing new.
    """
    name = name or source.root
    done, now = target.manifest()["processed"].get(name, 0), source.version()
    if done == now:
        return None
    delta = source.changes(done, now)
    if delta is None:
        return target.commit(processed={name: now})
    delta = delta.persist(StorageLevel.DISK_ONLY)
    try:
        upserts = fn(delta.where("_change = 'upsert'").drop("_change"))
        return target.commit(upserts, delta.select(F.col(source.key).alias(target.key)), processed={name: now})
    finally:
        delta.unpersist()


def pending_files(chunks: DataFrame, file_state: DataFrame, runs: DataFrame) -> DataFrame:
    """The paths that the next run must process: those that are new or changed since the last run of their scope that succeeded.

    Both versions are versions of one table in the shared folder, with a record ``path, digest`` per file: the first is
    what the successful runs left, the second what the chunks hold now, without the deleted files.
    """
    table = VersionedTable(chunks.sparkSession, f"{shared_folder(chunks.sparkSession)}/file-versions-{uuid.uuid4().hex}", key="path")
    table.commit(manifest_of_runs(file_state, runs).select("path", "digest"), append=True)
    table.commit(manifest_of_chunks(chunks).where("not deleted").select("path", "digest"), append=True, rebuild=True)
    return table.changes(1, 2).where("_change = 'upsert'").select("path")


def tables(spark: SparkSession, folder: str) -> list[str]:
    """The names of the versioned tables under a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    inner = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    return sorted(p.getName() for p in inner if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "manifests")))
