"""Processing only new or changed records: table versions as immutable manifests, diffed entry by entry.

A *manifest* is a table with one row per data file of a version: ``path`` (the key), ``digest`` (what the file holds;
null when unknown) and ``deleted`` (the deletion vector's verdict: the file is there physically, but all its rows are
masked). Manifests are never changed, so the difference of two of them is a pure function of the two, whatever failed
or was repeated in between. ``processed`` versions are named in the commit of the output they led to
(:mod:`sedimark.sources.versions`), which makes a run that dies leave no trace and a repeated run yield the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.operators.files import file_pieces, map_files

ADDED, CHANGED, REMOVED, KEPT = "added", "changed", "removed", "kept"


def clean_path(col):
    """One spelling for a path: forward slashes, no blanks around it, no leading ``./`` or ``/``, no empty or ``.`` segments."""
    col = F.regexp_replace(F.trim(col), r"\\+", "/")
    return F.regexp_replace(F.regexp_replace(col, r"/(\.?/)+", "/"), r"^(\./|/)+", "")


def clean_digest(col):
    """One spelling for a SHA-256: lower case, no ``sha256:`` before it, null when nothing is left."""
    col = F.regexp_replace(F.lower(F.trim(col)), r"^sha-?256[:=]\s*", "")
    return F.when(col != "", col)


def manifest_of_chunks(chunks: DataFrame) -> DataFrame:
    """The manifest of the version that ``chunks`` holds now: ``path, digest, deleted``.

    ``digest`` is the SHA-256 of the UTF-8 content. A file is deleted when every row of it has ``deleted_at``.
    """
    files = file_pieces(chunks, deleted=F.min(F.col("deleted_at").isNotNull()))

    def digests(sources, texts, batch):
        return {
            "path": sources,
            "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
            "deleted": batch.column(batch.schema.get_field_index("deleted")),
        }

    return map_files(files, digests, "path string, digest string, deleted boolean")


def manifest_of_runs(file_state: DataFrame, runs: DataFrame, scopes_of_runs: bool = True) -> DataFrame:
    """The manifest of the last version that was processed: ``path, digest, deleted``.

    Only rows of runs with status ``success`` and a ``finished_at`` count, and only those with a digest; the row of
    the run that finished last wins (then the row recorded last, then the larger digest, so that ties are settled).
    With ``scopes_of_runs`` a row counts only where the path's first segment is the run's scope.
    """
    done = runs.where((F.col("status") == "success") & F.col("finished_at").isNotNull()).select(
        F.col("run_id").alias("_run"), F.col("scope").alias("_scope"), F.col("finished_at").alias("_finished")
    )
    rows = file_state.select(
        F.col("run_id").alias("_run"),
        clean_path(F.col("rel_path")).alias("path"),
        clean_digest(F.col("sha256")).alias("digest"),
        F.col("recorded_at").alias("_recorded"),
    ).where(F.col("digest").isNotNull() & F.col("path").isNotNull())
    rows = rows.join(done, "_run")
    if scopes_of_runs:
        rows = rows.where(F.substring_index("path", "/", 1) == F.col("_scope"))
    # max of a struct combines before the shuffle: a path repeated without end sends one row per task
    best = F.max(F.struct("_finished", "_recorded", "digest"))
    return rows.groupBy("path").agg(best.alias("b")).select("path", F.col("b.digest").alias("digest"), F.lit(False).alias("deleted"))


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """The entries of ``new`` and ``old`` with their ``change``: added, changed, removed or kept.

    One outer equi join on the path. A masked (deleted) entry counts as absent; entries without a digest on the new
    side count as changed, since nothing proves that they are not. Each path must be there once on each side.
    """
    live = lambda m, name: m.where(~F.coalesce(F.col("deleted"), F.lit(False))).select("path", F.col("digest").alias(name))
    both = live(old, "_old").withColumn("_in_old", F.lit(True)).join(live(new, "_new").withColumn("_in_new", F.lit(True)), "path", "full_outer")
    change = (
        F.when(F.col("_in_old").isNull(), ADDED)
        .when(F.col("_in_new").isNull(), REMOVED)
        .when(F.col("_old").eqNullSafe(F.col("_new")) & F.col("_new").isNotNull(), KEPT)
        .otherwise(CHANGED)
    )
    return both.select("path", change.alias("change"), F.col("_old").alias("old_digest"), F.col("_new").alias("new_digest"))


def to_process(chunks: DataFrame, file_state: DataFrame, runs: DataFrame) -> DataFrame:
    """The paths that the next run must process, with ``change`` added or changed."""
    delta = diff_manifests(manifest_of_runs(file_state, runs), manifest_of_chunks(chunks))
    return delta.where(F.col("change").isin(ADDED, CHANGED))


def record_delta(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Record-level difference of two versions of a keyed table: the rows of ``new`` (of ``old`` when removed) with ``_change``.

    Rows are compared by a digest of ``columns`` (all but the key by default), so one equi join on the key suffices.
    Repeated rows count once; of several rows with one key the one with the largest digest stands for it. Null keys
    cannot be tracked and are left out.
    """
    cols = [c for c in (columns or new.columns) if c != key]

    def digest(df: DataFrame, name: str) -> DataFrame:
        body = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"}), 256)
        rows = df.where(F.col(f"`{key}`").isNotNull()).withColumn("_digest", body)
        first = Window.partitionBy(f"`{key}`").orderBy(F.col("_digest").desc())
        rows = rows.dropDuplicates([key, "_digest"]).withColumn("_n", F.row_number().over(first)).where("_n = 1")
        return rows.select(F.col(f"`{key}`"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c != key), "_digest").alias(name))

    both = digest(old, "_o").join(digest(new, "_n"), key, "full_outer")
    change = (
        F.when(F.col("_o").isNull(), ADDED)
        .when(F.col("_n").isNull(), REMOVED)
        .when(F.col("_o._digest") == F.col("_n._digest"), KEPT)
        .otherwise(CHANGED)
    )
    pick = [F.coalesce(F.col(f"_n.`{c}`"), F.col(f"_o.`{c}`")).alias(c) if c in old.columns else F.col(f"_n.`{c}`").alias(c) for c in new.columns if c != key]
    return both.withColumn("_change", change).where(F.col("_change") != KEPT).select(F.col(f"`{key}`"), *pick, "_change")
