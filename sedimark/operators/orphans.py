"""References to records that do not exist, by bitmap AND-NOT per key range and period.

The operator is general: *references* ``(ref, keys, at)`` ask at the instant ``at`` for any one of ``keys``, and
*parents* ``(key, since, until)`` say when a key was there (from ``since`` on and before ``until``; null ``until``
means until now). Plan:

1. distinct ``(key, period)`` pairs of the references (combined before the shuffle, so a key that holds a third of
   all references sends one row per period and task) and merged parent spans are hash-partitioned by key. A partition
   is a key range: sorted by key, its keys get dense integers.
2. Per key range and period two compressed bitmaps are built: *asked* (bit = key asked for in the period) and *there*
   (bit = key there during the whole period). ``asked AND NOT there`` survives; surviving bits are decoded to keys and
   carry the spans of their key within the period.
3. Only references with every candidate key among the survivors can be orphans. Those are checked to the instant
   against the carried spans. Survivors are salted for this join, since one missing key may hold a third of all rows.
"""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.session import shuffle_width

SALTS = 16


class Bitmap:
    """A compressed set of small integers: per 65,536 a sorted array while sparse, else 8 KiB of bits, deflated."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.unique(np.asarray(values, dtype=np.int64))
        self.parts: dict[int, tuple[str, bytes]] = {}
        for high in np.unique(values >> 16):
            low = (values[(values >> 16) == high] & 0xFFFF).astype(np.uint16)
            if len(low) <= 4096:
                self.parts[int(high)] = ("array", zlib.compress(low.tobytes(), 1))
            else:
                bits = np.zeros(65536, dtype=bool)
                bits[low] = True
                self.parts[int(high)] = ("bits", zlib.compress(np.packbits(bits).tobytes(), 1))

    def _bits(self, high: int) -> np.ndarray:
        out = np.zeros(65536, dtype=bool)
        if high in self.parts:
            kind, data = self.parts[high]
            raw = zlib.decompress(data)
            if kind == "bits":
                return np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).astype(bool)
            out[np.frombuffer(raw, dtype=np.uint16)] = True
        return out

    def and_not(self, other: Bitmap) -> np.ndarray:
        """The members of this that are not in ``other``, decoded and in order."""
        out = []
        for high in sorted(self.parts):
            if high not in other.parts and self.parts[high][0] == "array":
                low = np.frombuffer(zlib.decompress(self.parts[high][1]), dtype=np.uint16)
            else:
                low = np.flatnonzero(self._bits(high) & ~other._bits(high))
            out.append((high << 16) + low.astype(np.int64))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def size(self) -> int:
        return sum(len(data) for _, data in self.parts.values())


def _month(us: int) -> int:
    when = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return when.year * 12 + when.month - 1


def _month_start(month: int) -> int:
    when = dt.datetime(month // 12, month % 12 + 1, 1)
    return int((when - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


_FOREVER = 2**62


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range, sorted by key. Rows: key, kind (0 parent, 1 asked), a, b (span in microseconds, or the month)."""
    schema = pa.schema([("key", pa.string()), ("month", pa.int32()), ("spans", pa.list_(pa.list_(pa.int64())))])
    keys: list[str] = []
    asked: dict[int, list[int]] = {}
    there: dict[int, list[int]] = {}
    spans: dict[tuple[int, int], list] = {}
    # One range's dictionary is flushed every 65,536 keys, so memory does not grow with the range
    state = {"key": None, "spans": [], "months": []}

    def close() -> None:
        if state["key"] is None or not state["months"]:
            return
        number = len(keys)
        keys.append(state["key"])
        merged: list[list[int]] = []
        for a, b in sorted(state["spans"]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for month in state["months"]:
            start, stop = _month_start(month), _month_start(month + 1)
            asked.setdefault(month, []).append(number)
            inside = [[max(a, start), min(b, stop)] for a, b in merged if a < stop and b > start]
            if inside == [[start, stop]]:
                there.setdefault(month, []).append(number)
            else:
                spans[number, month] = inside

    def flush() -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for month, numbers in asked.items():
            left = Bitmap(np.array(numbers)).and_not(Bitmap(np.array(there.get(month, []), dtype=np.int64)))
            for number in left.tolist():
                for column, value in zip(out, (keys[number], month, spans[number, month])):
                    column.append(value)
        for x in (keys, asked, there, spans):
            x.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    for batch in batches:
        for key, kind, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if key != state["key"]:
                close()
                if len(keys) >= 65536:
                    yield from flush()
                state.update(key=key, spans=[], months=[])
            if kind:
                state["months"].append(a)
            else:
                held = state["spans"]
                held.append((a, b))
                if len(held) > 4096:  # merge as we go, so a key with any number of spans stays small
                    merged: list[tuple[int, int]] = []
                    for x, y in sorted(held):
                        if merged and x <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], y))
                        else:
                            merged.append((x, y))
                    state["spans"] = merged
    close()
    yield from flush()


def orphans(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """The references none of whose keys was there at their instant: ``ref, at``.

    ``refs``: ``ref, keys array<string>, at timestamp``, one row per reference. ``parents``: ``key, since, until``.
    A reference without keys (empty array) is an orphan. Null ``ref``, ``keys`` or ``at`` say nothing and are left
    out, as are parents with a null key or ``since`` and spans that end before they begin.
    """
    spark = refs.sparkSession
    width = shuffle_width(spark)
    clock = F.to_utc_timestamp(F.col("at").cast("timestamp"), F.current_timezone())  # months as the spans count them
    month = F.year(clock) * 12 + F.month(clock) - 1
    refs = refs.select("ref", "keys", "at").where("ref is not null and keys is not null and at is not null")
    refs = refs.withColumn("keys", F.array_distinct(F.array_compact("keys"))).withColumn("month", month)
    wanted = refs.select(F.explode("keys").alias("key"), "month").distinct().select("key", F.lit(1).alias("kind"), F.col("month").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = parents.where("key is not null and since is not null")
    # of the spans that never end, or end together, the earliest holds the others
    spans = spans.groupBy("key", "until").agg(F.min("since").alias("since"))
    spans = spans.select("key", F.lit(0).alias("kind"), micros("since").alias("a"), F.coalesce(micros("until"), F.lit(_FOREVER)).alias("b")).where("a < b")
    ranges = spans.unionByName(wanted).repartition(width, "key").sortWithinPartitions("key", "kind", "a")
    left = ranges.mapInArrow(_survivors, "key string, month int, spans array<array<bigint>>")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asks = refs.select("ref", "at", "month", F.size("keys").alias("n"), F.explode_outer("keys").alias("key"))
    asks = asks.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(salts)).cast("int"))
    none = asks.where("n = 0").select("ref", "at")
    met = asks.where("n > 0").join(left, ["key", "month", "salt"])
    held = F.exists("spans", lambda s: (s[0] <= micros("at")) & (micros("at") < s[1]))
    judged = met.groupBy("ref", "at", "n").agg(F.count(F.lit(1)).alias("missing"), F.max(held).alias("held"))
    return judged.where("missing = n and not held").select("ref", "at").unionByName(none)


# -- the references of a code repository ------------------------------------------------------------------------------


def _inside(folder, target):
    """``target`` from ``folder``, with ``.`` and ``..`` segments resolved; null where it leads out of the root."""
    step = lambda acc, s: (
        F.when(acc.isNull(), acc)
        .when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, target), "/"), F.array().cast("array<string>"), step), "/")


def code_references(relationships: DataFrame) -> DataFrame:
    """``ref, keys, at`` of an edge table, one row per ``id`` at its earliest ``recorded_at``; ``ref`` is ``(id, kind)``.

    Each has one key: ``file:<path as written>``, ``module:<path without its end>``, ``class:<scope>/<name>`` or
    ``package:<name>``; that a path may stand for several files is left to the parents' keys, of which there are far
    fewer (:func:`code_parents`). Targets that are no references (style
    properties) and rows with a null in any needed column are left out.
    """
    row = F.struct("recorded_at", "source_file", "target_symbol", "relationship_type")
    rows = relationships.where("id is not null and recorded_at is not null and source_file is not null and target_symbol is not null")
    rows = rows.groupBy("id").agg(F.min(row).alias("r")).select("id", F.col("r.recorded_at").alias("at"), "r.source_file", "r.target_symbol", "r.relationship_type")
    clean = F.regexp_replace("target_symbol", "^[\\s\"'` ﻿]+|[\\s\"'` ﻿]+$", "")
    rows = rows.withColumn("t", clean).withColumn("scope", F.substring_index("source_file", "/", 1))
    folder = F.when(F.col("source_file").contains("/"), F.regexp_replace("source_file", "/[^/]*$", "")).otherwise("")
    python = F.col("t").rlike(r"^(from|import)\s")
    name = F.regexp_extract("t", r"^(?:from|import)\s+([^\s,;]+)", 1)
    dots = F.length(F.regexp_extract("t", r"^from\s+(\.+)", 1))
    module = F.replace(F.regexp_extract("t", r"^from\s+\.+([^\s.][^\s]*)", 1), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - dots + 1, F.lit(0))), "/")
    relative = F.concat_ws("/", F.when(up != "", up), F.when(module != "", module))
    path = _inside(folder, F.col("t"))
    segments = F.split("t", "/")
    package = F.when(F.col("t").startswith("@"), F.array_join(F.slice(segments, 1, 2), "/")).otherwise(segments[0])
    keys = (
        F.when(F.col("relationship_type") == "depends_on", F.array(F.concat(F.lit("class:"), "scope", F.lit("/"), "t")))
        .when((dots - 1 > F.size(F.split(folder, "/"))), F.array().cast("array<string>"))
        .when(python & (dots > 0), F.array(F.concat(F.lit("module:"), relative)))
        .when(python, F.array(F.concat(F.lit("package:"), F.split(name, r"\.")[0])))
        .when(F.col("t").startswith(".") & path.isNull(), F.array().cast("array<string>"))
        .when(F.col("t").startswith("."), F.array(F.concat(F.lit("file:"), path)))
        .otherwise(F.array(F.concat(F.lit("package:"), package)))
    )
    wanted = F.col("relationship_type").isin("import", "depends_on") & ~((F.col("relationship_type") == "depends_on") & F.col("t").startswith("--")) & (F.col("t") != "")
    return rows.where(wanted).select(F.struct("id", F.col("relationship_type").alias("kind")).alias("ref"), "at", keys.alias("keys"))


def code_parents(chunks: DataFrame, packages: DataFrame) -> DataFrame:
    """``key, since, until`` of files, of the classes in them and of listed packages.

    A file has a key for every way in which an import may name it: its path, the path without a script's ending, and
    without ``/index`` and the ending; a Python file also that of its module.
    """
    rows = chunks.where("source is not null")
    span = [F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")]
    script, module = r"\.(tsx?|jsx?)$", r"(/__init__)?\.py$"
    bare = F.regexp_replace("source", script, "")
    named = F.array(
        F.concat(F.lit("file:"), "source"),
        F.when(F.col("source").rlike(script), F.concat(F.lit("file:"), bare)),
        F.when(F.col("source").rlike("/index" + script), F.concat(F.lit("file:"), F.regexp_replace(bare, "/index$", ""))),
        F.when(F.col("source").endswith(".py"), F.concat(F.lit("module:"), F.regexp_replace("source", r"\.py$", ""))),
        F.when(F.col("source").endswith("/__init__.py"), F.concat(F.lit("module:"), F.regexp_replace("source", module, ""))),
    )
    whole = rows.groupBy("source", F.col("deleted_at").alias("until")).agg(F.min("indexed_at").alias("since"))
    files = whole.select(F.explode(F.array_compact(named)).alias("key"), "since", "until")
    name = F.explode(F.filter(F.transform(F.split("class_name", ","), lambda x: F.trim(x)), lambda x: x != ""))
    classes = rows.where("class_name is not null and class_name != ''").select(F.substring_index("source", "/", 1).alias("scope"), name.alias("name"), *span)
    classes = classes.select(F.concat(F.lit("class:"), "scope", F.lit("/"), "name").alias("key"), "since", "until")
    listed = packages.select(F.concat(F.lit("package:"), "package_name").alias("key"), F.col("listed_at").alias("since"), F.col("removed_at").alias("until"))
    return files.unionByName(classes).unionByName(listed)


def code_orphans(relationships: DataFrame, chunks: DataFrame, packages: DataFrame) -> DataFrame:
    """The orphan references of a repository: ``id, relationship_type, recorded_at`` (the earliest of the id)."""
    found = orphans(code_references(relationships), code_parents(chunks, packages))
    return found.select("ref.id", F.col("ref.kind").alias("relationship_type"), F.col("at").alias("recorded_at"))
