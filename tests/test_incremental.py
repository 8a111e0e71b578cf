import datetime as dt
import hashlib

import pytest

from sedimark.operators.files import join_pieces
from sedimark.operators.incremental import diff_manifests, manifest_of_runs, record_delta, to_process
from sedimark.sources.versions import CommitConflict, VersionedTable, process_new

T0 = dt.datetime(2025, 1, 1)
CHUNKS = "source string, start_line int, end_line int, text string, deleted_at timestamp, path string"
STATE = "run_id long, rel_path string, sha256 string, recorded_at timestamp, digest string"
RUNS = "run_id long, scope string, finished_at timestamp, status string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def day(n):
    return T0 + dt.timedelta(days=n)


def test_join_pieces():
    assert join_pieces([3, 1], [4, 2], ["c\nd", "a\nb\n"]) == "a\nb\nc\nd"
    assert join_pieces([1, 2, 1], [3, 5, 3], ["a\nb\nc\n", "b\nc\nd\ne", "a\nb\nc\n"]) == "a\nb\nc\nd\ne"
    assert join_pieces([1, 1], [1, 1], [None, "x"]) == "x" and join_pieces([1], [1], [None]) == ""


def test_to_process(spark):
    chunks = spark.createDataFrame(
        [("r/same.ts", 1, 2, "a\nb\n", None, "p"), ("r/same.ts", 2, 3, "b\nc", None, "p"), ("r/same.ts", 1, 2, "a\nb\n", None, "p"), ("r/new.ts", 1, 1, "n", None, None), ("r/changed.ts", 1, 1, "v2", None, None), ("r/gone.ts", 1, 1, "g", T0, None),
         ("r/failed.ts", 1, 1, "f", None, None), ("r/nohash.ts", 1, 1, "h", None, None), ("r/back.ts", 1, 1, "v1", None, None), ("r/other.ts", 1, 1, "o", None, None), (None, 1, 1, "x", None, None), ("r/null.ts", 1, 1, None, None, None)],
        CHUNKS,
    )
    runs = spark.createDataFrame([(1, "r", day(1), "success"), (2, "r", day(2), "success"), (3, "r", day(3), "failed"), (4, "r", None, "success"), (5, "q", day(9), "success")], RUNS)
    state = spark.createDataFrame(
        [(1, "./r/same.ts", "SHA256:" + sha("a\nb\nc").upper(), T0, "k"), (1, "r\\changed.ts", sha("v1"), T0, "k"), (3, "r/failed.ts", sha("f"), T0, "k"), (4, "r/failed.ts", sha("f"), T0, "k"), (2, "r/nohash.ts", "", T0, "k"), (1, "r/nohash.ts", None, T0, "k"),
         (1, "r/back.ts", sha("v1"), T0, "k"), (2, "r/back.ts", sha("v2"), T0, "k"), (5, "r/other.ts", sha("o"), T0, "k"), (1, "r/removed.ts", sha("z"), T0, "k"), (None, None, None, None, None), (2, "r/null.ts", sha(""), T0, "k")],
        STATE,
    )
    got = {r.path: r.change for r in to_process(chunks, state, runs).collect()}
    assert got == {"r/new.ts": "added", "r/changed.ts": "changed", "r/failed.ts": "added", "r/nohash.ts": "added", "r/back.ts": "changed", "r/other.ts": "added"}
    assert {r.path for r in to_process(chunks, state.limit(0), runs).collect()} == set(got) | {"r/same.ts", "r/null.ts"}
    assert to_process(chunks.limit(0), state, runs).count() == 0
    assert manifest_of_runs(state, runs.limit(0)).count() == 0


def test_diff_manifests_with_deletion_vector(spark):
    schema = "path string, digest string, deleted boolean"
    old = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("c", "1", True)], schema)
    new = spark.createDataFrame([("a", "1", False), ("b", "1", True), ("c", "2", None), ("d", None, False)], schema)
    assert {r.path: r.change for r in diff_manifests(old, new).collect()} == {"a": "kept", "b": "removed", "c": "added", "d": "added"}


def test_record_delta(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "z")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (2, "B"), (4, None)], "k long, v string")
    assert {(r.k, r.v, r._change) for r in record_delta(old, new, "k").collect()} == {(2, "B", "changed"), (3, "c", "removed"), (4, None, "added")}


def test_versions_survive_failures_without_skipping_or_repeating(spark, tmp_path):
    source, target = VersionedTable(spark, f"{tmp_path}/s", "id"), VersionedTable(spark, f"{tmp_path}/t", "id")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    read = lambda t, v=None: sorted(map(tuple, t.read(v).collect()))
    double = lambda df: df.selectExpr("id", "concat(v, v) as v")
    assert source.read() is None and process_new(source, target, double) is None
    source.commit(frame((1, "a"), (2, "b")))
    assert process_new(source, target, double) == 1 and read(target) == [(1, "aa"), (2, "bb")]
    assert process_new(source, target, double) is None
    source.commit(frame((2, "c"), (3, "d")), frame((1, "")))
    assert read(source) == [(2, "c"), (3, "d")] and read(source, 1) == [(1, "a"), (2, "b")]

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(source, target, fails)
    assert target.version() == 1
    process_new(source, target, double)
    assert read(target) == [(2, "cc"), (3, "dd")] and target.manifest()["processed"] == {source.root: 2}
    source.commit(frame((1, "again")))
    process_new(source, target, double)
    assert read(target) == [(1, "againagain"), (2, "cc"), (3, "dd")]
    source.compact(1)
    process_new(source, target, double)
    assert read(target) == [(1, "againagain"), (2, "cc"), (3, "dd")] == sorted((r[0], r[1] * 2) for r in read(source))
    with pytest.raises(CommitConflict):
        source._commit({**source.manifest(), "version": source.version()})


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = VersionedTable(spark, f"{tmp_path}/w", "id"), VersionedTable(spark, f"{tmp_path}/w", "id")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    a.commit(rows)
    manifest = {**b.manifest(), "version": 2}
    a.commit(rows)
    for commit in (b._commit, lambda m: b._link(b._path(b._manifest_path(2)).toUri().getPath(), b"{}")):
        with pytest.raises(CommitConflict):
            commit(manifest)
    assert a.version() == 2 and a.read().count() == 1
