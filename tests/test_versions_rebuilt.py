"""A consumer behind a compaction or a rebuild of its source gets each change once."""

from sedimark.sources.versions import VersionedTable, process_new


def test_deltas_over_compaction_and_rebuild(spark, tmp_path):
    source, target = VersionedTable(spark, f"{tmp_path}/s"), VersionedTable(spark, f"{tmp_path}/t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    read = lambda t: sorted(map(tuple, t.read().collect()))
    seen = []

    def note(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df

    source.commit(frame((1, "a"), (2, "b"), (3, "c"), (4, None)))
    process_new(source, target, note)
    source.commit(frame((2, "B")), frame((1, "")))
    source.compact(1)
    process_new(source, target, note)
    assert read(target) == [(2, "B"), (3, "c"), (4, None)] and seen[1:] == [[2]]
    source.compact(1)
    process_new(source, target, note)
    assert seen[2:] == [[]] and target.manifest()["processed"] == {source.root: 4}
    source.commit(frame((3, "c"), (5, "e")), rebuild=True)
    process_new(source, target, note)
    assert read(target) == [(3, "c"), (5, "e")] and seen[3:] == [[5]]
    assert {(r.id, r._change) for r in source.changes(4, 5).collect()} == {(2, "delete"), (4, "delete"), (5, "upsert")}
    source.commit(rebuild=True)
    process_new(source, target, note)
    assert read(target) == [] and process_new(source, target, note) is None


def test_deletes_and_outputs_over_a_compaction(spark, tmp_path):
    """A delete before a compaction arrives, what did not change is not fed again, and no old output stays."""
    source, target = VersionedTable(spark, f"{tmp_path}/s"), VersionedTable(spark, f"{tmp_path}/t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    fed = []

    def keep(df):
        fed.append(sorted(r.id for r in df.collect()))
        return df.where("v != 'drop'")

    source.commit(frame((1, "a"), (2, "b"), (3, "keep"), (4, "d")))
    process_new(source, target, keep)
    source.commit(deletes=frame((2, "")))
    source.compact()
    source.commit(frame((3, "drop"), (4, "d2")))
    source.commit(frame((4, "d3")), frame((5, "")))
    source.compact()
    assert source.changes(5, 6).isEmpty()
    process_new(source, target, keep)
    assert sorted(map(tuple, target.read().collect())) == [(1, "a"), (4, "d3")]
    assert fed == [[1, 2, 3, 4], [3, 4]]
    assert {(r.id, r._change) for r in target.changes(1).collect()} == {(2, "delete"), (3, "delete"), (5, "delete"), (4, "upsert")}
