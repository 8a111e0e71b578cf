import json

import pytest

from sedimark import cli
from sedimark.api import NO_CONTEXT, NO_DATA, NO_INDEX, OK, Engine
from sedimark.config import Settings
from sedimark.operators.search import InvalidQuery
from sedimark.streaming.ingest import Index, NoRoot, ingest_stream


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    write(
        root,
        web__angular_DOT_json="{}",
        api__nest_cli_DOT_json="{}",
        web__src__a_DOT_ts="import { S } from './s';\n@Component()\nexport class AComponent {\n  constructor(private readonly s: Svc) {}\n  go() { return 'ticket ledger'; }\n}\n",
        web__src__s_DOT_ts="export class Svc {\n  find() { return 1; }\n}\n",
        web__src__a_DOT_css=".card-row { display: flex; }\n.unused { color: red; }\n",
        web__src__a_DOT_html='<div class="card-row"><p>x</p></div>\n',
        api__m_DOT_prisma="model User {\n  id Int @id\n}\n",
    )
    (root / "api" / "nest_cli.json").rename(root / "api" / "nest-cli.json")
    return root


def test_whole_cycle(spark, project, tmp_path):
    engine = Engine(spark, str(project), str(tmp_path / "index"))
    assert engine.code_metrics() == {"status": NO_INDEX} and engine.query("x")["status"] == NO_INDEX and engine.sync()["reason"] == "no_index"
    assert engine.ingest() == {"processed": 5, "new": 5, "modified": 0, "deleted": 0, "unchanged": 0, "chunks": 5}
    assert engine.sync() == {"updated": False, "reason": "clean", "changed_count": 0}
    answer = engine.query("ticket ledger")
    assert answer["status"] == OK and [r["source"] for r in answer["retrieved_chunks"]] == ["web/src/a.ts"]
    assert '<imported_file path="web/src/s.ts"' in answer["context"] and answer["context"].count("<file ") == 1
    assert engine.query("ticket ledger", scope="nestjs")["status"] == NO_CONTEXT and "context" not in engine.query("qqq zzz")
    for bad in ("", "x" * 3000):
        with pytest.raises(InvalidQuery):
            engine.query(bad)
    shown = engine.project_map()
    assert "Components (1): AComponent" in shown["text"] and shown["models"] == ["User"] and shown["files"] == {"angular": 4, "nestjs": 1}
    assert engine.code_metrics(3)["summary"]["files_exceeding_threshold"] == 3
    styles = engine.styles_map()
    assert styles["unused"] == {"web/src/a.css": ["unused"]} and any(r["cls"] == "card-row" and r["selector"] == ".card-row" for r in styles["trace"])
    assert engine.styles_map(prop="flex")["property_matches"][0]["selector"] == ".card-row"
    assert engine.audit("WARNING")["total_issues"] == 1 and engine.audit()["total_issues"] == 2

    (project / "web/src/s.ts").write_text("export class Svc2 {}\n")
    (project / "api/m.prisma").unlink()
    (project / "web/src/n.ts").write_text("export const n = 1;\n")
    assert engine.sync() == {"updated": True, "reason": "synced", "changed_count": 3}
    table = {r.id for r in engine.chunks().select("id").collect()}
    fresh = Engine(spark, str(project), str(tmp_path / "other"))
    fresh.ingest()
    assert table == {r.id for r in fresh.chunks().select("id").collect()}
    assert {tuple(r) for r in engine.index.edges.read().select("id").collect()} == {tuple(r) for r in fresh.index.edges.read().select("id").collect()}
    newer = Engine(spark, str(project), str(tmp_path / "index"), Settings(schema_version="2"))
    assert newer.index.check() == (False, "schema_version") and newer.sync()["changed_count"] == -1 and newer.index.check() == (True, "ok")


def test_reranker_failure_keeps_the_first(spark, project, tmp_path):
    def broken(query, texts):
        raise RuntimeError("model lost")

    engine = Engine(spark, str(project), str(tmp_path / "i"), reranker=broken, generator=lambda p: p[:6])
    engine.ingest()
    answer = engine.query("ticket", k=2)
    assert answer["status"] == OK and answer["response"] == "Answer" and len({r["source"] for r in answer["retrieved_chunks"]}) == 2
    model = Engine(spark, str(project), str(tmp_path / "i"), reranker=lambda q, ts: [5.0 if "find" in t else -9.0 for t in ts])
    assert [r["source"] for r in model.query("ticket")["retrieved_chunks"]] == ["web/src/s.ts"]


def test_failures(spark, tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none"))
    with pytest.raises(PermissionError):
        Engine(spark, "/etc")
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "a.ts").write_text("let a;")
    with pytest.raises(NoRoot):
        Engine(spark, str(bare), str(tmp_path / "x")).ingest()
    (bare / "pyproject.toml").write_text("")
    (bare / "a.ts").unlink()
    assert Engine(spark, str(bare), str(tmp_path / "x")).ingest()["processed"] == 0
    with pytest.raises(SystemExit) as stop:
        cli.arguments(["query", "-p", "x"])
    assert stop.value.code == 2


def test_command_line(spark, project, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["ingest", "-p", str(project)]) == 0
    assert json.loads(capsys.readouterr().out)["new"] == 5
    assert cli.main(["loc", "-p", str(project), "-j"]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == OK
    for command in ("map", "styles", "audit", "config", "loc"):
        assert cli.main([command, "-p", str(project)]) == 0
    assert cli.main(["query", "-p", str(project), "-q", "ticket ledger", "-s", "angular"]) == 0
    assert "<context>" in capsys.readouterr().out
    assert cli.main(["query", "-p", str(project), "-q", " "]) == 1 and cli.main(["map", "-p", str(project / "none")]) == 1


def test_empty_index(spark, project, tmp_path):
    engine = Engine(spark, str(project), str(tmp_path / "i"))
    for p in project.rglob("*.*"):
        if p.suffix in (".ts", ".css", ".html", ".prisma"):
            p.unlink()
    (project / "web/src/b.ts").write_text("   ")
    engine.ingest()
    assert engine.code_metrics()["status"] == NO_DATA and engine.project_map() == {"status": NO_DATA}


def test_stream_is_exactly_once(spark, tmp_path):
    schema = "source string, scope string, content string, seen int"
    feed = tmp_path / "feed"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(feed))
    index = Index(spark, str(tmp_path / "index"))
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(str(feed)), index, str(tmp_path / "ck")).awaitTermination()
    add(("a.py", "s", "def old():\n    pass\n", 1), ("a.py", "s", "def f():\n    pass\n", 2), ("b.py", "s", "x = 1\n", 1))
    run()
    assert {(r.source, r.class_name) for r in index.chunks.read().collect()} == {("a.py", "f"), ("b.py", "")}
    add(("a.py", "s", "def g():\n    pass\n\n\ny = 1\n", 3))
    run()
    assert {(r.source, r.class_name) for r in index.chunks.read().collect()} == {("a.py", "g"), ("b.py", "")}
    version = index.chunks.version()
    run()
    assert index.chunks.version() == version


def test_a_stream_keeps_edges_and_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    index = Index(spark, str(tmp_path / "index"), Settings(dimensions=4))
    files = lambda: spark.readStream.schema("source string, scope string, content string").json(str(tmp_path / "in"))

    def feed(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("source", "scope", "content"), r))) + "\n" for r in rows))
        ingest_stream(files(), index, str(tmp_path / "checkpoint")).awaitTermination()

    feed("1.json", ("a.ts", "s", "import { x } from './b';\nexport const a = x;\n"), ("c.ts", "s", "export const c = 1;\n"))
    assert {(r.source_file, r.target_symbol) for r in index.edges.read().collect()} == {("a.ts", "./b")} and index.exists() and index.check() == (True, "ok")
    feed("2.json", ("a.ts", "s", "import { y } from './d';\nexport const a = y;\n"))
    assert {(r.source_file, r.target_symbol) for r in index.edges.read().collect()} == {("a.ts", "./d")}
    assert {r.rel_path for r in index.state.read().collect()} == {"a.ts", "c.ts"}
    assert index.chunks.read().where("source = 'a.ts'").count() == 1 and index.postings.read().where("term = 'y'").count() == 1 and index.postings.read().where("term = 'x'").count() == 0
