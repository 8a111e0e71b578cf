from pyspark.sql import functions as F

from sedimark.operators import audit, edges, styles
from sedimark.operators.chunkers import chunk_text
from sedimark.sources import files as sources


def rules(spark, *rows):
    data = [(f, s, c, i + 1, i + 2, p, m) for i, (f, s, c, p, m) in enumerate(rows)]
    return spark.createDataFrame(data, "css_file string, selector string, classes array<string>, start_line int, end_line int, properties map<string,string>, media_query string")


def found(df):
    return {(r.category, r.severity, r.selector) for r in df.collect()}


def test_audit_positives_and_negatives(spark):
    table = rules(
        spark,
        ("a.css", ".card-row", ["card-row"], {"display": "flex", "flex-wrap": "wrap"}, ""),
        ("a.css", ".card-ok", ["card-ok"], {"display": "flex", "min-width": "0", "flex-wrap": "wrap"}, ""),
        ("a.css", ".tabs", ["tabs"], {"display": "flex", "min-width": "0"}, ""),
        ("a.css", ".tabs-col", ["tabs-col"], {"display": "flex", "flex-direction": "column", "min-width": "0"}, ""),
        ("a.css", ".wide", ["wide"], {"width": "900px"}, "@media (max-width: 600px)"),
        ("a.css", ".wide-ok", ["wide-ok"], {"width": "900px", "max-width": "100%"}, ""),
        ("a.css", ".gr", ["gr"], {"grid-template-columns": "400px 300px"}, "@media (max-width: 40em)"),
        ("a.css", ".description", ["description"], {"color": "red"}, ""),
        ("a.css", ".description-ok", ["description-ok"], {"overflow-wrap": "anywhere"}, ""),
        ("a.css", ".z", ["z"], {"z-index": "200"}, ""),
        ("a.css", ".z-ok", ["z-ok"], {"z-index": "200", "position": "fixed"}, ""),
        ("a.css", "*", [], {"z-index": "999"}, ""),
        ("a.css", ".z:hover", ["z"], {"z-index": "300"}, ""),
        ("b.css", ".inner-row", ["inner-row"], {"display": "grid"}, ""),
        ("b.css", ".safe", ["safe"], {"overflow": "hidden"}, ""),
        ("c.css", ".held-item", ["held-item"], {"display": "grid"}, ""),
        ("c.css", ".held", ["held"], {"overflow-x": "auto"}, ""),
    )
    parents = spark.createDataFrame([("inner-row", "safe"), ("inner-row", "other")], "child string, parent string")
    got = found(audit.audit(table, parents))
    assert ("Flexbox/Grid Overflow Risk", "CRITICAL", ".card-row") in got and not any(s == ".card-ok" for _, _, s in got)
    assert ("Flex Wrap Overflow Risk", "WARNING", ".tabs") in got and ("Flex Wrap Overflow Risk", "WARNING", ".tabs-col") not in got
    assert ("Breakpoint Width Overflow", "WARNING", ".wide") in got and ("Breakpoint Width Overflow", "WARNING", ".gr") in got
    assert ("Fixed Width Responsive Risk", "WARNING", ".wide") in got and ("Fixed Width Responsive Risk", "WARNING", ".wide-ok") not in got
    assert ("Text Break Risk", "WARNING", ".description") in got and ("Text Break Risk", "WARNING", ".description-ok") not in got
    assert ("Z-Index Stacking Conflict", "INFO", ".z") in got and not any(c.startswith("Z") and s in (".z-ok", "*", ".z:hover") for c, _, s in got)
    assert ("Flexbox/Grid Overflow Risk", "INFO", ".inner-row") in got and ("Flexbox/Grid Overflow Risk", "INFO", ".held-item") in got
    assert {s for _, s, _ in found(audit.audit(table, parents, "critical"))} == {"CRITICAL"}
    assert {r.file for r in audit.audit(table, parents, files="B.css, zzz").collect()} == {"b.css"}
    order = [r.severity for r in audit.audit(table, parents).collect()]
    assert order == sorted(order, key=["CRITICAL", "WARNING", "INFO"].index)


def test_ancestors_are_the_six_before(spark):
    html = " ".join(f'<p class="c{i}">' for i in range(9))
    got = {(r.child, r.parent) for r in audit.ancestors(spark.createDataFrame([(html,)], "content string")).collect()}
    assert got == {(f"c{i}", f"c{j}") for i in range(9) for j in range(max(0, i - 6), i)}


def test_styles(spark):
    declared = spark.createDataFrame([("a", "x.css"), ("dead", "x.css"), ("fa-user", "x.css"), ("btn-big", "y.css"), ("active", "y.css")], "cls string, css_file string")
    used = spark.createDataFrame([("p.tsx", "a", False), ("p.tsx", "btn-", True), ("p.tsx", "active", False), ("q.tsx", "lone", False)], "source string, cls string, dynamic boolean")
    assert {tuple(r) for r in styles.dead_classes(declared, used).collect()} == {("x.css", "dead")}
    table = rules(spark, ("x.css", ".a", ["a"], {"color": "red"}, ""), ("x.css", ".active", ["active"], {"color": "blue"}, ""), ("x.css", ".a.active", ["a", "active"], {"width": "1px"}, ""))
    got = {(r.component, r.cls, r.selector) for r in styles.component_trace(used, table).collect()}
    assert got == {("p.tsx", "a", ".a"), ("p.tsx", "a", ".a.active"), ("p.tsx", "active", ".a.active"), ("q.tsx", "lone", None)}
    assert {r.selector for r in styles.component_trace(used, table, prop="WIDTH").collect()} == {".a.active"}
    repo = lambda df, c: df.withColumn(c, F.concat(F.lit("r/"), c))
    short = {(r.component, r.cls, r.rules) for r in styles.trace_summary(repo(used, "source"), repo(table, "css_file")).collect()}
    assert short == {("r/p.tsx", "a", 2), ("r/p.tsx", "active", 1), ("r/q.tsx", "lone", 0)}
    assert [r.matching for r in styles.property_matches(table, "blue").collect()] == ['{"color":"blue"}']


def test_edges_and_enrichment(spark):
    chunks = spark.createDataFrame(
        [("1", "r/a.ts", "A", "['./b', 'lib']", "BSvc", 1), ("2", "r/b.ts", "BSvc", "", "", 1), ("3", "r/c.ts", "C,D", None, None, 1), ("4", "r/m.prisma", "User", "", "Post", 1), ("5", "r/n.prisma", "Post", "", "", 1)],
        "id string, source string, class_name string, imports string, dependencies string, start_line int",
    )
    table = edges.extract(chunks)
    assert {(r.source_file, r.target_symbol, r.relationship_type) for r in table.collect()} == {("r/a.ts", "./b", "import"), ("r/a.ts", "lib", "import"), ("r/a.ts", "BSvc", "depends_on"), ("r/m.prisma", "Post", "depends_on")}
    hits = spark.createDataFrame([("r/a.ts", 1), ("r/m.prisma", 2)], "source string, rank int")
    got = [(r.file, r.branch, r.target) for r in edges.enrich(hits, table, chunks).orderBy("rank", "branch").collect()]
    assert got == [("r/b.ts", 0, "./b"), ("r/n.prisma", 1, "Post")]
    assert edges.enrich(hits, table, chunks, 1).count() == 1
    fresh = table.limit(0).unionByName(spark.createDataFrame([("x", "r/a.ts", "new", "import")], table.schema))
    assert {r.target_symbol for r in edges.replace_edges(table, fresh).collect()} == {"new", "Post"}


def covered(chunks, text):
    lines = {i for c in chunks for i in range(c["start_line"], c["end_line"] + 1)}
    return all(i in lines for i, x in enumerate(text.split("\n"), 1) if x.strip())


def test_chunkers():
    assert chunk_text("r/a.ts", "r", "") == [] and chunk_text("r/a.ts", "r", None) == [] and chunk_text("r/a.ts", "r", "// only\n/* x */\n") == []
    small = chunk_text("r/a.ts", "r", "import { B } from './b';\nexport class A {\n  go() { return 1; }\n}\n")
    assert len(small) == 1 and small[0]["class_name"] == "A" and small[0]["imports"] == ["./b"] and small[0]["id"] == "r/a.ts#L1-4"
    long = "export class Big {\n  constructor(private readonly s: Svc) {}\n" + "".join(f"  m{i}() {{ return {i}; }}\n" for i in range(60)) + "}\nexport enum E { A }\nconst loose = 1;\n"
    parts = chunk_text("r/big.ts", "r", long)
    assert {"m0", "m59", "constructor"} <= {p["method_name"] for p in parts} and any(p["type"] == "enum" and p["class_name"] == "E" for p in parts) and covered(parts, long)
    py = "import os\n\n\n@dec\nclass A:\n    def __init__(self):\n        pass\n" + "".join(f"\n    @p\n    def m{i}(self):\n        return {i}\n" for i in range(15)) + "\n\n@dec\ndef free():\n    return 1\n"
    parts = chunk_text("r/a.py", "r", py)
    assert {"__init__", "m0", "m14"} <= {p["method_name"] for p in parts} and any(p["class_name"] == "free" and p["text"].startswith("@dec") for p in parts) and covered(parts, py)
    broken = "class A:\n    def f(self:\n" + "    x\n" * 60
    assert covered(chunk_text("r/b.py", "r", broken), broken)
    schema = "// c\nmodel A {\n  id Int\n  b  B\n}\n\nenum B {\n  X\n}\n" + "model C {\n  id Int\n}\n" * 18
    parts = chunk_text("r/s.prisma", "r", schema)
    assert len(parts) == 20 and parts[0]["dependencies"] == ["B"] and parts[0]["models"] == ["A"] and parts[0]["start_line"] == 1
    html = "<main>\n" + "<p class='k'>x</p>\n" * 60 + "<footer>\n<b>y</b>\n</footer>\n</main>\n"
    parts = chunk_text("r/x.html", "r", html)
    assert len(parts) > 1 and covered(parts, html) and all(p["end_line"] - p["start_line"] < 50 for p in parts)
    sixty = "\n".join(f"# {i}" if i else "x = 1" for i in range(60))
    assert [(p["start_line"], p["end_line"]) for p in chunk_text("r/x.txt", "r", sixty)] == [(1, 50), (41, 60)]


def test_ignore_and_roots(spark, tmp_path):
    patterns = sources.ignore_patterns("# c\n\n*.log\n/build\nsrc/gen/\n!keep\n")
    assert patterns == ["*.log", "/build", "src/gen/"]
    assert sources.is_ignored("a/x.log", patterns) and sources.is_ignored("q/build/y.ts", patterns) and sources.is_ignored("m/src/gen/z.ts", patterns) and not sources.is_ignored("src/a.ts", patterns)
    for p in ("web/angular.json", "web/src/a.ts", "web/.hidden.ts", "api/nest-cli.json", "api/src/b.ts", "api/sub/next.config.js", "node_modules/x.ts", "tool/pyproject.toml", "orphan.py", "api/skip.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x \xff\n")
    names = sources.list_files(str(tmp_path))
    assert set(names) == {"web/src/a.ts", "web/.hidden.ts", "api/src/b.ts", "api/sub/next.config.js", "orphan.py"}
    files = sources.read_listed(spark, str(tmp_path), names)
    assert {r.content for r in files.collect()} == {"x \n"}
    marks = [("web/angular.json",), ("api/nest-cli.json",), ("api/sub/next.config.js",), ("tool/pyproject.toml",)]
    roots = sources.find_roots(spark.createDataFrame(marks, "rel_path string"))
    assert {(r.folder, r.scope) for r in roots.collect()} == {("web", "angular"), ("api", "nestjs"), ("tool", "python")}
    assert {r.rel_path: r.scope for r in sources.assign_scopes(files, roots).collect()} == {"web/src/a.ts": "angular", "web/.hidden.ts": "angular", "api/src/b.ts": "nestjs", "api/sub/next.config.js": "nestjs"}
    stored = sources.read_store(spark, str(tmp_path), patterns=["sub"])
    assert {r.rel_path for r in stored.collect()} == {"web/src/a.ts", "api/src/b.ts", "orphan.py"}
