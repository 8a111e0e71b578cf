import pytest
from pyspark.sql import functions as F

from sedimark.functions import code, scripts
from sedimark.operators import loc, search, windows
from sedimark.operators.search import InvalidQuery


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


def test_windows_of_sixty_lines(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 61))), (2, ""), (3, None), (4, "one"), (5, "a\n" * 50)], "id long, text string")
    got = {(r.id, r.start_line, r.end_line) for r in windows.line_windows(df, "id").collect()}
    assert got == {(1, 1, 50), (1, 41, 60), (4, 1, 1), (5, 1, 50)}


def test_fusion_merges_overlaps_and_keeps_distant_blocks(spark):
    hits = spark.createDataFrame([("a", 1, "1\n2\n3\n4", 1), ("a", 3, "3x\n4x\n5\n6", 2), ("a", 50, "far", 3), ("b", 1, "q", 4)], "source string, start_line int, text string, rank int")
    got = {(r.source, r.start_line, r.end_line): (r.content, r.file_rank) for r in windows.fuse(hits).collect()}
    assert got == {("a", 1, 6): ("1\n2\n3x\n4x\n5\n6", 1), ("a", 50, 50): ("far", 1), ("b", 1, 1): ("q", 4)}


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 40), (2, 70), (3, 5)], "pos int, n int")
    assert [r.pos for r in windows.within_budget(df, "pos", "n", 100).collect()] == [1]


def test_code_line_counts(spark):
    assert one(spark, code.code_lines(F.col("t")), t="a = 1\n\n# x\n  // y\n /* z\n * q\nb") == 2
    assert one(spark, code.css_code_lines(F.col("t")), t="#a { x: y }\n/* c */\n\n") == 1


@pytest.mark.parametrize("source,want", [("a/b.TS", ".ts"), ("a/b.component.html", ".html"), ("a/.env", "unknown"), ("Makefile", "unknown"), ("a.b/c", "unknown")])
def test_extension(spark, source, want):
    assert one(spark, code.extension(F.col("s")), s=source) == want


@pytest.mark.parametrize("name,want", [("UserController", "Controllers"), ("AuthGuard", "Guards"), ("ServiceX", "Other"), ("AppContext", "Contexts")])
def test_category(spark, name, want):
    assert one(spark, code.class_category(F.col("s")), s=name) == want


@pytest.mark.parametrize("value,want", [("10px", 10.0), (" 2rem ", 32.0), ("1.5EM", 24.0), ("50%", None), ("auto", None), ("", None)])
def test_length(spark, value, want):
    assert one(spark, code.length_px(F.col("s")), s=value) == want


@pytest.mark.parametrize(
    "text,name,want",
    [
        ("// note\nlet a = 1;\n// @ts-ignore\nb()\n\n\n\nc()  ", "x.ts", "let a = 1;\n// @ts-ignore\nb()\n\nc()"),
        ("# note\nx = 1  # kept\n# type: ignore\n", "x.py", "x = 1  # kept\n# type: ignore"),
        ("<!-- a -->\n<p>b</p>", "x.html", "<p>b</p>"), ("/* a */\nmodel A {\n}", "x.prisma", "model A {\n}"), ("// stays", "x.jsx", "// stays"), ("", "x.ts", ""),
    ],
)
def test_compress(spark, text, name, want):
    assert one(spark, code.compress_code(F.col("t"), code.extension(F.col("s"))), t=text, s=name) == want


def test_escape_and_truncate(spark):
    assert one(spark, code.xml_escape(F.col("t")), t="a<b>&\"'\x00\u200b\n\t") == "a&lt;b&gt;&amp;&quot;&apos;\n\t"
    text = "<file>1</file><file>2</file><file>3"
    assert one(spark, code.truncate_safe(F.col("t"), 30), t=text) == "<file>1</file><file>2</file>\n[TRUNCATED]"
    assert one(spark, code.truncate_safe(F.col("t"), 100), t=text) == text
    assert one(spark, code.truncate_safe(F.col("t"), 5), t=text) == "<file\n[TRUNCATED]"


def test_comment_only(spark):
    c = code.comment_only(F.col("t"), F.col("s"))
    assert one(spark, c, t="// a\n/* b\n*/ ", s=".ts") and not one(spark, c, t="// a\nb", s=".ts") and one(spark, c, t=" \n", s=".py") and not one(spark, c, t="# a", s=".py")


def test_html_metadata(spark):
    got = one(spark, code.html_metadata(F.col("t")), t='<html><title> X </title><script src="a.js"></script><link href="b.css"><app-row class="p ${q} r" [class.on]="x"></app-row>')
    assert got["tags"] == sorted(["html", "title", "script", "link", "app-row", "p", "r", "on"]) and got["dependencies"] == ["a.js", "b.css"] and got["title"] == "X" and got["directives"] == ["app-row"]


def test_css_functions(spark):
    t = ".a .b:hover, .c { color: var(--x); --y: 1 }\n/* .no */ @media (x) { .d { background: url(.e) } } .f{}"
    assert one(spark, code.css_classes(F.col("t")), t=t) == ["a", "b", "c", "d"] and one(spark, code.css_variables(F.col("t")), t=t) == ["--x", "--y"] and one(spark, code.css_directives(F.col("t")), t=t) == ["@media"]


def test_css_rules():
    rules = scripts.css_rules(".a { color: red; Color: blue }\n@media (max-width: 10px) {\n  .b, .c {\n    width: 5px;\n  }\n}\n")
    assert [(r["selector"], r["start_line"], r["end_line"], r["properties"], r["media_query"]) for r in rules] == [(".a", 1, 1, {"color": "blue"}, ""), (".b, .c", 3, 5, {"width": "5px"}, "@media (max-width: 10px)")]
    assert rules[1]["classes"] == ["b", "c"]


def test_script_extraction():
    text = "// c\nimport a, { b } from './x';\nimport 'y';\nimport {\n  c,\n} from \"z\";\n\nclass A {\n  constructor(private readonly s: Svc, t: Tip) {}\n  @Dec()\n  async go<T>(x: T): Promise<T> {\n    if (x) { return x; }\n  }\n  static of() { return new A(); }\n}\n"
    block, modules = scripts.ts_imports(text)
    assert modules == ["./x", "y", "z"] and block.endswith('"z";') and scripts.injected_types(text) == ["Svc", "Tip"]
    assert [m[0] for m in scripts.ts_methods(text[text.index("class") :])] == ["constructor", "go", "of"]
    assert scripts.jsx_classes("<p className=\"a b\" class='c'/> cn('d', x && 'e') `f-${g}` const boxClass = q ? 'h' : 'i'") == ["[BEM]f-", "a", "b", "c", "d", "e", "h", "i"]
    assert scripts.py_imports('"""d"""\nimport os\nfrom .a import (\n  b,\n  c)\nx = 1\nimport late\n')[1] == ["import os", "from .a import ( b, c)"]
    assert scripts.blank_noise("a // b\n'c'") == "a     \n   " and scripts.brace_balance("{ '}' // {\n}") == (1, 1)
    assert scripts.resolve_import("r/a/b.ts", "../c")[:2] == ["r/c", "r/c.ts"] and scripts.resolve_import("r/a/b.py", "from ..c.d import e") == ["r/c/d.py", "r/c/d/__init__.py", "r/c/d"] and scripts.resolve_import("r/a.ts", "lib") == []
    assert scripts.prisma_dependencies("model A {\n  b B[]\n  s String // C\n}", "A") == ["B"]
    assert scripts.exact_code_lines('"""doc\nmore\n"""\n# c\nx = 1\n', ".py") == 1


def test_search(spark):
    rows = spark.createDataFrame([(1, "apple pie recipe", [0.0, 0.0], "x"), (2, "apple apple", [1.0, 0.0], "y"), (3, "pear tart", [0.0, 3.0], "x"), (4, None, [1.0], "x")], "id long, text string, vector array<float>, scope string")
    assert [r.id for r in search.vector_topk(rows, [0.0, 0.0], 2).collect()] == [1, 2]
    assert [r.id for r in search.vector_topk(rows, [1.0, 0.0], 1, where=search.matches(scope="x")).collect()] == [1]
    assert [r.id for r in search.text_topk(rows, "apple", 5).orderBy("rank").collect()] == [2, 1]
    assert search.text_topk(rows, "?!", 5).count() == 0
    fused = search.hybrid(rows, "pear", [0.0, 0.0], 3).orderBy("rank").collect()
    assert fused[0].id == 3 and fused[0].score == pytest.approx(1 / 61 + 1 / 63, abs=1e-8)
    kept = search.rerank(rows.where("id < 4"), "apple pie", 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in kept] == [(1, 10.0), (2, 0.0)]
    many = search.vector_topk_many(rows.where("id < 4"), spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 3.0])], "query_id long, vector array<float>"), 2, block=1)
    assert {(r.query_id, r.id, r["rank"]) for r in many.collect()} == {(7, 1, 1), (7, 2, 2), (8, 3, 1), (8, 1, 2)}
    with pytest.raises(InvalidQuery):
        search.vector_topk(rows, [0.0, 0.0], 0)


def test_queries_are_checked():
    assert search.sanitize_query(" a\x00b\tc ") == "ab\tc"
    for bad in ("", " \x01 ", "x" * 2001):
        with pytest.raises(InvalidQuery):
            search.sanitize_query(bad)


def test_mock_embedding_is_stable():
    a = search.mock_embedding("x")
    assert a == search.mock_embedding("x") != search.mock_embedding("y") and len(a) == 768 and all(-1 <= v <= 1 for v in a)


def test_loc(spark):
    rows = spark.createDataFrame([("a.ts", 300, 250), ("a.ts", 500, 200), ("b.py", 210, 0), (" ", 5, 5), ("c.py", 10, 3)], "source string, end_line int, lines_code int")
    got = {r.source: (r.lines_total, r.lines_code, r.chunks_count, r.risk_level) for r in loc.loc_by_file(rows).collect()}
    assert got == {"a.ts": (500, 450, 2, "CRITICAL"), "b.py": (210, 0, 1, "WARNING"), "c.py": (10, 3, 1, "OK")}
