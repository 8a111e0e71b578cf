import pytest

from sedimark.llm.origin import bulk, declared, dense, evidence, judge_origin, parse_attributes, serial


def said(path, *files):
    return declared(path, [(folder, parse_attributes(text)) for folder, text in files])


def test_attribute_precedence():
    root = "*.js linguist-generated\n/lib/** linguist-vendored\nlib/own.js -linguist-vendored\n# note\n"
    assert said("a/b.js", ("", root)) == {"generated": True}
    assert said("lib/x/y.ts", ("", root)) == {"vendored": True}
    assert said("lib/own.js", ("", root)) == {"generated": True, "vendored": False}
    nearer = "*.js -linguist-generated\n"
    assert said("a/b.js", ("", root), ("a", nearer)) == {"generated": False}
    assert said("c/b.js", ("", root), ("a", nearer)) == {"generated": True}
    assert said("a/b.js", ("", "*.js linguist-generated\n*.js !linguist-generated\n")) == {}
    assert said("x/dist/a.css", ("", "dist/*.css linguist-generated=true")) == {}
    assert said("x/dist/a.css", ("", "**/dist/*.css linguist-generated=true")) == {"generated": True}
    assert said("q.css", ("", "[p-r].css linguist-generated=false")) == {"generated": False}


@pytest.mark.parametrize(
    "text,ext,kind",
    [
        ("// Code generated by tool 1.2. DO NOT EDIT.\nlet a = 1;\n", "ts", "generated"),
        ("let a = 1;\n\n/* AUTO-GENERATED FILE -- regenerate with make */\n", "ts", "generated"),
        ('export const BANNER = "Code generated by tool. DO NOT EDIT.";\n', "ts", ""),
        ("# Once generated with tool, maintained by hand since the rewrite.\nx = 1\n", "py", ""),
        ("// Not generated: the exporter reads this file.\n", "js", ""),
        ("/* Diese Datei wurde automatisch erzeugt (Stand 1.2) */\n", "css", "generated"),
        ("/*\n * Copyright 2019 contributors of foolib\n */\n", "js", "vendored"),
        ("// Licensed to the repo maintainers; internal use only.\n", "js", ""),
        ("# copied from foolib@1.2.3, upstream license: MIT\n", "py", "vendored"),
        ("", "ts", ""),
    ],
)
def test_notices(text, ext, kind):
    assert evidence(text, ext, "repo")[0] == kind


def test_shapes():
    assert dense("function a(b){return b*2}var c={d:!0,e:1};" * 30) and not dense("const a = 1;\nconst b = 2;\n" * 50)
    table = "export const t = [\n" + "  [1.5, -2, 'x'],\n" * 80 + "];\n"
    assert bulk(table, "ts") and not bulk(table + "export function f(a) { return a.map((x) => x + 1); }\n", "ts")
    assert bulk('T = "' + "QUJD" * 400 + '"\n', "py")
    assert serial("".join(f"export const op{i}X = (b) => request('/v1/{i}', b);\n" for i in range(12)))
    assert not serial("const a1 = 1;\nconst b7 = 2;\nconst c3 = f(b7);\n" * 3)


def test_mined_patterns_reach_undeclared_repositories(spark):
    rows = []
    for repo in ("one", "two", "six"):
        rows += [(f"{repo}/src/x/weird-libs/foolib/{i}.ts", 1, 1, f"// Copyright 2020 contributors of foolib\nlet a{i} = 1;\n") for i in range(3)]
        rows += [(f"{repo}/src/vendor/mod/{i}.ts", 1, 1, f"export class A{i} {{}}\n") for i in range(8)]
    rows += [("two/src/y/weird-libs/foolib/plain.ts", 1, 1, "export class P {}\n"), ("two/src/y/node_modules/q/plain.ts", 1, 1, "export class Q {}\n")]
    rows += [("decl/.gitattributes", 1, 1, "gen/** linguist-generated\nweird-libs/** -linguist-vendored\n"), ("decl/gen/a.ts", 1, 1, "let a;\n"), ("decl/weird-libs/b.ts", 1, 1, "let b;\n")]
    rows += [("two/src/y/null.ts", 1, 1, None), (None, 1, 1, "x"), ("two/src/y/z.min.js", 1, 1, "let q = 1;\n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "source string, start_line int, end_line int, text string, kind string")
    got = {r.source: (r.kind, r.why) for r in judge_origin(df).collect()}
    assert got["two/src/y/weird-libs/foolib/plain.ts"][0] == "vendored"
    assert got["two/src/y/node_modules/q/plain.ts"] == ("vendored", "dir:node_modules")
    assert got["decl/gen/a.ts"] == ("generated", "declared") and got["decl/weird-libs/b.ts"] == (None, "declared")
    assert got["one/src/vendor/mod/1.ts"] == (None, None) and got["two/src/y/null.ts"] == (None, None)
    assert got["two/src/y/z.min.js"][0] == "minified" and "decl/.gitattributes" not in got
    assert judge_origin(df.limit(0)).count() == 0


def test_attribute_files_by_folder(spark):
    rows = [("one/.gitattributes", "* text=auto\n"), ("one/src/y/node_modules/q/plain.ts", "export class Q {}\n")]
    rows += [("two/.gitattributes", "gen/** linguist-generated\n*.lock linguist-generated=true\n"), ("two/gen/.gitattributes", "keep.ts -linguist-generated\nown.ts !linguist-generated\n")]
    rows += [("two/gen/a.ts", "let a;\n"), ("two/gen/keep.ts", "let k;\n"), ("two/gen/own.ts", "let o;\n"), ("two/deep/x/y.lock", "z"), ("two/src/node_modules/q/p.ts", "let p;\n"), ("gen/top.ts", "let t;\n")]
    df = spark.createDataFrame([(s, 1, 1, t) for s, t in rows], "source string, start_line int, end_line int, text string")
    got = {r.source: (r.kind, r.why) for r in judge_origin(df).collect()}
    assert got["one/src/y/node_modules/q/plain.ts"] == ("vendored", "dir:node_modules")  # text=auto declares nothing of the kind
    assert got["two/gen/a.ts"] == ("generated", "declared") and got["two/deep/x/y.lock"] == ("generated", "declared")
    assert got["two/gen/keep.ts"] == (None, "declared") and got["two/gen/own.ts"] == (None, None)
    assert got["two/src/node_modules/q/p.ts"] == (None, None) and got["gen/top.ts"] == (None, None)
