"""Queries of the operators that need source files or style sheets of known contents, each with its expected rows.

The inputs are small files written here; the SQL states the rows that must come out.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.config import Settings
from sedimark.functions import code, scripts
from sedimark.operators import audit as layout
from sedimark.operators import chunkers, search, styles
from sedimark.operators import edges as relations
from sedimark.plans.registry import Registry
from sedimark.session import shared_folder
from sedimark.sources import files as sources

registry = Registry()


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that gives ``rows``; ``columns`` are names and DuckDB types."""

    def literal(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    named = [c.strip().split(" ", 1) for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows)
    return f"select {', '.join(f'{n}::{t} as {n}' for n, t in named)} from (values {body}) as t({', '.join(n for n, _ in named)})"


SMALL = Settings(max_lines=8, overlap=2)

TICKETS = """import { Ledger } from './ledger';
import axios from "axios";

@Injectable()
export class TicketService {
  constructor(private readonly ledger: Ledger, private clock: Clock) {}

  open(id: string) {
    return this.ledger.find(id); // "}" in a comment
  }

  async close(id: string): Promise<void> {
    if (id) {
      await this.ledger.remove(`}${id}`);
    }
  }
}

export enum Mood {
  Calm,
  Busy,
}

export type Pair = { a: string };

const tail = 1;
"""
PANEL = """import React from 'react';
export function Panel({ wide }) {
  const boxClass = wide ? 'wide box' : 'box';
  return <div className="panel head" data-x={`tone-${wide}`}><b className={clsx('mark', wide && 'on')} /></div>;
}
"""
STORE = '''"""Doc."""
import os
from . import keys
from ..core import (
    a,
    b,
)


@cached
class Store:
    """Holds."""

    def __init__(self):
        self.rows = []

    def load(self, path):
        return os.open(path)

    def drop(self):
        # gone
        self.rows = []


def main():
    return Store()
'''
BROKEN = "x = 1\ndef one(:\n    pass\nclass Two(\n    pass\n"
SCHEMA = """datasource db {
  url = env("URL")
}

// tickets
model Ticket {
  id    Int    @id
  state State
  owner Person
}

enum State { OPEN CLOSED }
"""
PAGE = "<html>\n<head><title> Desk </title><script src=\"a.js\"></script></head>\n<body>\n<app-desk [class.busy]=\"on\" class=\"desk {{x}} wide\">\n" + "<p>t</p>\n" * 12 + "</app-desk>\n</body>\n</html>\n"
SHEET = "/* c */\n:root { --gap: 4px; }\n.desk { color: red; width: 500px }\n@media (max-width: 600px) {\n  .desk .busy:hover { Width: 700px; display: flex }\n}\n"
FILES = [
    ("app/src/ticket.service.ts", TICKETS), ("app/src/panel.tsx", PANEL), ("app/store.py", STORE), ("app/broken.py", BROKEN), ("app/schema.prisma", SCHEMA), ("app/page.html", PAGE), ("app/desk.css", SHEET),
    ("app/notes.js", "".join(f"// line {i}\n" for i in range(20))), ("app/only.ts", "// nothing\n/* here */\n"), ("app/blank.ts", " \n\n"), ("app/null.ts", None),
]


def _chunked(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(s, "app", t) for s, t in FILES], "source string, scope string, content string")
    return chunkers.chunk_files(rows, SMALL)


@registry.query(values("source varchar, start_line int, end_line int, type varchar, class_name varchar, method_name varchar", [
        ("app/src/ticket.service.ts", 1, 2, "import", "", ""),
        ("app/src/ticket.service.ts", 4, 7, "class", "TicketService", "constructor"),
        ("app/src/ticket.service.ts", 8, 10, "method", "TicketService", "open"),
        ("app/src/ticket.service.ts", 11, 16, "method", "TicketService", "close"),
        ("app/src/ticket.service.ts", 17, 18, "", "", ""),
        ("app/src/ticket.service.ts", 19, 22, "enum", "Mood", ""),
        ("app/src/ticket.service.ts", 24, 24, "type", "Pair", ""),
        ("app/src/ticket.service.ts", 25, 26, "", "", ""),
        ("app/src/panel.tsx", 1, 5, "function", "Panel", ""),
        ("app/store.py", 1, 8, "", "", ""),
        ("app/store.py", 7, 9, "", "", ""),
        ("app/store.py", 10, 16, "class", "Store", "__init__"),
        ("app/store.py", 17, 18, "method", "Store", "load"),
        ("app/store.py", 19, 22, "method", "Store", "drop"),
        ("app/store.py", 25, 26, "function", "main", ""),
        ("app/broken.py", 1, 5, "function", "one,Two", ""),
        ("app/schema.prisma", 1, 3, "datasource", "db", ""),
        ("app/schema.prisma", 4, 10, "model", "Ticket", ""),
        ("app/schema.prisma", 11, 12, "enum", "State", ""),
        ("app/page.html", 1, 2, "html", "", ""),
        ("app/page.html", 3, 3, "html", "", ""),
        ("app/page.html", 4, 11, "html", "", ""),
        ("app/page.html", 12, 17, "html", "", ""),
        ("app/page.html", 18, 18, "html", "", ""),
        ("app/page.html", 19, 19, "html", "", ""),
        ("app/desk.css", 1, 6, "css", "", ""),
        ("app/notes.js", 1, 8, "", "", ""),
        ("app/notes.js", 7, 14, "", "", ""),
        ("app/notes.js", 13, 20, "", "", ""),
    ]))
def chunk_pieces(spark, d):
    """Files of every language cut along their syntax."""
    return _chunked(spark).select("source", "start_line", "end_line", "type", "class_name", "method_name")


@registry.query(values("id varchar, imports varchar, dependencies varchar, tags varchar, models varchar, directives varchar, title varchar, lines_code int", [
        ("app/src/ticket.service.ts#L1-2", "./ledger|axios", "", "", "", "", "", 2),
        ("app/src/ticket.service.ts#L4-7", "./ledger|axios", "./ledger|Clock|Ledger", "", "", "", "", 3),
        ("app/src/ticket.service.ts#L8-10", "./ledger|axios", "./ledger", "", "", "", "", 3),
        ("app/src/ticket.service.ts#L11-16", "./ledger|axios", "./ledger", "", "", "", "", 5),
        ("app/src/ticket.service.ts#L17-18", "./ledger|axios", "", "", "", "", "", 1),
        ("app/src/ticket.service.ts#L19-22", "./ledger|axios", "./ledger", "", "", "", "", 4),
        ("app/src/ticket.service.ts#L24-24", "./ledger|axios", "./ledger", "", "", "", "", 1),
        ("app/src/ticket.service.ts#L25-26", "./ledger|axios", "", "", "", "", "", 1),
        ("app/src/panel.tsx#L1-5", "react", "", "[BEM]tone-|box|head|mark|on|panel|wide", "", "", "", 5),
        ("app/store.py#L1-8", "import os|from . import keys|from ..core import ( a, b, )", "", "", "", "", "", 7),
        ("app/store.py#L7-9", "import os|from . import keys|from ..core import ( a, b, )", "", "", "", "", "", 1),
        ("app/store.py#L10-16", "import os|from . import keys|from ..core import ( a, b, )", "Holds|Store|__init__|cached|class|from . import keys|from ..core import ( a, b, )|rows|self", "", "", "", "", 5),
        ("app/store.py#L17-18", "import os|from . import keys|from ..core import ( a, b, )", "from . import keys|from ..core import ( a, b, )|load|open|path|return|self", "", "", "", "", 2),
        ("app/store.py#L19-22", "import os|from . import keys|from ..core import ( a, b, )", "drop|from . import keys|from ..core import ( a, b, )|gone|rows|self", "", "", "", "", 2),
        ("app/store.py#L25-26", "import os|from . import keys|from ..core import ( a, b, )", "Store|from . import keys|from ..core import ( a, b, )|main|return", "", "", "", "", 2),
        ("app/broken.py#L1-5", "", "class|pass", "", "", "", "", 5),
        ("app/schema.prisma#L1-3", "", "", "", "", "", "", 3),
        ("app/schema.prisma#L4-10", "", "Person|State", "", "Ticket", "", "", 5),
        ("app/schema.prisma#L11-12", "", "CLOSED|OPEN", "", "State", "", "", 1),
        ("app/page.html#L1-2", "", "a.js", "head|html|script|title", "", "", "Desk", 2),
        ("app/page.html#L3-3", "", "", "body", "", "", "", 1),
        ("app/page.html#L4-11", "", "", "app-desk|busy|desk|p|wide", "", "app-desk", "", 8),
        ("app/page.html#L12-17", "", "", "p", "", "", "", 6),
        ("app/page.html#L18-18", "", "", "", "", "", "", 1),
        ("app/page.html#L19-19", "", "", "", "", "", "", 1),
        ("app/desk.css#L1-6", "", "--gap", "busy|desk", "", "@media", "", 5),
        ("app/notes.js#L1-8", "", "", "", "", "", "", 0),
        ("app/notes.js#L7-14", "", "", "", "", "", "", 0),
        ("app/notes.js#L13-20", "", "", "", "", "", "", 0),
    ]))
def chunk_fields(spark, d):
    """The metadata of the pieces."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _chunked(spark).select("id", joined("imports"), joined("dependencies"), joined("tags"), joined("models"), joined("directives"), "title", "lines_code")


@registry.query(values("selector varchar, classes varchar, start_line int, end_line int, properties varchar, media_query varchar", [
        (":root", "", 2, 2, "--gap=4px", ""),
        (".desk", "desk", 3, 3, "color=red; width=500px", ""),
        (".desk .busy:hover", "desk busy", 5, 5, "display=flex; width=700px", "@media (max-width: 600px)"),
    ]))
def chunk_css_rules(spark, d):
    """The rules that style sheets are parsed into (C11)."""
    rules = _chunked(spark).where("source = 'app/desk.css'").select(F.explode("css_rules").alias("r")).select("r.*")
    properties = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return rules.select("selector", F.array_join("classes", " ").alias("classes"), "start_line", "end_line", properties.alias("properties"), "media_query")


def _tiny(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@registry.query(values("source varchar, opening int, closing int, code_lines int", [("app/src/ticket.service.ts", 8, 8, 20), ("app/src/panel.tsx", 4, 4, 5), ("app/store.py", 0, 0, 16), ("app/page.html", 0, 0, 19), ("app/desk.css", 4, 4, 5)]))
def script_measures(spark, d):
    """Braces outside strings and comments, and exact code lines of whole files."""
    rows = _tiny(spark, [(s, t) for s, t in FILES if s in ("app/src/ticket.service.ts", "app/src/panel.tsx", "app/store.py", "app/page.html", "app/desk.css")], "source string, text string")

    def run(batches):
        for pdf in batches:
            pdf["opening"], pdf["closing"] = zip(*(scripts.brace_balance(t) for t in pdf["text"]))
            pdf["code_lines"] = [scripts.exact_code_lines(t, "." + s.rsplit(".", 1)[-1]) for s, t in zip(pdf["source"], pdf["text"])]
            yield pdf[["source", "opening", "closing", "code_lines"]]

    return rows.mapInPandas(run, "source string, opening int, closing int, code_lines int")


@registry.query(values("value varchar, px double", [("12px", 12), (" 1.5rem ", 24), ("2em", 32), (".5px", 0.5), ("10%", None), ("auto", None), ("1.2.3px", None), ("", None), (None, None)]))
def css_lengths(spark, d):
    """Lengths in pixels."""
    rows = _tiny(spark, [(x,) for x in ("12px", " 1.5rem ", "2em", ".5px", "10%", "auto", "1.2.3px", "", None)], "value string")
    return rows.select("value", code.length_px(F.col("value")).alias("px"))


@registry.query(values("name varchar, icon boolean", [("fa", True), ("FAS", True), ("fa-user", True), ("bi-x", True), ("icon-close", True), ("material-icons", True), ("fab", True), ("farm", False), ("panel", False), ("", False)]))
def icon_classes(spark, d):
    """Classes of icon libraries."""
    rows = _tiny(spark, [(x,) for x in ("fa", "FAS", "fa-user", "bi-x", "icon-close", "material-icons", "fab", "farm", "panel", "")], "name string")
    return rows.select("name", code.is_vendor_icon(F.col("name")).alias("icon"))


# -- layout audit (P1-P7) and style tracing ------------------------------------------------------------------------------

_RULE = "css_file string, selector string, classes array<string>, start_line int, end_line int, properties map<string,string>, media_query string"
_SHEET = [
    ("a.css", ".chat-row", ["chat-row"], 1, 3, {"display": "flex"}, ""),  # P1 and P2
    ("a.css", ".msg-wrapper", ["msg-wrapper"], 4, 6, {"display": "flex", "min-width": "0", "flex-wrap": "wrap"}, ""),
    ("a.css", ".card-list", ["card-list"], 7, 9, {"display": "flex", "flex-wrap": "wrap"}, ""),  # P1, held by its parent
    ("a.css", ".tabs", ["tabs"], 10, 12, {"display": "flex", "overflow-x": "auto"}, ""),
    ("a.css", ".nav:hover", ["nav"], 13, 15, {"display": "flex"}, ""),  # pseudo: no P2
    ("b.css", ".scroll-area", ["scroll-area"], 1, 2, {"overflow": "auto"}, ""),
    ("b.css", ".scroll-area .feed", ["scroll-area", "feed"], 3, 4, {"display": "grid"}, ""),  # P1, held by its file
    ("b.css", ".side", ["side"], 5, 6, {"width": "700px", "max-width": "100%"}, "@media (max-width: 600px)"),  # P3
    ("b.css", ".cols", ["cols"], 7, 8, {"grid-template-columns": "20rem 300px 320px"}, "@media (max-width: 38rem)"),  # P3
    ("b.css", ".narrow", ["narrow"], 9, 10, {"width": "100px"}, "@media (max-width: 600px)"),
    ("c.css", ".summary", ["summary"], 1, 2, {"color": "red"}, ""),  # P4
    ("c.css", ".summary-ok", ["summary-ok"], 3, 4, {"overflow-wrap": "anywhere"}, ""),
    ("c.css", ".wide", ["wide"], 5, 6, {"width": "450.5px"}, ""),  # P5
    ("c.css", ".modal", ["modal"], 7, 8, {"z-index": "9999"}, ""),  # P6
    ("c.css", ".layer", ["layer"], 9, 10, {"z-index": "100", "position": "fixed"}, ""),
    ("c.css", "*", [], 11, 12, {"display": "flex", "z-index": "999"}, ""),  # a reset
]
_MARKUP = [("app/x.html", '<div class="scroll-area"><section class="outer"><ul class="card-list"></ul></section></div>\n<p class="summary">x</p>')]


def _audited(spark: SparkSession, **wanted) -> DataFrame:
    parents = layout.ancestors(_tiny(spark, _MARKUP, "source string, content string"))
    return layout.audit(_tiny(spark, _SHEET, _RULE), parents, **wanted)


_FLEX, _WRAP, _BREAK, _TEXT, _WIDTH, _Z = "Flexbox/Grid Overflow Risk", "Flex Wrap Overflow Risk", "Breakpoint Width Overflow", "Text Break Risk", "Fixed Width Responsive Risk", "Z-Index Stacking Conflict"
_ISSUES = [
    ("CRITICAL", "a.css", 1, 3, ".chat-row", _FLEX), ("WARNING", "a.css", 1, 3, ".chat-row", _WRAP), ("WARNING", "a.css", 4, 6, ".msg-wrapper", _TEXT), ("INFO", "a.css", 7, 9, ".card-list", _FLEX), ("INFO", "b.css", 3, 4, ".scroll-area .feed", _FLEX),
    ("WARNING", "b.css", 5, 6, ".side", _BREAK), ("WARNING", "b.css", 7, 8, ".cols", _BREAK), ("WARNING", "c.css", 1, 2, ".summary", _TEXT), ("WARNING", "c.css", 5, 6, ".wide", _WIDTH), ("INFO", "c.css", 7, 8, ".modal", _Z),
]
_ISSUE = "severity varchar, file varchar, start_line int, end_line int, selector varchar, category varchar"


@registry.query(values(_ISSUE, _ISSUES))
def audit_fixture(spark, d):
    """All six layout checks, with what a parent or the file holds."""
    return _audited(spark).select("severity", "file", "start_line", "end_line", "selector", "category")


@registry.query(values(_ISSUE, [i for i in _ISSUES if i[0] == "WARNING" and i[1] in ("a.css", "b.css")]))
def audit_filtered(spark, d):
    """Issues of one severity in some files."""
    return _audited(spark, severity="warning", files=" A.css, b").select("severity", "file", "start_line", "end_line", "selector", "category")


@registry.query(values("category varchar, severity varchar, issues bigint", sorted({(c, s, sum(1 for i in _ISSUES if (i[5], i[0]) == (c, s))) for s, _, _, _, _, c in _ISSUES})))
def audit_fixture_counts(spark, d):
    """Issues per category and severity."""
    return _audited(spark).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("issues"))


@registry.query(values("child varchar, parent varchar", [("outer", "scroll-area"), ("card-list", "outer"), ("card-list", "scroll-area"), ("summary", "scroll-area"), ("summary", "outer"), ("summary", "card-list")]))
def audit_ancestors(spark, d):
    """Classes and those of the class attributes before them in a file."""
    return layout.ancestors(_tiny(spark, _MARKUP, "source string, content string"))


_USED = [("r/card.tsx", "card", False), ("r/card.tsx", "active", False), ("r/card.tsx", "fa-user", False), ("r/card.tsx", "tone-", True), ("r/lone.tsx", "active", False), ("r/lone.tsx", "bare", False), ("q/other.html", "card", False)]
_TRACED = [
    ("r/s.css", ".card", ["card"], 1, 2, {"gap": "4px", "color": "red"}, ""), ("r/s.css", ".card.active", ["card", "active"], 3, 4, {"color": "blue"}, ""), ("r/s.css", ".menu.active", ["menu", "active"], 5, 6, {"color": "navy"}, ""),
    ("q/t.css", ".card > p", ["card"], 1, 9, {"margin": "0"}, "@media print"),
]
_TRACE = "component varchar, cls varchar, css_file varchar, selector varchar, start_line int, end_line int, media_query varchar"


def _traced(spark: SparkSession, **wanted) -> DataFrame:
    return styles.component_trace(_tiny(spark, _USED, "source string, cls string, dynamic boolean"), _tiny(spark, _TRACED, _RULE), **wanted)


@registry.query(
    values(_TRACE, [
        ("r/card.tsx", "card", "r/s.css", ".card", 1, 2, ""), ("r/card.tsx", "card", "r/s.css", ".card.active", 3, 4, ""), ("r/card.tsx", "active", "r/s.css", ".card.active", 3, 4, ""),
        ("r/lone.tsx", "active", None, None, None, None, None), ("r/lone.tsx", "bare", None, None, None, None, None), ("q/other.html", "card", "q/t.css", ".card > p", 1, 9, "@media print"),
    ])
)
def trace_fixture(spark, d):
    """Rules of each component's classes; a state class needs another class in common."""
    return _traced(spark, within_repository=True)


@registry.query(values(_TRACE, [("r/card.tsx", "card", "r/s.css", ".card", 1, 2, "")]))
def trace_filtered(spark, d):
    """The same for one component, class and property, whatever their case."""
    return _traced(spark, component="CARD", cls="Car", prop="GAP", within_repository=True)


@registry.query(values("css_file varchar, selector varchar, start_line int, matching varchar", [("r/s.css", ".card", 1, '{"color":"red"}'), ("r/s.css", ".card.active", 3, '{"color":"blue"}'), ("r/s.css", ".menu.active", 5, '{"color":"navy"}')]))
def property_fixture(spark, d):
    """Rules that mention a property or value."""
    return styles.property_matches(_tiny(spark, _TRACED, _RULE), "COLOR").select("css_file", "selector", "start_line", "matching")


@registry.query(values("css_file varchar, cls varchar", [("a.css", "unused"), ("b.css", "ton")]))
def dead_fixture(spark, d):
    """Declared classes that nothing names, by name or by a prefix built at run time; icons aside."""
    declared = _tiny(spark, [("card", "a.css"), ("unused", "a.css"), ("tone-red", "b.css"), ("ton", "b.css"), ("fa-x", "b.css"), ("active", "b.css")], "cls string, css_file string")
    return styles.dead_classes(declared, _tiny(spark, _USED, "source string, cls string, dynamic boolean"))


# -- repositories --------------------------------------------------------------------------------------------------------

_REPOSITORY = {
    "backend/nest-cli.json": "{}", "frontend/angular.json": "{}", ".gitignore": "*.skip.ts\n!kept.skip.ts\n# note\n/frontend/out-dir/\n",
    "backend/src/store.service.ts": TICKETS, "backend/src/ledger.ts": "export class Ledger {\n  find() { return 1; }\n}\n", "backend/node_modules/x.ts": "x", "backend/a.skip.ts": "x", "backend/notes.md": "x",
    "frontend/src/app.css": SHEET, "frontend/out-dir/y.ts": "y", "frontend/src/page.html": PAGE, "loose.ts": "const loose = 1;\n",
}


def _repository(spark: SparkSession) -> str:
    """The files in a folder under the shared one. Scanning lists names on the driver, so it is a folder of this machine."""
    root = f"{shared_folder(spark).removeprefix('file:')}/repository-{uuid.uuid4().hex}"
    for name, text in _REPOSITORY.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as file:
            file.write(text)
    return root


_SCANNED = [("backend/src/ledger.ts", "nestjs"), ("backend/src/store.service.ts", "nestjs"), ("frontend/src/app.css", "angular"), ("frontend/src/page.html", "angular")]


@registry.query("select rel_path, scope, sha256(content) as sha256, octet_length(encode(content))::bigint as size from (" + values("rel_path varchar, scope varchar, content varchar", [(p, s, _REPOSITORY[p]) for p, s in _SCANNED]) + ")")
def scan_repository(spark, d):
    """A repository as a table: ignored names, extensions, roots, scopes, hashes."""
    from sedimark.streaming.ingest import scan

    return scan(spark, _repository(spark)).select("rel_path", "scope", "sha256", "size")


@registry.query(values("path varchar, ignored boolean", [("a/b.skip.ts", True), ("src/gen/x.ts", True), ("deep/src/gen/x.ts", True), ("gen/x.ts", False), ("kept.ts", False)]))
def ignored_paths(spark, d):
    """Paths against the patterns of an ignore file (A2, A3)."""
    patterns = sources.ignore_patterns("# c\n\n*.skip.ts\n!kept.ts\nsrc/gen\n")
    return _tiny(spark, [(p, sources.is_ignored(p, patterns)) for p in ("a/b.skip.ts", "src/gen/x.ts", "deep/src/gen/x.ts", "gen/x.ts", "kept.ts")], "path string, ignored boolean")


_STEPS = [("first", 4, 4, 0, 0, 0), ("again", 4, 0, 0, 0, 4), ("changed", 4, 1, 1, 1, 2), ("forced", 4, 4, 0, 0, 0)]


@registry.query(values("step varchar, processed bigint, new_files bigint, modified bigint, deleted bigint, unchanged bigint", _STEPS))
def ingest_counts(spark, d):
    """What each run over a repository finds: all, nothing, one file of each kind, all when it is forced."""
    return _cycle(spark)[0]


@registry.query(
    "select source, count(*) as chunks, bool_and(n_terms > 0) as terms, true as vectors from (" + values("source varchar, n_terms int", [("backend/src/ledger.ts", 1), ("backend/src/new.ts", 1), ("frontend/src/app.css", 1), ("frontend/src/page.html", 1)]) + ") group by source"
)
def ingest_chunks(spark, d):
    """The chunks that a repository's index holds after a file of each kind, with vectors and terms."""
    chunks = _cycle(spark)[1].chunks.read()
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.bool_and(F.col("n_terms") > 0).alias("terms"), F.bool_and(F.size("vector") == 16).alias("vectors"))


@registry.query(values("source_file varchar, target_symbol varchar, relationship_type varchar", [("backend/src/new.ts", "./ledger", "import"), ("frontend/src/app.css", "--gap", "depends_on"), ("frontend/src/page.html", "a.js", "depends_on")]))
def ingest_edges(spark, d):
    """The edges of the index after the same."""
    return _cycle(spark)[1].edges.read().select("source_file", "target_symbol", "relationship_type")


_CYCLES: dict[str, tuple] = {}


def _cycle(spark: SparkSession) -> tuple:
    """The counts of some runs over a repository that changes in between, and its index; once per application."""
    name = spark.sparkContext.applicationId
    if name not in _CYCLES:
        _CYCLES[name] = _ingested(spark)
    return _CYCLES[name]


def _ingested(spark: SparkSession) -> tuple:
    from sedimark.streaming.ingest import Index, ingest

    root = _repository(spark)
    index = Index(spark, f"{root}-index", Settings(dimensions=16))
    counts = [("first", ingest(spark, root, index)), ("again", ingest(spark, root, index))]
    os.unlink(f"{root}/backend/src/store.service.ts")
    for name, text in {"backend/src/new.ts": "import { L } from './ledger';\nexport const n = 1;\n", "backend/src/ledger.ts": "export class Ledger2 {}\n"}.items():
        with open(f"{root}/{name}", "w", encoding="utf-8") as file:
            file.write(text)
    counts += [("changed", ingest(spark, root, index)), ("forced", ingest(spark, root, index, force=True))]
    rows = [(step, *(c[k] for k in ("processed", "new", "modified", "deleted", "unchanged"))) for step, c in counts]
    return _tiny(spark, rows, "step string, processed long, new_files long, modified long, deleted long, unchanged long"), index


# -- answers -------------------------------------------------------------------------------------------------------------


@registry.query(values("file varchar, rank int, branch int, target varchar", [("r/b.ts", 1, 0, "./b"), ("r/c.service.ts", 1, 1, "CService"), ("r/z.prisma", 2, 2, "State"), ("r/d/index.ts", 3, 0, "./d")]))
def enrich_fixture(spark, d):
    """Files one hop from the hits by import, class or model, each once at its first mention, within the quota."""
    chunks = [("r/a.ts", "A"), ("r/b.ts", "B"), ("r/c.service.ts", "CService"), ("r/m.prisma", "Ticket"), ("r/z.prisma", "State, Mood"), ("r/d/index.ts", "D"), ("r/e.ts", "E")]
    edges = [
        ("r/a.ts", " './b' ", "import"), ("r/a.ts", "axios", "import"), ("r/a.ts", "CService", "depends_on"), ("r/a.ts", "B", "depends_on"), ("r/m.prisma", "State", "depends_on"), ("r/m.prisma", "String", "depends_on"),
        ("r/x.ts", "./d", "import"), ("r/x.ts", "../r/b", "import"), ("r/x.ts", "E", "depends_on"),
    ]
    hits = _tiny(spark, [("r/a.ts", 1), ("r/m.prisma", 2), ("r/x.ts", 3)], "source string, rank int")
    return relations.enrich(hits, _tiny(spark, edges, "source_file string, target_symbol string, relationship_type string"), _tiny(spark, chunks, "source string, class_name string"), 4).select("file", "rank", "branch", "target")


@registry.query(values("source_file varchar, target_symbol varchar, relationship_type varchar", [("a.ts", "./x", "import"), ("b.ts", "./y", "import"), ("b.ts", "Svc", "depends_on")]))
def edges_fallback(spark, d):
    """The edge table, and for files without edges those of their packed fields."""
    edges = _tiny(spark, [("1", "a.ts", "./x", "import")], "id string, source_file string, target_symbol string, relationship_type string")
    chunks = _tiny(spark, [("a.ts", "./old", ""), ("b.ts", "['./y']", "Svc")], "source string, imports string, dependencies string")
    return relations.edges_or_fields(edges, chunks).select("source_file", "target_symbol", "relationship_type")


@registry.query(
    values("block varchar", [
        ('<file path="a&amp;b.ts" start_line="3" end_line="5" compressed="true">\nlet x = &quot;&lt;b&gt;&quot;;\n</file>',), ('<imported_file path="i.ts" relation_type="import">\nabcde\n</imported_file>',),
        ('<imported_file path="c.ts" dependency_class="Svc" relation_type="dependency">\nxy\n</imported_file>',), ('<related_model name="Ticket" source_file="m.prisma">\nmodel\n</related_model>',),
    ])
)
def context_blocks(spark, d):
    """Blocks of hits and of related files as a prompt carries them (K1, K2)."""
    from sedimark import render

    own = _tiny(spark, [("a&b.ts", 3, 5, '// gone\nlet x = "<b>";  ')], "source string, start_line int, end_line int, content string")
    more = _tiny(spark, [("i.ts", 0, "./i", "abcdefgh"), ("c.ts", 1, "Svc", "xy"), ("m.prisma", 2, "Ticket", "model")], "file string, branch int, target string, content string")
    return render.file_blocks(own).select("block").unionByName(render.related_blocks(more, 5).select("block"))


@registry.query(values("query varchar, outcome varchar", [(" a\tb\x07 ", "a\tb"), ("   ", "refused"), ("\x00", "refused"), ("x" * 2000, "x" * 2000), ("x" * 2001, "refused")]))
def sanitized_queries(spark, d):
    """Queries without control characters; empty and too long ones are refused."""
    out = []
    for q in (" a\tb\x07 ", "   ", "\x00", "x" * 2000, "x" * 2001):
        try:
            out.append((q, search.sanitize_query(q)))
        except search.InvalidQuery:
            out.append((q, "refused"))
    return _tiny(spark, out, "query string, outcome string")
