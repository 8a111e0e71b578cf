"""Cutting files into chunks along their syntax, with metadata.

One function per language takes lines and yields pieces; :func:`chunk_files` runs them over a table of files in Arrow
batches. Bodies are stored as they are in the file, so that line numbers always fit; imports are metadata.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedimark.config import DEFAULTS, Settings
from sedimark.functions import scripts
from sedimark.schema import CHUNKS


@dataclass
class Piece:
    start: int  # first line, from 0
    stop: int  # behind the last line
    type: str = ""
    class_name: str = ""
    method_name: str = ""
    dependencies: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)


def flat(start: int, stop: int, size: int, overlap: int, **kept) -> list[Piece]:
    """Windows of ``size`` lines that share ``overlap``."""
    out = []
    at = start
    while at < stop and (at == start or at < stop - overlap):
        out.append(Piece(at, min(at + size, stop), **kept))
        at += size - overlap
    return out


def _loose(taken: list[tuple[int, int]], lines: list[str], size: int, overlap: int) -> list[Piece]:
    """Windows over the runs of lines that no piece has, blank runs left out."""
    out, at = [], 0
    for a, b in [*sorted(taken), (len(lines), len(lines))]:
        if a > at and any(x.strip() for x in lines[at:a]):
            out += flat(at, a, size, overlap)
        at = max(at, b)
    return out


_TS_NODE = re.compile(r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|function\*?|enum|interface|type|const\s+enum)\s+([A-Za-z_$][\w$]*)")


def typescript(lines: list[str], s: Settings) -> list[Piece]:
    """Imports, classes (whole, or head and methods), functions, enums, interfaces and aliases; the rest in windows."""
    text = "".join(lines)
    bare = scripts.blank_noise(text)
    block, modules = scripts.ts_imports(text)
    local = [m for m in modules if m.startswith(".")]
    out: list[Piece] = []
    if block:
        out.append(Piece(0, block.count("\n") + (not block.endswith("\n")), "import"))
    starts, depth, at = [], 0, 0
    for m in _TS_NODE.finditer(bare):
        depth += bare.count("{", at, m.start()) - bare.count("}", at, m.start())
        at = m.start()
        if depth == 0:
            starts.append(m)
    for m in starts:
        first = bare.count("\n", 0, m.start())
        while first > 0 and re.match(r"\s*@\w", lines[first - 1]):
            first -= 1
        opening = bare.find("{", m.end())
        alias = m.group(1) == "type"
        end = re.compile(r";|\n(?=\S)").search(bare, m.end())
        if alias and (opening < 0 or (end and end.start() < opening)):
            stop = bare.count("\n", 0, end.start() if end else len(bare)) + 1
        elif opening < 0:
            continue
        else:
            stop = bare.count("\n", 0, scripts._close(bare, opening)) + 1
        if out and first < out[-1].stop:
            continue
        body = "".join(lines[first:stop])
        kind = m.group(1)
        if kind != "class":
            out.append(Piece(first, stop, kind.replace("*", "").replace("const enum", "enum"), m.group(2), dependencies=local))
            continue
        deps = sorted(set(scripts.injected_types(body)) | set(local))
        methods = scripts.ts_methods(body)
        if stop - first <= s.max_lines or not methods:
            out.append(Piece(first, stop, "class", m.group(2), ",".join(x[0] for x in methods), deps))
            continue
        plain = [x for x in methods if x[0] != "constructor"]
        head = min((x[1] for x in plain), default=stop - first)
        for x in methods:
            if x[0] == "constructor" and x[1] < head:
                head = max(head, x[2] + 1) if x[2] + 1 <= min((y[1] for y in plain), default=stop) else head
        out.append(Piece(first, first + max(head, 1), "class", m.group(2), "constructor" if len(plain) < len(methods) else "", deps))
        edge = first + max(head, 1)
        for name, a, b in sorted(plain, key=lambda x: x[1]):
            a, b = first + a, first + b + 1
            if a > edge:  # members between methods are kept with the method below
                a = edge
            out.append(Piece(a, b, "method", m.group(2), name, local))
            edge = max(edge, b)
        if any(x.strip() not in ("", "}", "};") for x in lines[edge:stop]):
            out += flat(edge, stop, s.max_lines, s.overlap, type="class", class_name=m.group(2))
    return sorted(out + _loose([(p.start, p.stop) for p in out], lines, s.max_lines, s.overlap), key=lambda p: (p.start, p.stop))


def python(lines: list[str], s: Settings) -> list[Piece]:
    """Classes (whole, or head and methods) and functions with their decorators; the rest in windows.

    Files that do not parse are cut at lines of no indentation that begin a class or a function.
    """
    text = "".join(lines)
    _, statements = scripts.py_imports(text)
    local = [x for x in statements if re.match(r"from\s+\.", x)]

    def words(a: int, b: int) -> list[str]:
        return sorted({w for w in re.findall(r"[A-Za-z_]\w{3,}", "".join(lines[a:b]))} | set(local))

    out: list[Piece] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        marks = [i for i, x in enumerate(lines) if re.match(r"(?:async\s+def|def|class)\s+\w", x)]
        for a, b in zip(marks, [*marks[1:], len(lines)]):
            name = re.match(r"(?:async\s+)?(def|class)\s+(\w+)", lines[a])
            out += flat(a, b, s.max_lines, s.overlap, type="class" if name.group(1) == "class" else "function", class_name=name.group(2), dependencies=words(a, b))
        return sorted(out + _loose([(p.start, p.stop) for p in out], lines, s.max_lines, s.overlap), key=lambda p: (p.start, p.stop))
    defs = (ast.FunctionDef, ast.AsyncFunctionDef)
    span = lambda n: (min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1, n.end_lineno)
    for node in tree.body:
        if isinstance(node, defs):
            a, b = span(node)
            out += [Piece(a, b, "function", node.name, "", words(a, b))]
        elif isinstance(node, ast.ClassDef):
            a, b = span(node)
            methods = [n for n in node.body if isinstance(n, defs)]
            if b - a <= s.max_lines or not methods:
                out.append(Piece(a, b, "class", node.name, ",".join(n.name for n in methods), words(a, b)))
                continue
            made = next((n for n in methods if n.name == "__init__"), None)
            rest = [n for n in methods if n is not made]
            head = span(rest[0])[0] if rest else b
            out.append(Piece(a, head, "class", node.name, "__init__" if made and made.end_lineno <= head else "", words(a, head)))
            edge = head
            for n in rest:
                x, y = span(n)
                out.append(Piece(min(edge, x), y, "method", node.name, n.name, words(x, y)))
                edge = y
            if any(x.strip() for x in lines[edge:b]):
                out += flat(edge, b, s.max_lines, s.overlap, type="class", class_name=node.name)
    return sorted(out + _loose([(p.start, p.stop) for p in out], lines, s.max_lines, s.overlap), key=lambda p: (p.start, p.stop))


_PRISMA_START = re.compile(r"^(model|enum|datasource|generator|type)\s+(\w+)\s*\{")


def prisma(lines: list[str], s: Settings) -> list[Piece]:
    """One piece per block; loose lines go with the block below, trailing ones are their own; an open block is kept."""
    out: list[Piece] = []
    begin, block = 0, None
    for i, line in enumerate(lines):
        if block is None:
            block = _PRISMA_START.match(line.strip())
            if block and "}" in line[line.index("{") :]:
                out.append(_schema_piece(lines, begin, i + 1, block))
                begin, block = i + 1, None
        elif line.rstrip().endswith("}"):
            out.append(_schema_piece(lines, begin, i + 1, block))
            begin, block = i + 1, None
    if block is not None:
        out.append(_schema_piece(lines, begin, len(lines), block))
    elif any(x.strip() for x in lines[begin:]):
        out.append(Piece(begin, len(lines)))
    return out


def _schema_piece(lines: list[str], a: int, b: int, block: re.Match) -> Piece:
    name = block.group(2)
    return Piece(a, b, block.group(1), name, "", scripts.prisma_dependencies("".join(lines[a:b]), name), [name] if block.group(1) in ("model", "enum") else [])


class _Tree(HTMLParser):
    """Elements with their lines, as nested lists ``[first, last, children]``."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # fixed values

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = [0, 0, []]
        self.stack = [("", self.root)]

    def handle_starttag(self, tag, attrs):
        node = [self.getpos()[0] - 1, self.getpos()[0] + self.get_starttag_text().count("\n"), []]
        self.stack[-1][1][2].append(node)
        if tag not in self.VOID:
            self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][1][2].append([self.getpos()[0] - 1, self.getpos()[0] + self.get_starttag_text().count("\n"), []])

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                for _, node in self.stack[i:]:
                    node[1] = max(node[1], self.getpos()[0])
                del self.stack[i:]
                break


def html(lines: list[str], s: Settings) -> list[Piece]:
    """Elements packed up to the limit; larger ones are entered."""
    tree = _Tree()
    tree.feed("".join(lines))
    for _, node in tree.stack[1:]:
        node[1] = len(lines)
    tree.root[1] = len(lines)
    cuts: list[tuple[int, int]] = []

    def enter(first: int, last: int, children: list) -> None:
        at = first
        for a, b, inner in children:
            a, b = max(a, at), min(b, last)
            if b - at > s.max_lines and a > at:
                cuts.append((at, a))
                at = a
            if b - a > s.max_lines and inner:
                if a > at:
                    cuts.append((at, a))
                enter(a, b, inner)
                at = max(at, b)
        if last > at:
            cuts.append((at, last))

    enter(0, len(lines), tree.root[2])
    out: list[Piece] = []
    for a, b in cuts:
        out += flat(a, b, s.max_lines, s.overlap, type="html") if b - a > s.max_lines else [Piece(a, b, "html")]
    return [p for p in out if any(x.strip() for x in lines[p.start : p.stop])]


_META_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9-]*)")
_META_CLASS = re.compile(r"(?:className|class|\[ngClass\]|:class)\s*=\s*(?:\"([^\">]+)\"|'([^'>]+)')")


def _html_meta(text: str) -> dict:
    tags = set(_META_TAG.findall(text))
    names = {w for m in _META_CLASS.finditer(text) for w in re.sub(r"\$?\{[^}]+\}", " ", m.group(1) or m.group(2)).split()}
    names |= set(re.findall(r"\[class\.([A-Za-z0-9_-]+)\]", text)) | set(re.findall(r"class:([A-Za-z0-9_-]+)", text))
    title = re.search(r"(?is)<title[^>]*>\s*(\S.*?)</title>", text)
    links = re.findall(r"(?i)<script[^>]*\bsrc\s*=\s*[\"']([^\"']+)", text) + re.findall(r"(?i)<link[^>]*\bhref\s*=\s*[\"']([^\"']+)", text)
    return {"tags": sorted(tags | {n for n in names if re.match(r"^[A-Za-z_][\w-]*$", n)}), "title": title.group(1).strip() if title else "", "dependencies": list(dict.fromkeys(links)), "directives": sorted(t for t in tags if "-" in t)}


def _css_meta(text: str) -> dict:
    bare = re.sub(r"url\([^)]+\)", "", re.sub(r"/\*[\s\S]*?\*/", "", text))
    return {"tags": sorted(set(scripts.css_text_classes(bare))), "dependencies": sorted(set(re.findall(r"--[A-Za-z0-9_-]+", bare))), "directives": sorted(set(re.findall(r"@[A-Za-z0-9_-]+(?:\s+[\w-]+)?", bare)))}


_CHUNKERS = {".ts": typescript, ".tsx": typescript, ".js": typescript, ".jsx": typescript, ".py": python, ".prisma": prisma, ".html": html, ".css": lambda lines, s: flat(0, len(lines), s.max_lines, s.overlap, type="css")}


def comment_only(text: str, suffix: str) -> bool:
    patterns = {".ts": r"/\*[\s\S]*?\*/|//[^\n]*", ".js": r"/\*[\s\S]*?\*/|//[^\n]*", ".prisma": r"//[^\n]*", ".html": r"<!--[\s\S]*?-->", ".css": r"/\*[\s\S]*?\*/"}
    return not re.sub(patterns[suffix], "", text).strip() if suffix in patterns else not text.strip()


def chunk_text(source: str, scope: str, text: str | None, s: Settings = DEFAULTS) -> list[dict]:
    """The chunks of one file as rows of the chunk table (B1). Null, blank and too large files give none, nor do files of
    fewer than 20 lines that hold only comments; files up to the limit are one chunk (B2)."""
    if text is None or not text.strip() or len(text.encode("utf-8", "surrogatepass")) > s.max_file_bytes:
        return []
    lines = text.splitlines(keepends=True) if "\n" not in text else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    suffix = ("." + source.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()) if "." in source.rsplit("/", 1)[-1] else ""
    if len(lines) < 20 and comment_only(text, suffix):
        return []
    whole = _CHUNKERS.get(suffix, lambda x, y: flat(0, len(x), y.max_lines, y.overlap))(lines, s)
    if len(lines) <= s.max_lines and suffix != ".prisma":
        named = [p for p in whole if p.class_name]
        whole = [Piece(0, len(lines), named[0].type if named else (whole[0].type if whole else ""), ",".join(dict.fromkeys(p.class_name for p in named)), ",".join(x for p in named for x in p.method_name.split(",") if x), sorted({d for p in named for d in p.dependencies}), [m for p in whole for m in p.models])]
    elif len(lines) <= s.max_lines:
        named = [p for p in whole if p.class_name]
        whole = [Piece(0, len(lines), named[0].type if named else "", ",".join(p.class_name for p in named), "", sorted({d for p in named for d in p.dependencies} - {p.class_name for p in named}), [m for p in named for m in p.models])]
    modules = scripts.py_imports(text)[1] if suffix == ".py" else scripts.ts_imports(text)[1] if suffix in (".ts", ".tsx", ".js", ".jsx") else []
    rules = [dict(r) for r in scripts.css_rules(text)] if suffix == ".css" else []
    out: dict[str, dict] = {}
    for p in whole:
        body = "".join(lines[p.start : p.stop])
        meta: dict = {}
        if suffix == ".html":
            meta = _html_meta(body)
        elif suffix == ".css":
            meta = _css_meta(body)
        elif suffix in (".tsx", ".jsx", ".js"):
            meta = {"tags": scripts.jsx_classes(body)}
        code = r"^\s*(/\*|\*|//)" if suffix == ".css" else r"^\s*(//|#|/\*|\*)"
        row = {
            "id": f"{source}#L{p.start + 1}-{p.stop}", "source": source, "scope": scope, "start_line": p.start + 1, "end_line": p.stop, "text": body,
            "class_name": p.class_name, "method_name": p.method_name, "imports": modules, "dependencies": meta.get("dependencies", p.dependencies),
            "tags": meta.get("tags", []), "title": meta.get("title", ""), "type": p.type, "models": p.models, "directives": meta.get("directives", []),
            "lines_code": sum(1 for x in body.split("\n") if x.strip() and not re.match(code, x)), "css_rules": rules,
        }
        out[row["id"]] = row  # of two pieces with one id the later stays
    return list(out.values())


def chunk_files(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The chunk table of files ``source, scope, content``. Row by row; large files are no group and need no shuffle."""
    schema = to_arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = [c.slice(at, 200).to_pylist() for c in batch.columns]
                rows = [r for source, scope, text in zip(*part) if source for r in chunk_text(source, scope or "", text, settings)]
                for r in rows:
                    r["css_rules"] = [{**x, "properties": list(x["properties"].items())} for x in r["css_rules"]]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    return files.select("source", "scope", F.col("content")).mapInArrow(run, CHUNKS)
