"""Extraction from source text that no regular expression alone can do (C1-C8, C11, C14, C16). Pure functions of a text."""

from __future__ import annotations

import posixpath
import re
from functools import lru_cache

MAX_IMPORTS = 100
# fixed values: schema types that are no dependencies
PRISMA_TYPES = frozenset(["String", "Int", "Boolean", "DateTime", "Json", "Decimal", "Float", "Bytes", "Unsupported"])
# fixed values: words before a parenthesis and a block that name no method
NO_METHODS = frozenset("if for while switch catch function return typeof new await super constructor".split())

_NOISE = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:\[!&|?;{}\s])/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def blank_noise(text: str) -> str:
    """Comments, strings, templates and patterns as blanks of the same length; line ends stay."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def brace_balance(text: str) -> tuple[int, int]:
    """Opening and closing braces outside strings and comments."""
    bare = blank_noise(text)
    return bare.count("{"), bare.count("}")


_TS_IMPORT = re.compile(r"\s*(?:import\b[^;'\"]*?(?:from\s*)?|export\b[^;'\"]*?from\s*)['\"]([^'\"]+)['\"][^\n;]*;?|\s*import\s+\w+\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)\s*;?")
_TS_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|['\"]use \w+['\"];?)+")


def ts_imports(text: str) -> tuple[str, list[str]]:
    """The leading import block (comments between imports included, after them not) and the modules named in it."""
    at = end = 0
    modules: list[str] = []
    while len(modules) < MAX_IMPORTS:
        if m := _TS_SKIP.match(text, at):
            at = m.end()
        m = _TS_IMPORT.match(text, at)
        if not m or not m.group().lstrip().startswith("import"):
            break
        modules.append(m.group(1) or m.group(2))
        at = end = m.end()
    return text[:end], modules


def injected_types(text: str) -> list[str]:
    """Types of constructor parameters and of private readonly fields, sorted."""
    found = set(re.findall(r"private\s+readonly\s+\w+\s*:\s*([A-Z]\w*)", text))
    if m := re.search(r"\bconstructor\s*\(", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        found.update(re.findall(r":\s*([A-Z]\w*)", text[m.end() : at]))
    return sorted(found)


def ts_methods(body: str) -> list[tuple[str, int, int]]:
    """``(name, first line, last line)`` of the methods of a class, lines from 0 within ``body``."""
    bare = blank_noise(body)
    out: list[tuple[str, int, int]] = []
    depth = 0
    for m in re.finditer(r"[{}]|(?:(?<=\n)|(?<=^)|(?<=[;}]))[^\S\n]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^<>{}()]*>)?\s*\(", bare):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
        elif depth == 1 and m.group(1) not in NO_METHODS - {"constructor"}:
            open_at = _body_start(bare, m.end() - 1)
            if open_at is None:
                continue
            stop = _close(bare, open_at)
            first = bare.count("\n", 0, m.start() + len(m.group()) - len(m.group().lstrip()))
            out.append((m.group(1), first, bare.count("\n", 0, stop)))
    return [x for i, x in enumerate(out) if not any(y[1] < x[1] and x[2] < y[2] for y in out[:i])]


def _body_start(bare: str, paren: int) -> int | None:
    """The brace that opens a method's body after its parameter list; None for a signature."""
    depth, at = 0, paren
    while at < len(bare):
        c = bare[at]
        depth += {"(": 1, ")": -1}.get(c, 0)
        at += 1
        if not depth:
            break
    angle = 0
    while at < len(bare):
        c = bare[at]
        if c == "<":
            angle += 1
        elif c == ">":
            angle -= 1
        elif c == "{" and angle <= 0:
            return at
        elif c in ";}" or (c == "\n" and not bare[paren:at].rstrip().endswith((")", ":", "|", "&", ","))):
            return None
        at += 1
    return None


def _close(bare: str, at: int) -> int:
    """The brace that closes the one at ``at``; the end of the text where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(bare, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return len(bare) - 1


# fixed values: where a component may name classes, in the patterns of jsx_classes below
_TOKEN = re.compile(r"^[A-Za-z_][\w-]*$")
_LITERAL = re.compile(r"\"([^\"]*)\"|'([^']*)'")


def jsx_classes(text: str) -> list[str]:
    """Classes that a component names, sorted; prefixes of names built at run time come as ``[BEM]prefix``."""
    found: set[str] = set()

    def words(value: str) -> None:
        found.update(w for w in value.split() if _TOKEN.match(w))

    def literals(value: str) -> None:
        for m in _LITERAL.finditer(value):
            words(m.group(1) or m.group(2) or "")

    for m in re.finditer(r"(?:className|class)\s*=\s*(?:\"([^\"]+)\"|'([^']+)')", text):  # attributes
        value = m.group(1) or m.group(2)
        for hole in re.findall(r"\$\{([^}]+)\}", value):
            literals(hole)
        words(re.sub(r"\S*\$\{[^}]+\}\S*", " ", value))
    for m in re.finditer(r"(?:className|class)\s*=\s*\$?\{([^}]*)\}", text):  # expressions
        literals(m.group(1))
    for m in re.finditer(r"\b(?:cn|clsx|cva|twMerge|twJoin)\s*\(([^)]*)\)", text):  # helper calls
        literals(m.group(1))
    for m in re.finditer(r"([A-Za-z0-9_-]*[-_])\$\{", text):  # dynamic prefixes
        if m.group(1).strip("-_"):
            found.add("[BEM]" + m.group(1))
    for m in re.finditer(r"`([^`]*)`", text):  # literals within templates
        for hole in re.findall(r"\$\{([^}]+)\}", m.group(1)):
            literals(hole)
    for m in re.finditer(r"\b\w*[Cc]lass(?:[Nn]ame)?\s*:\s*(\"[^\"]+\"|'[^']+')", text):  # object properties
        literals(m.group(1))
    for m in re.finditer(r"(?:const|let|var)\s+\w*[Cc]lass(?:[Nn]ame)?\s*=\s*([^;\n]+)", text):  # variables
        literals(m.group(1))
    return sorted(found)


def py_imports(text: str) -> tuple[str, list[str]]:
    """The leading import block of a Python file and its statements, each whole."""
    out: list[str] = []
    end = at = 0
    m = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')?").match(text)
    at = m.end() if m else 0
    statement = re.compile(r"(?:\s|#[^\n]*\n)*((?:from\s+\S+\s+import\s+(?:\([^)]*\)|[^\n#]+)|import\s+[^\n#]+))[^\n]*\n?")
    while m := statement.match(text, at):
        out.append(re.sub(r"\s+", " ", m.group(1)).strip())
        at = end = m.end()
    return text[:end], out


def css_text_classes(selector: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<![\d.])\.([A-Za-z_][\w-]*)(?=[ \t\r\n.:,>+~\[]|$)", selector)))


@lru_cache(maxsize=256)
def css_rules(text: str) -> tuple[dict, ...]:
    """The rules of a style sheet: selector, classes, lines, properties in lower case (the last of a name holds), media query (C11).

    A rule within other at-rules has the nearest conditional one as its media query; nested rules come after their parent.
    """
    bare = re.sub(r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out: list[dict] = []
    stack: list[list] = []  # [prelude, line, declarations, is an at-rule]
    begin, line_at, line, i = 0, 1, 1, 0
    part = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|url\([^)]*\)|[{};]")

    def declare(piece: str) -> None:
        name, colon, value = piece.partition(":")
        if colon and stack and name.strip():
            stack[-1][2][name.strip().lower()] = value.strip()

    for m in part.finditer(bare):
        c = m.group()
        if c not in "{};":
            continue
        piece = bare[begin : m.start()]
        lead = len(piece) - len(piece.lstrip())
        line_at = bare.count("\n", 0, begin + lead) + 1
        begin = m.end()
        if c == "{":
            stack.append([piece.strip(), line_at, {}, piece.strip().startswith("@")])
        elif c == ";":
            declare(piece)
        else:
            declare(piece)
            if stack:
                prelude, first, declarations, at_rule = stack.pop()
                if not at_rule and prelude:
                    media = next((s[0] for s in reversed(stack) if s[3]), "")
                    out.append({"selector": prelude, "classes": css_text_classes(prelude), "start_line": first, "end_line": bare.count("\n", 0, m.start()) + 1, "properties": dict(declarations), "media_query": media})
    return tuple(sorted(out, key=lambda r: (r["start_line"], r["end_line"])))


def exact_code_lines(text: str, suffix: str) -> int:
    """Code lines of a whole file without comments, block comments and docstrings (C14)."""
    if suffix == ".py":
        text = re.sub(r"^[ \t]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[ \t]*$", lambda m: "\n" * m.group().count("\n"), text, flags=re.M)
        return sum(1 for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#"))
    if suffix in (".html", ".htm"):
        return sum(1 for x in re.sub(r"<!--[\s\S]*?-->", "", text).split("\n") if x.strip())
    bare = re.sub(r"/\*[\s\S]*?\*/", lambda m: "\n" * m.group().count("\n"), text)
    return sum(1 for x in bare.split("\n") if x.strip() and not x.lstrip().startswith("//"))


def prisma_dependencies(text: str, own: str) -> list[str]:
    """Capitalised words that are neither the block's own name nor a built-in type, sorted."""
    return sorted(set(re.findall(r"\b[A-Z]\w*", re.sub(r"//[^\n]*|\"[^\"\n]*\"", "", text))) - PRISMA_TYPES - {own})


def resolve_import(source: str, target: str) -> list[str]:
    """The files that an import may mean, in order (C22); none for packages."""
    folder = posixpath.dirname(source)
    if m := re.search(r"(?:from|import)\s+(\.+)([\w.]*)", target):
        for _ in range(len(m.group(1)) - 1):
            folder = posixpath.dirname(folder)
        base = posixpath.join(folder, m.group(2).replace(".", "/")).rstrip("/")
        return [base + ".py", base + "/__init__.py", base]
    if target.startswith("."):
        base = posixpath.normpath(posixpath.join(folder, target))
        return [base + e for e in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", "/index.js")]
    return []
