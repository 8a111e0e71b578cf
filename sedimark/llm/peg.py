"""Parsing expression grammars, compiled to Python functions with packrat memos.

Notation: one rule a line, ``Name <- expression``; ``'x'`` is the token of that spelling, a name in capitals a token
class, ``/`` ordered choice, ``* + ?`` as usual, ``& !`` predicates, ``~`` holds where a token begins a line. Rules
marked ``Name <= ...`` keep a packrat memo per position; rules marked ``Name <== ...`` keep in addition a memo that is
shared by all files of a worker: its key is the token string from the position to the end of the line and one token of
lookahead. What a rule makes of those tokens cannot depend on anything else unless it looks further, in which case the
entry says so and the rule runs in place. Source code repeats its token shapes far more than its texts, so most lines
are one look-up.

Tokens are single characters (one per class or spelling), a file is a string of them that ends in ``END``.
"""

from __future__ import annotations

import re
from bisect import bisect_right

END = "\x00"
_LOOKS_FURTHER = -2
SHARED_ENTRIES = 400_000

_PART = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([A-Z][A-Z_0-9]+)\b|([A-Z][A-Za-z0-9]*)|(\(|\)|/|\*|\+|\?|&|!|~))")


class Tokens:
    """The single characters of token classes and spellings."""

    def __init__(self) -> None:
        self.codes: dict[str, str] = {"END": END}

    def code(self, name: str) -> str:
        if name not in self.codes:
            self.codes[name] = chr(0x100 + len(self.codes))
        return self.codes[name]

    def name(self, code: str) -> str:
        return next((k for k, v in self.codes.items() if v == code), "?")


class _Reader:
    """The notation, read into nested tuples."""

    def __init__(self, text: str, tokens: Tokens, sets: dict[str, list[str]]) -> None:
        self.parts = [m.groups() for m in _PART.finditer(text)]
        if "".join(m.group() for m in _PART.finditer(text)).split() != text.split():
            raise ValueError(f"cannot read rule: {text}")
        self.at, self.tokens, self.sets = 0, tokens, sets

    def peek(self) -> str | None:
        return self.parts[self.at][3] if self.at < len(self.parts) else None

    def choice(self) -> tuple:
        out = [self.sequence()]
        while self.peek() == "/":
            self.at += 1
            out.append(self.sequence())
        flat: list[tuple] = []
        for x in out:  # neighbouring single tokens become one set
            if flat and x[0] == flat[-1][0] == "set":
                flat[-1] = ("set", flat[-1][1] + x[1])
            else:
                flat.append(x)
        return flat[0] if len(flat) == 1 else ("choice", flat)

    def sequence(self) -> tuple:
        out = []
        while self.at < len(self.parts) and self.peek() not in ("/", ")"):
            out.append(self.prefixed())
        return out[0] if len(out) == 1 else ("seq", out)

    def prefixed(self) -> tuple:
        mark = self.peek()
        if mark in ("&", "!"):
            self.at += 1
            return ("and" if mark == "&" else "not", self.prefixed())
        x = self.primary()
        while self.peek() in ("*", "+", "?"):
            x = ({"*": "star", "+": "plus", "?": "opt"}[self.peek()], x)
            self.at += 1
        return x

    def primary(self) -> tuple:
        literal, klass, rule, mark = self.parts[self.at]
        self.at += 1
        if literal is not None:
            return ("set", self.tokens.code(literal))
        if klass is not None:
            if klass in self.sets:
                return ("set", "".join(self.tokens.code(x) for x in self.sets[klass]))
            return ("never",) if klass == "NEVER" else ("set", self.tokens.code(klass))
        if rule is not None:
            return ("rule", rule)
        if mark == "~":
            return ("line",)
        if mark == "(":
            x = self.choice()
            self.at += 1
            return x
        raise ValueError(mark)


class _State:
    __slots__ = ("memo", "lines", "begins", "far")

    def __init__(self, lines: list[int]) -> None:
        self.memo: dict = {}
        self.lines = lines  # tokens that begin a line, in order
        self.begins = frozenset(lines)
        self.far = 0


class Grammar:
    """A compiled grammar. ``parse(tokens, lines)`` tells whether ``start`` consumes all tokens."""

    def __init__(self, text: str, tokens: Tokens, start: str, sets: dict[str, list[str]] | None = None) -> None:
        self.tokens, self.start = tokens, start
        rules: dict[str, tuple[tuple, int]] = {}
        for line in re.split(r"\n(?=[A-Z])", text.strip()):
            name, arrow, body = re.match(r"(\w+)\s*(<==|<=|<-)\s*(.*)", line, re.S).groups()
            rules[name] = (_Reader(body, tokens, sets or {}).choice(), len(arrow) - 2 if arrow != "<-" else -1)
        self.shared: dict = {}
        self.fast = self._compile(rules, False)
        self.slow = self._compile(rules, True)

    def _compile(self, rules: dict, trace: bool) -> dict:
        out: list[str] = []
        for name, (body, kind) in rules.items():
            if kind < 0:
                out.append(f"def r_{name}(S, K, p):")
                self._emit(body, "p", "r", out, 1, trace, [0])
                out.append("    return r")
                continue
            out.append(f"def raw_{name}(S, K, p):")
            self._emit(body, "p", "r", out, 1, trace, [0])
            out.append("    return r")
            if kind == 0 or trace:
                out += [
                    f"def r_{name}(S, K, p):",
                    f"    r = S.memo.get(({name!r}, p))",
                    "    if r is None:",
                    f"        r = S.memo[{name!r}, p] = raw_{name}(S, K, p)",
                    "    return r",
                ]
            else:
                out += [
                    f"def r_{name}(S, K, p):",
                    "    lines = S.lines",
                    "    i = bisect(lines, p)",
                    "    if i == len(lines):",
                    f"        return raw_{name}(S, K, p)",
                    "    e = lines[i]",
                    "    head = p in S.begins",
                    f"    key = ({name!r}, K[p:e + 1], head)",
                    "    r = shared.get(key)",
                    "    if r is None:",
                    "        try:",
                    f"            r = raw_{name}(State([0, e - p] if head else [e - p]), key[1], 0)",
                    "        except IndexError:",
                    f"            r = {_LOOKS_FURTHER}",
                    f"        if len(shared) > {SHARED_ENTRIES}:",
                    "            shared.clear()",
                    "        shared[key] = r",
                    "    if r >= 0:",
                    "        return p + r",
                    "    if r == -1:",
                    "        return -1",
                    f"    m = S.memo.get(({name!r}, p))",
                    "    if m is None:",
                    f"        m = S.memo[{name!r}, p] = raw_{name}(S, K, p)",
                    "    return m",
                ]
        space = {"bisect": bisect_right, "shared": self.shared, "State": _State}
        exec(compile("\n".join(out), "<grammar>", "exec"), space)  # our own generated code
        return space

    def _emit(self, x: tuple, p: str, r: str, out: list[str], depth: int, trace: bool, names: list[int]) -> None:
        pad = "    " * depth
        fresh = lambda: (names.__setitem__(0, names[0] + 1), f"v{names[0]}")[1]
        kind = x[0]
        if kind == "set":
            test = f"K[{p}] == {x[1]!r}" if len(x[1]) == 1 else f"K[{p}] in {x[1]!r}"
            out.append(f"{pad}{r} = {p} + 1 if {test} else -1")
            if trace:
                out.append(f"{pad}if {r} < 0 and {p} > S.far: S.far = {p}")
        elif kind == "rule":
            out.append(f"{pad}{r} = r_{x[1]}(S, K, {p})")
        elif kind == "never":
            out.append(f"{pad}{r} = -1")
        elif kind == "line":
            out.append(f"{pad}{r} = {p} if {p} in S.begins else -1")
        elif kind == "seq":
            if not x[1]:
                out.append(f"{pad}{r} = {p}")
                return
            at = p
            for i, part in enumerate(x[1]):
                last = i == len(x[1]) - 1
                to = r if last else fresh()
                self._emit(part, at, to, out, depth + i, trace, names)
                if not last:
                    inner = "    " * (depth + i)
                    out.append(f"{inner}if {to} < 0: {r} = -1")
                    out.append(f"{inner}else:")
                at = to
        elif kind == "choice":
            for i, part in enumerate(x[1]):
                self._emit(part, p, r, out, depth + i, trace, names)
                if i < len(x[1]) - 1:
                    out.append("    " * (depth + i) + f"if {r} < 0:")
        elif kind in ("star", "plus"):
            q, t = fresh(), fresh()
            out.append(f"{pad}{q} = {p}")
            out.append(f"{pad}while True:")
            self._emit(x[1], q, t, out, depth + 1, trace, names)
            out.append(f"{pad}    if {t} < 0 or {t} == {q}: break")
            out.append(f"{pad}    {q} = {t}")
            out.append(f"{pad}{r} = {q}" if kind == "star" else f"{pad}{r} = {q} if {q} != {p} else -1")
        elif kind == "opt":
            self._emit(x[1], p, r, out, depth, trace, names)
            out.append(f"{pad}if {r} < 0: {r} = {p}")
        elif kind in ("and", "not"):
            t = fresh()
            self._emit(x[1], p, t, out, depth, trace, names)
            out.append(f"{pad}{r} = {p} if {t} {'>=' if kind == 'and' else '<'} 0 else -1")
        else:
            raise ValueError(kind)

    def accepts(self, kinds: str, lines: list[int]) -> bool:
        """Whether all of ``kinds`` (which ends in END) is consumed. ``lines``: the tokens that begin a line."""
        end = self.fast[f"r_{self.start}"](_State(lines), kinds, 0)
        return end == len(kinds)

    def furthest(self, kinds: str, lines: list[int]) -> int:
        """The furthest token at which anything failed."""
        state = _State(lines)
        self.slow[f"r_{self.start}"](state, kinds, 0)
        return min(state.far, len(kinds) - 1)
