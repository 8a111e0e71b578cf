"""Several values packed in one field: a parsing expression grammar that yields one row per value.

    field    <- BLANK* (wrapped / list) END
    wrapped  <- '[' list ']' / '{' list '}' / '(' list ')'
    list     <- item? (SEP+ item?)*
    item     <- quoted / statement / bare
    quoted   <- '"' (ESC / '""' / !'"' .)* '"' &(SEP / END)   and the same for ' and `
    statement<- 'from' B module B 'import' B names / 'import' B module ('as' name)? (',' ...)*
    bare     <- (group / !SEP .)+        group <- '[' (group / !']' .)* ']' and the like

Alternatives are ordered: where a quoted item does not end in a quote before a separator, the parser goes back and
reads it as a bare one, drops the stray quote and flags the item. Where a wrapped list does not close at the end, the
opening bracket is read as a stray character. Separators are ``, ; |``, tabs, line ends and, where an item may hold no
blank, blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = {"[": "]", "{": "}", "(": ")"}
QUOTES = "\"'`"
BLANK = " \t\r\n\f\v ﻿"
HARD = ",;|\t\r\n"

_NAME = r"[^\s,;|\"'`()\[\]{}]+"
_ALIASED = rf"{_NAME}(?:[ \t]+as[ \t]+{_NAME})?"
_NEXT = rf"(?!(?:from|import)[ \t])(?:{_ALIASED})"
_STATEMENT = re.compile(
    rf"from[ \t]+{_NAME}[ \t]+import[ \t]*(?:\([^()]*\)|[ \t]{_NEXT}(?:[ \t]*,[ \t]*{_NEXT}(?=[ \t]*(?:[,;|\"'`\t\r\n\]}})]|$|(?:from|import)[ \t])))*)"
    rf"|import[ \t]+{_ALIASED}(?:[ \t]*,[ \t]*{_NEXT}(?=[ \t]*(?:[,;|\"'`\t\r\n\]}})]|$)))*"
)

#: error flags of an item
OK, STRAY_QUOTE, UNCLOSED = "", "stray_quote", "unclosed"


class _Parser:
    """One field. ``statements``: items may be whole Python import statements; else no item holds a blank."""

    def __init__(self, text: str, statements: bool) -> None:
        self.text, self.statements = text, statements
        self.memo: dict[int, tuple | None] = {}

    def quoted(self, at: int) -> tuple[int, str, str] | None:
        """A quoted item at ``at``: its end, its value, no flag. None where it does not end before a separator."""
        text, quote, out = self.text, self.text[at], []
        i, n = at + 1, len(text)
        while i < n:
            c = text[i]
            if c == "\\" and i + 1 < n and text[i + 1] in QUOTES + "\\":
                out.append(text[i + 1])
                i += 2
            elif c == quote:
                if text[i + 1 : i + 2] == quote:
                    out.append(quote)
                    i += 2
                    continue
                rest = i + 1
                if rest == n or text[rest] in HARD or text[rest] in BLANK or text[rest] in "]})":
                    return rest, "".join(out), OK
                return None
            else:
                out.append(c)
                i += 1
        return None

    def group(self, at: int) -> int | None:
        """The end of a bracketed group at ``at``, None where it is not closed."""
        if at in self.memo:
            return self.memo[at]
        stack, i = [PAIRS[self.text[at]]], at + 1
        while i < len(self.text) and stack:
            c = self.text[i]
            if c in PAIRS:
                stack.append(PAIRS[c])
            elif c in "]})":
                if c != stack[-1]:
                    break
                stack.pop()
            i += 1
        self.memo[at] = None if stack else i
        return self.memo[at]

    def bare(self, at: int, end: int) -> tuple[int, str, str]:
        text, i = self.text, at
        while i < end:
            c = text[i]
            if c in PAIRS and i > at and (stop := self.group(i)) and stop <= end:
                i = stop
            elif c in HARD or (c in BLANK):
                break
            else:
                i += 1
        value = text[at:i]
        flag = OK
        for q in QUOTES:
            if value.count(q) % 2:
                flag = STRAY_QUOTE
        if value[:1] in QUOTES and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        elif flag:
            value = value.strip(QUOTES)
        return i, value, flag

    def items(self, at: int, end: int) -> list[tuple[str, str]]:
        text, out, i = self.text, [], at
        while i < end:
            c = text[i]
            if c in HARD or c in BLANK:
                i += 1
                continue
            got = None
            if c in QUOTES:
                got = self.quoted(i)
                if got and got[0] > end:
                    got = None
                if got is None and self.statements and (m := _STATEMENT.match(text, i + 1, end)):
                    stop = m.end()
                    got = stop + (text[stop : stop + 1] == c), m.group(), STRAY_QUOTE
            elif self.statements and (m := _STATEMENT.match(text, i, end)):
                stop = m.end()
                got = stop, m.group(), OK
                if text[stop : stop + 1] and text[stop : stop + 1] in QUOTES:
                    got = stop + 1, m.group(), STRAY_QUOTE
            if got is None:
                got = self.bare(i, end)
            i, value, flag = got
            value = value.strip(BLANK)
            if c in QUOTES and not flag and self.statements is False and re.search(r"\s", value):
                # a quoted item with blanks in it, in a field whose items hold none: the quotes hold a packed list
                out += _Parser(value, False).items(0, len(value))
            elif value:
                out.append((value, flag))
            i = max(i, 1)
        return out

    def field(self) -> list[tuple[str, str]]:
        text = self.text
        at, end = 0, len(text)
        while at < end and text[at] in BLANK:
            at += 1
        while end > at and text[end - 1] in BLANK:
            end -= 1
        if at < end and text[at] in PAIRS:
            if text[end - 1] == PAIRS[text[at]]:
                stop = self.group_quoted(at, end)
                if stop == end:
                    return self.items(at + 1, end - 1)
            elif text[at] in "[{" and self.group_quoted(at, end) is None:
                return [(v, f or UNCLOSED) for v, f in self.items(at + 1, end)]
        return self.items(at, end)

    def group_quoted(self, at: int, end: int) -> int | None:
        """Like ``group``, but brackets in quoted items do not count."""
        depth, i, fresh = 0, at, True
        while i < end:
            c = self.text[i]
            if c in QUOTES and fresh and (got := self.quoted(i)):
                i, fresh = got[0], False
                continue
            if c in PAIRS:
                depth += 1
            elif c in "]})":
                depth -= 1
                if not depth:
                    return i + 1
            fresh = c in HARD or c in BLANK or c in "[{("
            i += 1
        return None


def split_packed(text: str | None, statements: bool = False) -> list[tuple[str, str]]:
    """The values of a packed field in order, each with its error flag (``""`` when well formed).

    Null, empty and blank fields and empty brackets yield nothing; empty items are skipped; repeated ones stay.
    """
    if not text or text.isspace():
        return []
    return _Parser(text, statements).field()


def split_fields(
    rows: DataFrame, key: str, fields: list[str], statement_fields: tuple[str, ...] = (), python_path: str | None = None
) -> DataFrame:
    """One row per value: ``key, field_name, pos, item, error``.

    ``statement_fields`` may hold Python import statements (where ``python_path`` names a column, only for rows whose
    value of it ends in ``.py``). Rows delivered more than once count once; columns besides those named are ignored,
    so clashing names do no harm. Nulls equal empty fields. The work is row by row, without a shuffle of more than
    the fields.
    """
    cols = [F.col(f"`{key}`").cast("string").alias("_k"), (F.lower(F.col(f"`{python_path}`")).endswith(".py") if python_path else F.lit(True)).alias("_py")]
    cols += [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"_f{i}") for i, f in enumerate(fields)]
    some = " or ".join(f"trim(_f{i}) not in ('', '[]', '{{}}')" for i in range(len(fields)))
    packed = rows.select(*cols).where(some).distinct()
    flags = [f in statement_fields for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, bool], list] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[], [], [], [], []]
            for row in range(batch.num_rows):
                for i, name in enumerate(fields):
                    text = columns[2 + i][row]
                    if not text:
                        continue
                    k = (text, flags[i] and bool(columns[1][row]))
                    got = memo.get(k)
                    if got is None:
                        if len(memo) > 50_000:
                            memo.clear()
                        got = memo[k] = split_packed(*k)
                    for pos, (item, flag) in enumerate(got, 1):
                        for column, value in zip(out, (columns[0][row], name, pos, item, flag)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], [key, "field_name", "pos", "item", "error"]
            )

    return packed.mapInArrow(run, f"`{key}` string, field_name string, pos int, item string, error string")
