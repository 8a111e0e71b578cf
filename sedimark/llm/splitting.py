"""Cutting oversized items at natural boundaries: a recursive separator hierarchy, greedy packing, trailing overlap.

The hierarchy, coarse to fine: *section* (before a line at the outermost indentation that follows a blank line, and
before headings and top-level declarations), *paragraph* (after blank lines), *line*, *sentence* (after ``; } { . ! ?``
and white space or a bracket), *word* (after white space) and *character*.

A text is split by sections; parts are packed greedily, in order, into the piece under way. A part that does not fit
ends the piece, if that is at least half full; otherwise the part is split by the next separator that it holds, and so
on down, and its parts are packed. So a piece ends at the coarsest boundary in its second half. Only a line that no
piece can hold is cut within, and what is left of it is packed with the lines that follow. A piece begins with the last
``overlap`` lines of the one before; where those and the next line (its first sentence, if it has to be cut) exceed the
limits together, with as many of them as fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_CHARS, OVERLAP = 50, 4000, 10

_DECLARATION = re.compile(r"(?:export |default |abstract |async |public |declare )*(?:class|function|interface|enum|type|const|let|var|def|model|datasource|generator|namespace|module|struct|fn|func|impl)\b|@[\w.]+|#{1,6} |:root|@media|async def ")
_SENTENCE = re.compile(r"[;{},.!?>](?=\s|$|[\w\"'.#@<(\[])|[;{}]")
_WORD = re.compile(r"\s+")


def split_lines(text: str) -> list[str]:
    """The lines with their ends; lines end at ``\\n`` only, and a final one begins no further line."""
    lines = text.split("\n")
    out = [x + "\n" for x in lines[:-1]]
    if lines[-1]:
        out.append(lines[-1])
    return out


def levels(lines: list[str]) -> list[int]:
    """For each line, how natural a cut before it is: 3 section, 2 paragraph, 1 line."""
    out = []
    blank = True
    for line in lines:
        bare = line.strip()
        top = bool(bare) and not line[0].isspace() and bare[0] not in ")]}"
        if top and (_DECLARATION.match(bare) or (blank and bare[0] not in "<")):
            out.append(3)
        elif bare and blank:
            out.append(2)
        else:
            out.append(1)
        blank = not bare
    return out


def _inside(text: str, a: int, b: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """The parts of ``text[a:b]`` that end where the pattern matches."""
    cuts = [m.end() for m in pattern.finditer(text, a, b) if a < m.end() < b]
    return list(zip([a, *cuts], [*cuts, b])) if cuts else []


SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = range(6)


def split_text(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """``(first line, last line, shared characters, text)`` of the pieces, lines from 1. A text within the limits is one piece.

    Without the characters that they share with the piece before, the pieces are the text. Nothing comes of an empty text.
    """
    if not text:
        return []
    lines = split_lines(text)
    if len(lines) <= max_lines and len(text) <= max_chars:
        return [(1, len(lines), 0, text)]
    starts = [0, *accumulate(map(len, lines))]
    grade = levels(lines)
    cuts = {g: [starts[i] for i, x in enumerate(grade) if x >= 3 - g] for g in (SECTION, PARAGRAPH, LINE)}
    line_of = lambda at: bisect_right(starts, at) - 1
    fits = lambda a, b: b - a <= max_chars and line_of(b - 1) - line_of(a) < max_lines

    def parts(a: int, b: int, level: int, room: int) -> list[tuple[int, int, int]]:
        """The span split by the coarsest separator in it, from ``level`` on, each part with the level to go on with."""
        for g in range(level, LINE + 1):
            own = cuts[g][bisect_right(cuts[g], a) : bisect_left(cuts[g], b)]
            if own:
                return [(x, y, g + 1) for x, y in zip([a, *own], [*own, b])]
        if level <= SENTENCE and (found := _inside(text, a, b, _SENTENCE)):
            return [(x, y, WORD) for x, y in found]
        if level <= WORD and (found := _inside(text, a, b, _WORD)):
            return [(x, y, CHARACTER) for x, y in found]
        return [(a, a + room, CHARACTER), (a + room, b, CHARACTER)]

    out: list[tuple[int, int, int, str]] = []
    todo = [(0, len(text), SECTION)]
    start = begin = end = 0  # the piece is text[start:end], of which text[begin:end] is new

    def emit() -> None:
        nonlocal start, begin
        out.append((line_of(start) + 1, line_of(end - 1) + 1, begin - start, text[start:end]))
        at = line_of(end)
        begin = end
        whole = end == starts[at]
        start = max(starts[line_of(start) + 1], starts[max(0, at - overlap)]) if whole and overlap else end
        start = min(start, end)

    def splits(a: int, b: int) -> bool:
        """Whether a part is cut on: it has several lines, or is a piece of a line that no piece can hold and either
        exceeds the limit alone or would fill the piece under way."""
        i = line_of(a)
        if starts[i + 1] < b:
            return True
        return starts[i + 1] - starts[i] > max_chars and b - a > 1 and (b - a > max_chars or end > begin)

    while todo:
        a, b, level = todo.pop()
        if fits(start, b):
            end = b
            continue
        half = end - start >= max_chars // 2 or line_of(end - 1) - line_of(start) + 1 >= max_lines // 2
        if end > begin and (half or not splits(a, b)):
            emit()
            todo.append((a, b, level))
        elif splits(a, b):
            todo += reversed(parts(a, b, level, max(1, max_chars - (a - start))))
        else:  # share fewer lines
            start = min(starts[line_of(start) + 1], a)
            todo.append((a, b, level))
    if end > begin:
        emit()
    return out


def oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows over a limit. Characters are code points; lines end at ``\\n``. Null texts are over none."""
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = newlines + F.when((F.col("text") == "") | F.col("text").endswith("\n"), 0).otherwise(1)
    return chunks.where((F.length("text") > max_chars) | (n_lines > max_lines))


def split_oversized(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the rows over the limits: ``id, piece, start_line, end_line, shared_chars, text``.

    ``shared_chars`` of a piece's text are the end of the piece before. Lines count on from the row's ``start_line`` (from 1 where it is null). Rows delivered more than once count once.
    Only rows over a limit leave the JVM; the scan reads four columns.
    """
    rows = oversized(chunks.select("id", "start_line", "text"), max_lines, max_chars).where("id is not null")
    rows = rows.dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece", "start_line", "end_line", "shared_chars", "text"]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out: list[tuple] = []
                for key, first, text in zip(*(c.slice(at, 1000).to_pylist() for c in batch.columns)):
                    base = (first if first is not None else 1) - 1
                    for i, (a, b, shared, piece) in enumerate(split_text(text, max_lines, max_chars, overlap), 1):
                        out.append((key, i, base + a, base + b, shared, piece))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    return rows.mapInArrow(run, "id string, piece int, start_line int, end_line int, shared_chars int, text string")
