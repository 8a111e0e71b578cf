"""Source files that do not parse: packrat grammars per language, whole-file consumption, furthest failure, rates.

Each file is put together from its chunks, lexed and parsed by the grammar of its extension
(:mod:`sedimark.llm.grammars`). It is invalid when the grammar does not consume all of it. The furthest position at
which any alternative failed is where the file stops making sense; from it and the text around it comes the cause:
``conflict`` (a merge-conflict marker at or near the failure), ``truncated`` (the failure is at the end of the text),
``other``. Files in an extension without a grammar are not judged.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.grammars import CONFLICT, language
from sedimark.operators.files import file_pieces, map_files

EXTENSIONS = ("ts", "tsx", "js", "jsx", "html", "prisma", "py", "css")
MAX_DEPTH = 60_000
#: calls that one nested character takes at most
FRAMES = 64


def extension(source: str) -> str:
    name = source.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def failure(text: str, ext: str) -> tuple[int, str] | None:
    """None for a text that is valid in the language of ``ext`` (or when there is no grammar), else (character, cause)."""
    lang = language(ext)
    if lang is None:
        return None
    depth = min(max(MAX_DEPTH, FRAMES * len(text)), 2**31 - 1)  # as deep as any text of this length can nest
    if sys.getrecursionlimit() < depth:
        sys.setrecursionlimit(depth)
    try:
        at = lang.check(text)
    except RecursionError:
        return 0, "nesting"
    if at is None:
        return None
    line = text.rfind("\n", 0, at) + 1
    near = text[max(0, text.rfind("\n", 0, max(0, line - 1)) + 1) : at + 200]
    if CONFLICT.search(near):
        return at, "conflict"
    if not text[at:].strip():
        return at, "truncated"
    return at, "other"


def judge_files(chunks: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """One row per file of a language: ``source, scope, language, valid, line, col, cause``.

    ``line`` and ``col`` (from 1) of the furthest failure and ``cause`` are null for valid files. An empty file is
    valid. Files whose source is null are left out; repeated rows count once.
    """
    wanted = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)).isin(*extensions)
    files = file_pieces(chunks.select("source", "start_line", "end_line", "text").where(wanted))

    def run(sources: list[str], texts: list[str], batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"source": sources, "valid": [], "line": [], "col": [], "cause": []}
        for source, text in zip(sources, texts):
            bad = failure(text, extension(source))
            out["valid"].append(bad is None)
            if bad is None:
                place = (None, None, None)
            else:
                begin = text.rfind("\n", 0, bad[0]) + 1
                place = (text.count("\n", 0, bad[0]) + 1, bad[0] - begin + 1, bad[1])
            for k, v in zip(("line", "col", "cause"), place):
                out[k].append(v)
        out["line"], out["col"], out["cause"] = pa.array(out["line"], pa.int32()), pa.array(out["col"], pa.int32()), pa.array(out["cause"], pa.string())
        return out

    judged = map_files(files, run, "source string, valid boolean, line int, col int, cause string")
    return judged.select("source", F.substring_index("source", "/", 1).alias("scope"), F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)).alias("language"), "valid", "line", "col", "cause")


def rates(judged: DataFrame) -> DataFrame:
    """Per scope and language: files, invalid ones, their rate, and how many have each cause."""
    bad = (~F.col("valid")).cast("int")
    cause = lambda x: F.sum((F.col("cause") == x).cast("int"))
    return judged.groupBy("scope", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(bad).alias("invalid"),
        F.round(F.avg(bad), 6).alias("rate"),
        F.coalesce(cause("conflict"), F.lit(0)).alias("conflicts"),
        F.coalesce(cause("truncated"), F.lit(0)).alias("truncated"),
    )
