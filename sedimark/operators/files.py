"""Putting the files of a chunk table together again, one row per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_pieces(starts: list, ends: list, texts: list) -> str:
    """The content made of line ranges: pieces in line order, each without the lines that are there already.

    Lines end at ``\\n`` and keep their ends. A gap between pieces is left out without a trace; pieces without text
    add nothing; of repeated or overlapping pieces each line counts once.
    """
    if len(texts) == 1:
        return texts[0] or ""
    out, have = [], 0
    for start, end, text in sorted((s or 1, -(e or 0), t) for s, e, t in zip(starts, ends, texts) if t):
        end = -end
        if end <= have:
            continue
        skip, at = max(0, have - start + 1), 0
        for _ in range(skip):
            at = text.find("\n", at) + 1
            if not at:
                break
        else:
            out.append(text[at:])
        have = end
    return "".join(out)


def file_pieces(chunks: DataFrame, **kept: Column) -> DataFrame:
    """One row per ``source``: ``pieces`` (line ranges with text) and the aggregates in ``kept``.

    A set, not a list, is collected: rows delivered any number of times meet before the shuffle and count once, so a
    file that makes up a third of all rows by repetition costs no more than its distinct pieces. Rows without a
    source are left out, since they belong to no file.
    """
    piece = F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("text").alias("t"))
    return (
        chunks.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.collect_set(piece).alias("pieces"), *(c.alias(k) for k, c in kept.items()))
    )


def contents(batch: pa.RecordBatch) -> list[str]:
    """The content of each row of a batch of ``file_pieces``."""
    lists = batch.column(batch.schema.get_field_index("pieces"))
    offsets = lists.offsets.to_pylist()
    flat = lists.values
    s, e, t = (flat.field(i).to_pylist() for i in range(3))
    return [join_pieces(s[a:b], e[a:b], t[a:b]) for a, b in zip(offsets, offsets[1:])]


def map_files(
    files: DataFrame, fn: Callable[[list[str], list[str], pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Apply ``fn(sources, contents, batch) -> columns`` to the files, in Arrow batches."""
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.column(batch.schema.get_field_index("source")).to_pylist(), contents(batch), batch)
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return files.mapInArrow(run, schema)
