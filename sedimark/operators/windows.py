"""Overlapping line windows and the lines of chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.code import lines


def line_windows(df: DataFrame, key: str, text: str = "text", size: int = 50, overlap: int = 10) -> DataFrame:
    """``key, start_line, end_line, text`` of windows of ``size`` lines that share ``overlap`` lines.

    A window begins at every ``size - overlap`` lines while more than ``overlap`` lines are left; a text of one window
    or less gives one. Null and empty texts give none. No shuffle: rows are exploded where they are.
    """
    cut = df.where(F.col(text) != "").select(key, lines(F.col(text)).alias("_l")).withColumn("_n", F.size("_l"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s < F.col("_n") - overlap))
    rows = cut.select(key, "_l", "_n", F.explode(starts).alias("_s"))
    return rows.select(key, (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + size, "_n").alias("end_line"), F.array_join(F.slice("_l", F.col("_s") + 1, size), "\n").alias("text"))


def numbered_lines(df: DataFrame, source: str = "source", start: str = "start_line", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line of each row: ``source, line_no, line`` and the columns of ``keep``."""
    return df.where(F.col(text).isNotNull()).select(source, *keep, F.col(start).alias("_s"), F.posexplode(lines(F.col(text))).alias("_p", "line")).select(source, *keep, (F.col("_s") + F.col("_p")).alias("line_no"), "line")


def last_writer(numbered: DataFrame, by: str, rank: str) -> DataFrame:
    """One row per (``by``, line_no): that of the greatest ``rank`` (G2). ``max_by`` combines before the shuffle."""
    return numbered.groupBy(by, "line_no").agg(F.max_by("line", F.struct(rank, "line")).alias("line"))


def islands(numbered: DataFrame, by: str) -> DataFrame:
    """Runs of consecutive lines as blocks: ``by, start_line, end_line, content`` (G1)."""
    w = Window.partitionBy(by).orderBy("line_no")
    rows = numbered.withColumn("_island", F.col("line_no") - F.row_number().over(w))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    blocks = rows.groupBy(by, "_island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), ordered.alias("_l"))
    return blocks.select(by, "start_line", "end_line", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"))


def fuse(hits: DataFrame, rank: str = "rank", keep_order: bool = True) -> DataFrame:
    """Hits ``source, start_line, text, rank`` fused into blocks of consecutive lines per file.

    On lines that several hits have, the one ranked later wins. With ``keep_order`` a column ``file_rank`` has the
    best rank of the block's file, by which callers order blocks, then by line.
    """
    numbered = numbered_lines(hits, keep=(rank,))
    blocks = islands(last_writer(numbered, "source", rank), "source")
    if not keep_order:
        return blocks
    best = hits.groupBy(F.col("source").alias("_s")).agg(F.min(rank).alias("file_rank"))
    return blocks.join(best, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def within_budget(df: DataFrame, order: str, size: str, budget: int, partition: str | None = None) -> DataFrame:
    """The rows before the first that does not fit into the running budget (G4); none after it, however small.

    What comes after the first row that exceeds the budget within its own task exceeds it in all, so every task drops it
    before the shuffle, and a partition that holds a tenth of all rows sends little more than a budget's worth per task.
    That first row stays, so that the rows after it in other tasks are counted right. Rows should be narrow; sizes are
    not negative; null ones count as 0.
    """
    keys = [partition] if partition else []

    def early(batches):
        current, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False)
            names = batch.column(batch.schema.get_field_index(partition)).to_pylist() if partition else None
            begins = [0, *(i for i in range(1, batch.num_rows) if names[i] != names[i - 1])] if partition else [0]
            kept = np.zeros(batch.num_rows, dtype=bool)
            for a, b in zip(begins, [*begins[1:], batch.num_rows]):
                if partition and (names[a],) != current:
                    current, total = (names[a],), 0
                sums = total + np.concatenate([[0], np.cumsum(np.nan_to_num(sizes[a:b].astype(np.float64)))])
                kept[a:b] = sums[:-1] <= budget
                total = sums[-1]
            yield batch.filter(pa.array(kept))

    few = df.sortWithinPartitions(*keys, order).mapInArrow(early, df.schema)
    w = (Window.partitionBy(partition) if partition else Window.partitionBy(F.lit(0))).orderBy(order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return few.withColumn("_total", F.coalesce(total, F.lit(0))).where(F.col("_total") <= budget).drop("_total")


def reassemble(chunks: DataFrame, source: str = "source") -> DataFrame:
    """The text of each file from its chunks, line by line (F13): ``source, content, lines``."""
    each = numbered_lines(chunks, source).groupBy(source, "line_no").agg(F.max("line").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return each.groupBy(source).agg(ordered.alias("_l")).select(source, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"), F.size("_l").alias("lines"))
