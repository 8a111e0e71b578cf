"""Lines-of-code metrics with risk bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.code import extension, risk_level


def loc_by_file(chunks: DataFrame, min_lines: int = 200) -> DataFrame:
    """``source, lines_total, lines_code, chunks_count, risk_level``; blank sources are left out (F1).

    ``lines_code`` sums over chunks and so counts shared lines twice; that is the contract.
    """
    files = chunks.where(F.trim("source") != "").groupBy("source").agg(
        F.coalesce(F.max("end_line"), F.lit(0)).alias("lines_total"),
        F.coalesce(F.sum("lines_code"), F.lit(0)).cast("long").alias("lines_code"),
        F.count(F.lit(1)).alias("chunks_count"),
    )
    return files.withColumn("risk_level", risk_level(F.col("lines_code"), F.col("lines_total"), min_lines))


def exceeding(files: DataFrame, min_lines: int = 200) -> DataFrame:
    """Files of at least so many lines in total (the band goes by code lines, this by all)."""
    return files.where(F.col("lines_total") >= min_lines)


def largest(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.col("lines_total").desc(), "source").limit(n)


def loc_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("source")).alias("ext")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("lines_total").alias("total_lines"))


def loc_totals(files: DataFrame, min_lines: int = 200) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("lines_total") >= min_lines).alias("files_exceeding_threshold"),
        F.lit(min_lines).alias("min_lines_threshold"),
        F.coalesce(F.sum("lines_total"), F.lit(0)).alias("total_lines_codebase"),
    )
