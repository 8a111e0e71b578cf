"""The structural map of a project: classes by category, models, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.code import CATEGORY_ORDER, class_category, short_path


def classes(chunks: DataFrame) -> DataFrame:
    """``scope, category, class_name, source, path``: each class once per scope, at its first source."""
    named = chunks.select(F.coalesce("scope", F.lit("unknown")).alias("scope"), F.trim("class_name").alias("class_name"), "source").where("class_name != ''")
    first = named.groupBy("scope", "class_name").agg(F.min("source").alias("source"))
    return first.select("scope", class_category(F.col("class_name")).alias("category"), "class_name", "source", short_path(F.col("source")).alias("path"))


def category_lists(chunks: DataFrame) -> DataFrame:
    """Per scope and category the classes as one text, in the order in which categories are shown."""
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORY_ORDER)), F.col("category"))
    lists = classes(chunks).groupBy("scope", "category").agg(F.array_join(F.array_sort(F.collect_list("class_name")), ", ").alias("classes"), F.count(F.lit(1)).alias("n"))
    return lists.withColumn("place", F.when(place == 0, len(CATEGORY_ORDER) + 1).otherwise(place))


def scope_files(chunks: DataFrame) -> DataFrame:
    """Distinct files per scope."""
    files = chunks.where("source is not null and source != ''").select(F.coalesce("scope", F.lit("unknown")).alias("scope"), "source").distinct()
    return files.groupBy("scope").agg(F.count(F.lit(1)).alias("files"))


def models(chunks: DataFrame) -> DataFrame:
    """The distinct models that chunks name, in a JSON list or parted by commas."""
    raw = chunks.select(F.trim("models").alias("m")).where("m != ''").distinct()
    listed = F.coalesce(F.from_json("m", "array<string>", {"allowSingleQuotes": "false"}), F.split("m", ","))
    return raw.select(F.explode(listed).alias("m")).select(F.trim("m").alias("model")).where("model != ''").distinct()


def directories(chunks: DataFrame) -> DataFrame:
    """The directory tree as rows: ``path, depth, files`` of every folder above a file."""
    files = chunks.where("source is not null").select(F.replace("source", F.lit("\\"), F.lit("/")).alias("source")).distinct()
    parts = F.filter(F.split("source", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = files.where(F.size(parts) > 1).select(F.explode(above).alias("path"))
    return folders.groupBy("path").agg(F.count(F.lit(1)).alias("files")).withColumn("depth", F.size(F.split("path", "/")))
