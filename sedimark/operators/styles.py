"""Tracing style rules to components: rules, declared and used classes, dead classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimark.functions.code import is_vendor_icon
from sedimark.operators.packed import split_fields
from sedimark.operators.windows import reassemble
from sedimark.schema import CSS_RULE

STYLE_SUFFIXES = r"\.(css|scss|less|sass)$"
COMPONENT_SUFFIXES = r"\.(tsx|jsx|js|html|vue|svelte|astro)$"
DYNAMIC = "[BEM]"
# fixed values: classes of states, which match a rule only beside another class of the component
STATE_CLASSES = ("active", "open", "disabled", "selected", "loading", "ok", "err", "block", "warn", "open-up", "align-right")


def rules_of(chunks: DataFrame) -> DataFrame:
    """``css_file, selector, classes, start_line, end_line, properties, media_query``, once per file.

    The packed column repeats a file's rules on each of its chunks, so it is made distinct before it is parsed.
    Columns that are no list of rules yield nothing.
    """
    packed = chunks.where("css_rules is not null and css_rules != '' and css_rules != '[]'").select(F.col("source").alias("css_file"), "css_rules").distinct()
    rules = packed.select("css_file", F.explode(F.from_json("css_rules", T.ArrayType(CSS_RULE))).alias("r")).select("css_file", "r.*")
    return rules.withColumn("_p", F.to_json("properties")).dropDuplicates(["css_file", "selector", "start_line", "end_line", "media_query", "_p"]).drop("_p")


def _tags(chunks: DataFrame, suffixes: str) -> DataFrame:
    return split_fields(chunks.where(F.col("source").rlike(suffixes)), "source", ["tags"]).select("source", F.col("item").alias("cls"))


def declared(chunks: DataFrame) -> DataFrame:
    """``cls, css_file``: each declared class at its first style sheet."""
    return _tags(chunks, STYLE_SUFFIXES).groupBy("cls").agg(F.min("source").alias("css_file"))


def consumed(chunks: DataFrame) -> DataFrame:
    """``source, cls, dynamic``: classes that components use; dynamic ones are prefixes of names built at run time."""
    used = _tags(chunks, COMPONENT_SUFFIXES).distinct()
    dynamic = F.col("cls").startswith(DYNAMIC)
    return used.select("source", F.when(dynamic, F.expr(f"substring(cls, {len(DYNAMIC) + 1})")).otherwise(F.col("cls")).alias("cls"), dynamic.alias("dynamic")).where("cls != ''")


def dead_classes(declared: DataFrame, consumed: DataFrame) -> DataFrame:
    """``css_file, cls`` of declared classes that no component names, by name or by a dynamic prefix.

    The prefix condition is an equi join too: each class is exploded into its prefixes, of which there are as many as
    it has letters.
    """
    own = declared.where(~is_vendor_icon(F.col("cls")))
    unnamed = own.join(consumed.where("not dynamic").select("cls").distinct(), "cls", "left_anti")
    prefixes = consumed.where("dynamic").select(F.col("cls").alias("prefix")).distinct()
    each = unnamed.select("cls", F.explode(F.sequence(F.lit(1), F.length("cls"))).alias("n")).select("cls", F.expr("substring(cls, 1, n)").alias("prefix"))
    built = each.join(prefixes, "prefix", "left_semi").select("cls").distinct()
    return unnamed.join(built, "cls", "left_anti").select("css_file", "cls")


def _mentions(properties: Column, text: str) -> Column:
    found = F.filter(F.map_entries(properties), lambda e: F.contains(F.lower(e["key"]), F.lit(text.lower())) | F.contains(F.lower(e["value"]), F.lit(text.lower())))
    return F.size(found) > 0


def component_trace(consumed: DataFrame, rules: DataFrame, component: str | None = None, cls: str | None = None, prop: str | None = None, within_repository: bool = False) -> DataFrame:
    """``component, cls, css_file, selector, start_line, end_line, media_query``: the rules of each component's classes.

    ``within_repository`` matches only sheets whose path begins with the same segment; a table of many repositories
    needs that. One row per component and rule; :func:`trace_summary` counts instead.

    Filters are case-insensitive substrings (D4). A class without a rule stays with nulls, unless a property is asked
    for. A state class matches only rules that name another class of the component, where it has one (D10).
    """
    used = consumed.where("not dynamic").where(~is_vendor_icon(F.col("cls")))
    state = F.lower("cls").isin(*STATE_CLASSES)
    base = used.groupBy("source").agg(F.collect_set(F.when(~state, F.col("cls"))).alias("_base"))
    if component:
        used = used.where(F.contains(F.lower("source"), F.lit(component.lower())))
    if cls:
        used = used.where(F.contains(F.lower("cls"), F.lit(cls.lower())))
    if prop:
        rules = rules.where(_mentions(F.col("properties"), prop))
    by_class = rules.select(F.explode(F.array_distinct("classes")).alias("cls"), "css_file", "selector", "start_line", "end_line", "media_query", F.col("classes").alias("_c"))
    repository = lambda c: F.substring_index(c, "/", 1) if within_repository else F.lit("")
    by_class = by_class.withColumn("_repo", repository("css_file"))
    joined = used.withColumn("_state", state).withColumn("_repo", repository("source")).join(base, "source").join(by_class, ["_repo", "cls"], "left")
    fits = ~F.col("_state") | (F.size("_base") == 0) | F.arrays_overlap("_base", F.coalesce("_c", F.array().cast("array<string>")))
    rows = joined.select(F.col("source").alias("component"), "cls", *(F.when(fits, F.col(c)).alias(c) for c in ("css_file", "selector", "start_line", "end_line", "media_query"))).distinct()
    matched = rows.where("css_file is not null")
    if prop:
        return matched
    bare = rows.where("css_file is null").join(matched.select("component", "cls").distinct(), ["component", "cls"], "left_anti")
    return matched.unionByName(bare)


def trace_summary(consumed: DataFrame, rules: DataFrame) -> DataFrame:
    """``component, cls, rules, css_file``: per component and class the number of rules within its repository, and the first sheet.

    Rules are counted per class before they meet components, so a class that all of them share costs one row per
    component instead of one per pair. State classes, which need another class in common (D10), are counted per pair
    of classes: a rule counts once for the first class it shares.
    """
    repository = lambda c: F.substring_index(c, "/", 1).alias("repo")
    used = consumed.where("not dynamic").where(~is_vendor_icon(F.col("cls"))).select(repository("source"), "source", "cls").distinct()
    state = F.lower("cls").isin(*STATE_CLASSES)
    each = rules.select(repository("css_file"), F.explode(F.array_distinct("classes")).alias("cls"), "css_file", F.col("classes").alias("_c"))
    plain = each.where(~state).groupBy("repo", "cls").agg(F.count(F.lit(1)).alias("rules"), F.min("css_file").alias("css_file"))
    one = used.where(~state).join(plain, ["repo", "cls"], "left")
    beside = each.where(state).select("repo", "cls", "css_file", F.explode(F.array_except("_c", F.array("cls"))).alias("base"))
    beside = beside.groupBy("repo", "cls", "base").agg(F.count(F.lit(1)).alias("n"), F.min("css_file").alias("css_file"))
    bases = used.where(~state).select("repo", "source", F.col("cls").alias("base"))
    met = used.where(state).join(bases, ["repo", "source"]).join(beside, ["repo", "cls", "base"]).groupBy("source", "cls").agg(F.max("n").alias("rules"), F.min("css_file").alias("css_file"))
    two = used.where(state).select("source", "cls").join(met, ["source", "cls"], "left")
    columns = [F.col("source").alias("component"), "cls", F.coalesce("rules", F.lit(0)).alias("rules"), "css_file"]
    return one.select(*columns).unionByName(two.select(*columns))


def property_matches(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose properties or values mention ``text``, with those that do."""
    hit = F.map_filter("properties", lambda k, v: F.contains(F.lower(k), F.lit(text.lower())) | F.contains(F.lower(v), F.lit(text.lower())))
    return rules.where(_mentions(F.col("properties"), text)).select("css_file", "selector", "start_line", "end_line", F.to_json(hit).alias("matching"), "media_query")


def component_texts(chunks: DataFrame) -> DataFrame:
    """``source, content`` of component files."""
    rows = chunks.where(F.col("source").rlike(r"\.(js|jsx|tsx|html|vue|svelte)$")).select("id", "source", "start_line", "text").dropDuplicates(["id"])
    return reassemble(rows).select("source", "content")
