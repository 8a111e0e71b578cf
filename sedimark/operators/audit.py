"""Static audit of layout risks: six predicates over style rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.code import length_px

# fixed values of the checks
RESETS = ("*", "*::before", "*::after", "*:before", "*:after", "html", "body", ":root", ":before", ":after")
PSEUDO = ":(hover|active|focus|disabled|visited|first-child|last-child|nth-child|placeholder)"
SHRINKING = ("msg", "chat", "text", "content", "body", "item", "row", "col", "card", "feed", "wrapper", "container")
COLLECTIONS = (
    "button", "btn", "tag", "badge", "chip", "tab", "page", "pagination", "action", "item", "list", "toolbar", "menu",
    "group", "pill", "link", "nav", "control", "controls", "card", "cards", "row", "options",
)
DYNAMIC_TEXT = (
    "msg-body", "sys-text", "convo-a", "convo-q", "toast-text", "agent-convo", "comment-body", "user-bio", "post-body",
    "description", "summary", "article", "p", "textarea",
)
COMPACT = (
    "btn", "button", "tab", "badge", "select", "header", "footer", "nav", "bar", "icon", "avatar", "trigger", "arrow",
    "toggle", "checkbox", "radio", "input", "slider",
)

PROPERTIES = (
    "display", "flex", "flex-grow", "flex-shrink", "flex-direction", "flex-wrap", "min-width", "min-height", "overflow",
    "overflow-x", "overflow-y", "word-break", "overflow-wrap", "text-overflow", "z-index", "isolation", "position", "width",
    "height", "max-width", "grid-template-columns",
)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def _controls(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, (_any(F.col(c), ("hidden", "auto", "scroll")) for c in cols))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with one lower-case column per property that a check reads, without resets; ``low`` is the selector in lower case."""
    props = [F.lower(F.coalesce(F.col("properties")[p], F.lit(""))).alias(p.replace("-", "_")) for p in PROPERTIES]
    rows = rules.select(F.col("css_file").alias("file"), F.trim("selector").alias("selector"), "classes", "start_line", "end_line", F.coalesce("media_query", F.lit("")).alias("media"), *props)
    rows = rows.withColumn("low", F.lower("selector"))
    return rows.where(~F.col("low").isin(*RESETS) & ~F.col("low").startswith("*"))


Check = tuple[Column, Column, str, Column, str]  #: condition, severity, category, message, advice


def _plain() -> Column:
    return ~F.col("low").rlike(PSEUDO)


def _issue(check: Check) -> Column:
    """A struct where the check hits, else null."""
    condition, severity, category, message, advice = check
    return F.when(condition, F.struct(severity.alias("severity"), F.lit(category).alias("category"), message.alias("message"), F.lit(advice).alias("recommendation")))


def _issues(rows: DataFrame, *checks: Check) -> DataFrame:
    """The issues of all checks in one pass over the rules."""
    found = rows.select("file", "start_line", "end_line", "selector", F.explode(F.filter(F.array(*map(_issue, checks)), lambda x: x.isNotNull())).alias("i"))
    return found.select("i.severity", "file", "start_line", "end_line", "selector", "i.category", "i.message", "i.recommendation")


def ancestors(components: DataFrame, depth: int = 6) -> DataFrame:
    """``child, parent``: classes and those of the up to ``depth`` class attributes before them in a file.

    Row by row with array functions, so a file is never shuffled.
    """
    # fixed value: what counts as a class attribute
    values = F.regexp_extract_all("content", F.lit(r"(?:className|class)\s*=\s*[\"'`]?([^\"'`>]+)[\"'`]?"), 1)
    sets = F.filter(F.transform(values, lambda v: F.array_distinct(F.regexp_extract_all(v, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_-]*\b"), 0))), lambda s: F.size(s) > 0)
    rows = components.select(sets.alias("s"))
    near = F.transform("s", lambda x, i: F.struct(x.alias("c"), F.array_distinct(F.flatten(F.slice(F.col("s"), F.greatest(i - depth + 1, F.lit(1)), F.least(i, F.lit(depth))))).alias("p")))
    pairs = rows.select(F.explode(near).alias("n")).select(F.explode("n.c").alias("child"), F.col("n.p").alias("p"))
    return pairs.select("child", F.explode("p").alias("parent")).distinct()


def mitigated_classes(rows: DataFrame) -> DataFrame:
    """``cls``: classes of rules that control overflow, in the whole project."""
    return rows.where(_controls("overflow", "overflow_x", "overflow_y")).select(F.explode("classes").alias("cls")).distinct()


def with_mitigation(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``by_file`` (another selector of the file controls overflow and is named in this one) and ``by_parent``.

    The mitigating selectors of a file travel as one list per file.
    """
    inside = rows.where(_controls("overflow", "overflow_x")).groupBy("file").agg(F.collect_set("selector").alias("_mits"))
    names = lambda m: F.contains(F.col("selector"), m) | F.exists(F.split(m, r"\s+"), lambda w: (w != "") & F.contains(F.col("selector"), w))
    by_file = F.coalesce(F.exists("_mits", lambda m: (m != F.col("selector")) & names(m)), F.lit(False))
    rows = rows.join(inside, "file", "left").withColumn("by_file", by_file).drop("_mits").withColumn("_id", F.struct("file", "selector", "start_line", "end_line", "media"))
    safe = parents.join(mitigated_classes(rows).withColumnRenamed("cls", "parent"), "parent", "left_semi").groupBy("child").agg(F.min("parent").alias("parent"))
    held = rows.select("_id", F.explode("classes").alias("child")).join(safe, "child").groupBy("_id").agg(F.min("parent").alias("by_parent"))
    return rows.join(held, "_id", "left").drop("_id")


def _softened(normal: str) -> Column:
    return F.when(F.col("by_file") | F.col("by_parent").isNotNull(), "INFO").otherwise(normal)


def _why() -> Column:
    return F.when(F.col("by_parent").isNotNull(), F.concat(F.lit(" (held by ."), "by_parent", F.lit(")"))).when(F.col("by_file"), " (held by a container of this file)").otherwise("")


def _flex_overflow() -> Check:
    box = _any(F.col("display"), ("flex", "grid")) | (F.col("flex") != "") | F.col("flex_grow").isin("1", "2", "3") | F.contains("low", F.lit("flex"))
    fixed = F.col("width").endswith("px") & F.col("height").endswith("px")
    stiff = (F.col("flex_shrink") == "0") | F.contains("flex", F.lit("0 0 ")) | (F.col("flex") == "none")
    free = F.col("min_width").isin("0", "0px", "0%", "none") | F.col("min_height").isin("0", "0px", "0%", "none") | _controls("overflow", "overflow_x", "overflow_y")
    message = F.concat(F.lit("flex box '"), "selector", F.lit("' sets neither min-width: 0 nor overflow: hidden"), _why())
    return box & ~stiff & ~fixed & ~free & _any(F.col("low"), SHRINKING), _softened("CRITICAL"), "Flexbox/Grid Overflow Risk", message, "add min-width: 0 or overflow: hidden"


def _flex_wrap() -> Check:
    fixed = F.col("width").endswith("px") & F.col("height").endswith("px")
    hit = F.contains("display", F.lit("flex")) & ~F.contains("flex_direction", F.lit("column")) & _any(F.col("low"), COLLECTIONS) & ~F.col("flex_wrap").isin("wrap", "wrap-reverse") & ~_controls("overflow", "overflow_x", "overflow_y") & ~fixed
    message = F.concat(F.lit("horizontal flex box '"), "selector", F.lit("' neither wraps nor scrolls"), _why())
    return _plain() & hit, _softened("WARNING"), "Flex Wrap Overflow Risk", message, "add flex-wrap: wrap or overflow-x: auto"


def _breakpoint_width() -> Check:
    number = F.regexp_extract("media", r"(?i)max-width\s*:\s*([\d.]+)\s*(?:px|rem|em)", 1)
    limit = length_px(F.concat(number, F.regexp_extract("media", r"(?i)max-width\s*:\s*[\d.]+\s*(px|rem|em)", 1)))
    columns = F.aggregate(F.regexp_extract_all("grid_template_columns", F.lit(r"([\d.]+)\s*px"), 1), F.lit(0.0), lambda a, x: a + F.coalesce(F.when(x.rlike(r"^\d+(\.\d*)?$|^\.\d+$"), x.cast("double")), F.lit(0.0)))
    width = F.greatest(F.coalesce(length_px(F.col("min_width")), F.lit(0.0)), F.coalesce(length_px(F.col("width")), F.lit(0.0)), columns)
    message = F.concat(F.lit("'"), "selector", F.lit("' asks for "), F.round(width).cast("long").cast("string"), F.lit("px where the breakpoint allows "), F.round(limit).cast("long").cast("string"), F.lit("px"))
    return _plain() & limit.isNotNull() & (width > 0) & (width >= limit), F.lit("WARNING"), "Breakpoint Width Overflow", message, "use relative widths within this breakpoint"


def _text_break() -> Check:
    broken = F.col("word_break").isin("break-word", "break-all") | F.col("overflow_wrap").isin("break-word", "anywhere") | F.contains("text_overflow", F.lit("ellipsis"))
    hit = _plain() & _any(F.col("low"), DYNAMIC_TEXT) & ~_any(F.col("low"), COMPACT) & ~broken
    return hit, F.lit("WARNING"), "Text Break Risk", F.concat(F.lit("text box '"), "selector", F.lit("' has no rule for long words")), "add overflow-wrap: break-word"


def _fixed_width() -> Check:
    digits = F.regexp_replace("width", "[^0-9]", "")
    hit = _plain() & F.col("width").endswith("px") & (F.col("max_width") == "") & F.when(digits.rlike(r"^\d{1,18}$"), digits.cast("long") > 400).otherwise(F.length(digits) > 18)
    return hit, F.lit("WARNING"), "Fixed Width Responsive Risk", F.concat(F.lit("'"), "selector", F.lit("' is "), "width", F.lit(" wide at any screen size")), "add max-width: 100%"


def _z_index() -> Check:
    digits = F.regexp_replace("z_index", "[^0-9-]", "")
    value = F.when(digits.rlike(r"^-?\d{1,18}$"), digits.cast("long"))
    hit = _plain() & (value >= 100) & (F.col("isolation") != "isolate") & ~F.col("position").isin("relative", "absolute", "fixed", "sticky")
    return hit, F.lit("INFO"), "Z-Index Stacking Conflict", F.concat(F.lit("'"), "selector", F.lit("' sets z-index "), value.cast("string"), F.lit(" outside a stacking context")), "add isolation: isolate"


def flex_overflow(rows: DataFrame) -> DataFrame:
    """Flex or grid boxes that cannot shrink below their content."""
    return _issues(rows, _flex_overflow())


def flex_wrap(rows: DataFrame) -> DataFrame:
    """Horizontal flex boxes of many items that do not wrap."""
    return _issues(rows, _flex_wrap())


def breakpoint_width(rows: DataFrame) -> DataFrame:
    """Widths within a max-width media query that reach its limit."""
    return _issues(rows, _breakpoint_width())


def text_break(rows: DataFrame) -> DataFrame:
    """Boxes of running text without a rule for long words. ``p`` counts as a substring of any selector."""
    return _issues(rows, _text_break())


def fixed_width(rows: DataFrame) -> DataFrame:
    """P5: widths over 400 px without a maximum. Digits are read in a row, so 450.5px counts as 4505."""
    return _issues(rows, _fixed_width())


def z_index(rows: DataFrame) -> DataFrame:
    """A high z-index without a stacking context."""
    return _issues(rows, _z_index())


def audit(rules: DataFrame, parents: DataFrame, severity: str = "ALL", files: str | None = None) -> DataFrame:
    """All issues, CRITICAL first, then by file and line (H4). ``files``: substrings parted by commas, any of which counts."""
    rows = with_mitigation(prepared(rules), parents)
    if files:
        wanted = [x.strip().lower() for x in files.split(",") if x.strip()]
        rows = rows.where(_any(F.lower("file"), tuple(wanted))) if wanted else rows
    found = _issues(rows, _flex_overflow(), _flex_wrap(), _breakpoint_width(), _text_break(), _fixed_width(), _z_index())
    if severity.upper() != "ALL":
        found = found.where(F.col("severity") == severity.upper())
    order = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return found.orderBy(order, "file", "start_line", "category", "selector")
