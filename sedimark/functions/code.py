"""Column functions over code and text, all within the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes of class names and what they stand for, first match in this order
CATEGORIES = {
    "Controller": "Controllers", "Service": "Services", "Guard": "Guards", "Module": "Modules", "Interceptor": "Interceptors",
    "Filter": "Filters", "Pipe": "Pipes", "Decorator": "Decorators", "Component": "Components", "Directive": "Directives",
    "Resolver": "Resolvers", "Repository": "Repositories", "Factory": "Factories", "Strategy": "Strategies",
    "Middleware": "Middlewares", "Provider": "Providers", "Context": "Contexts",
}
# fixed values: the order in which categories are shown; others follow alphabetically
CATEGORY_ORDER = [
    "Components", "Directives", "Pipes", "Controllers", "Services", "Guards", "Resolvers", "Modules", "Interceptors",
    "Filters", "Middlewares", "Repositories", "Factories", "Strategies", "Decorators", "Other",
]
# fixed values: icon classes of other libraries
ICON_PREFIXES = ("fa-", "fas-", "far-", "fab-", "bi-", "icon-", "material-")
ICON_NAMES = ("fa", "fas", "far", "fab", "fa-solid", "fa-regular", "fa-brand")


def strip(c: Column) -> Column:
    """Without white space at both ends; ``trim`` alone leaves tabs and line ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a final line end begins no further line (readlines semantics)."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: what ``\\s`` matches; trimming by a set of characters is far cheaper per line than a pattern
BLANKS = " \t\n\r\f\x0b"


def _counted(text: Column, marks: tuple[str, ...]) -> Column:
    begins = lambda t: F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: t.startswith(m))
    return F.size(F.filter(F.transform(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(BLANKS))), lambda t: (t != "") & ~begins(t)))


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor begin as a comment (``//``, ``#``, ``/*``, ``*``)."""
    return _counted(text, ("//", "#", "/*", "*"))


def css_code_lines(text: Column) -> Column:
    """The same for style sheets, where ``#`` begins a selector."""
    return _counted(text, ("/*", "*", "//"))


def extension(source: Column) -> Column:
    """Lower-case suffix with its dot, or ``unknown``."""
    found = F.lower(F.regexp_extract(source, r"[^/.](\.[^./]*)$", 1))
    return F.when(found.isin("", "."), "unknown").otherwise(found)


def short_path(source: Column) -> Column:
    """The last two segments."""
    return F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -2)


def class_category(name: Column) -> Column:
    """The category of a class by its suffix, else ``Other``."""
    out = F.lit("Other")
    for suffix, category in reversed(CATEGORIES.items()):
        out = F.when(name.endswith(suffix), category).otherwise(out)
    return out


def is_vendor_icon(name: Column) -> Column:
    """Whether a class belongs to an icon library."""
    low = F.lower(name)
    return low.rlike("^(" + "|".join(ICON_PREFIXES) + ")") | low.isin(*ICON_NAMES)


def risk_level(code: Column, total: Column, warn_at: int = 200) -> Column:
    """CRITICAL from 400 code lines, WARNING from ``warn_at``, else OK; total lines stand in where code lines are 0."""
    judged = F.when(code > 0, code).otherwise(total)
    return F.when(judged >= 400, "CRITICAL").when(judged >= warn_at, "WARNING").otherwise("OK")


def comment_only(text: Column, suffix: Column) -> Column:
    """Whether nothing is left without comments and white space, by suffix (C15). Other suffixes: only when blank."""
    block = r"(?s)/\*.*?\*/"
    bare = (
        F.when(suffix.isin(".ts", ".js"), F.regexp_replace(F.regexp_replace(text, block, ""), "//[^\n]*", ""))
        .when(suffix == ".prisma", F.regexp_replace(text, "//[^\n]*", ""))
        .when(suffix == ".html", F.regexp_replace(text, r"(?s)<!--.*?-->", ""))
        .when(suffix == ".css", F.regexp_replace(text, block, ""))
        .otherwise(text)
    )
    return ~bare.rlike(r"\S")


def xml_escape(text: Column) -> Column:
    """Without control and format characters but line ends and tabs; markup characters as entities (C20)."""
    out = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\r\t]]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def compress_code(text: Column, suffix: Column) -> Column:
    """Without whole-line comments (tool directives stay), trailing blanks and repeated blank lines."""
    # fixed values below: suffixes, comment marks and the directives that stay
    script = suffix.isin(".ts", ".js", ".tsx", ".prisma")
    around = lambda t, a, b: t.startswith(a) & t.endswith(b)
    gone = lambda t: (
        F.when(script, (t.startswith("//") & ~t.rlike(r"^//\s*@(ts-|eslint-|ng)")) | (around(t, "/*", "*/") & (F.length(t) > 3)))
        .when(suffix == ".py", t.startswith("#") & ~t.rlike(r"^#\s*(type:|pylint:|coding:)"))
        .when(suffix.isin(".html", ".htm"), around(t, "<!--", "-->") & (F.length(t) > 6))
        .otherwise(F.lit(False))
    )
    kept = F.transform(F.filter(lines(text), lambda x: ~gone(F.trim(x, F.lit(BLANKS)))), lambda x: F.rtrim(x, F.lit(BLANKS)))
    # runs of blank lines by patterns on the joined text: a lambda that looks at its neighbours would be quadratic
    joined = F.array_join(kept, "\n")
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "\n{3,}", "\n\n"), "^\n{2,}", "\n"), "\n{2,}\\z", "\n")
    return F.when(joined.rlike("^\n*\\z"), "").otherwise(single)


def truncate_safe(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut behind the last closing tag of a block, with a marker."""
    head = F.substring(text, 1, limit)
    # fixed values: the tags that close a block
    ends = [F.when(F.contains(head, F.lit(tag)), limit - F.locate(tag[::-1], F.reverse(head)) + 2) for tag in ("</file>", "</imported_file>", "</related_model>")]
    cut = F.coalesce(F.array_max(F.array(*ends)), F.lit(limit + 1)) - 1
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), cut), F.lit("\n[TRUNCATED]")))


# -- HTML (C9) ---------------------------------------------------------------------------------------------------------

# fixed values: what counts as an element name, a class attribute and a bound class
_TOKEN = r"^[a-zA-Z_][A-Za-z0-9_-]*$"


def html_tags(html: Column) -> Column:
    """Element names in order of appearance, with repeats."""
    return F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)"), 1)


def html_classes(html: Column) -> Column:
    """Classes of class attributes, framework bindings included, without interpolations; sorted and distinct."""
    attribute = r"(?:className|class|\[ngClass\]|:class)\s*=\s*"
    values = F.concat(F.regexp_extract_all(html, F.lit(attribute + '"([^">]+)"'), 1), F.regexp_extract_all(html, F.lit(attribute + "'([^'>]+)'"), 1))
    words = F.flatten(F.transform(values, lambda v: F.split(F.regexp_replace(v, r"\$?\{[^}]+\}", " "), r"\s+")))
    bound = F.concat(F.regexp_extract_all(html, F.lit(r"\[class\.([a-zA-Z0-9_-]+)\]"), 1), F.regexp_extract_all(html, F.lit(r"class:([a-zA-Z0-9_-]+)"), 1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, bound), lambda w: w.rlike(_TOKEN))))


def html_directives(html: Column) -> Column:
    """Elements whose names hold a hyphen; sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(html_tags(html), lambda t: F.contains(t, F.lit("-")))))


def html_metadata(html: Column) -> Column:
    """``tags`` (element names and classes), ``dependencies`` (script and link addresses), ``title``, ``directives``."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"), 1)
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.struct(
        F.array_sort(F.array_union(html_tags(html), html_classes(html))).alias("tags"),
        F.array_distinct(F.concat(scripts, links)).alias("dependencies"),
        strip(F.regexp_extract(html, r"(?is)<title[^>]*>\s*(\S.*?)</title>", 1)).alias("title"),
        html_directives(html).alias("directives"),
    )


# -- CSS (C10) ---------------------------------------------------------------------------------------------------------


# fixed values below: what counts as a class, a custom property and a directive of a style sheet
def _bare_css(css: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(css, r"(?s)/\*.*?\*/", ""), r"url\([^)]+\)", "")


def css_classes(css: Column) -> Column:
    """Classes that selectors name; sorted and distinct. As ever, ``.a{`` without a blank is not seen."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_bare_css(css), F.lit(r"(?<![\d.])\.([a-zA-Z_][a-zA-Z0-9_-]*)(?=[ \t\r\n.:,>+~\[]|\z)"), 1)))


def css_variables(css: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_bare_css(css), F.lit(r"(--[a-zA-Z0-9_-]+)"), 1)))


def css_directives(css: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_bare_css(css), F.lit(r"(@[a-zA-Z0-9_-]+(?:\s+[A-Za-z0-9_-]+)?)"), 1)))


def length_px(value: Column) -> Column:
    """Pixels of a length in ``px``, ``rem`` or ``em``; null for anything else."""
    number = F.regexp_extract(strip(value), r"(?i)^([\d.]+)\s*(?:px|rem|em)$", 1)
    unit = F.lower(F.regexp_extract(strip(value), r"(?i)^[\d.]+\s*(px|rem|em)$", 1))
    plain = number.rlike(r"^\d+(\.\d*)?$|^\.\d+$")
    return F.when(plain, number.cast("double") * F.when(unit == "px", F.lit(1.0)).otherwise(F.lit(16.0)))
