"""Files that nobody of the repository wrote by hand: generated, minified, vendored files and bulk data.

1. *Declared.* ``.gitattributes`` files are parsed into rules (``linguist-generated``, ``linguist-vendored``, set,
   unset or given a value). For a path the rules of the nearest folder win, within a file the last matching line. A
   declaration is final, also one that says a file is not generated.
2. *Evidence.* Each file is read once: notices in its comments (text in strings is content and does not count), dense
   unspaced lines, literals and little else, the same declaration over and over with a serial number.
3. *Mining.* Path patterns (a folder name, two nested folder names, an infix such as ``.min.``) are scored over all
   files: how many files they mark and how many of these show evidence or carry the name of a package that vendoring
   notices name somewhere. Patterns with enough support and precision become rules; conventional names are rules
   unless the files refute them, and at a repository's top level (where ``vendor`` may be a module of that name) only
   if the files confirm them.
4. The mined rules are applied to the repositories that declare nothing of the kind; what they do not reach is judged
   by its own evidence.

The evidence table holds no text and is materialised once; all later steps are equi joins on short strings. Nothing is
collected to the driver.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.files import file_pieces, map_files
from sedimark.session import cut_lineage

GENERATED, MINIFIED, VENDORED, DATA = "generated", "minified", "vendored", "data"

#: conventional folder names and file-name infixes (fixed values), with what they stand for
CONVENTIONAL = {
    "dir:node_modules": VENDORED, "dir:bower_components": VENDORED, "dir:third_party": VENDORED, "dir:third-party": VENDORED,
    "dir:thirdparty": VENDORED, "dir:3rdparty": VENDORED, "dir:3rd-party": VENDORED, "dir:vendored": VENDORED, "dir:vendor": VENDORED,
    "dir:vendors": VENDORED, "dir:external-libs": VENDORED, "dir:externals": VENDORED, "dir:extern": VENDORED, "dir:site-packages": VENDORED,
    "dir:__generated__": GENERATED, "dir:generated": GENERATED, "dir:codegen-output": GENERATED, "dir:autogen": GENERATED, "dir:_generated": GENERATED,
    "end:_pb2": GENERATED, "end:.pb": GENERATED, "end:_generated": GENERATED, "end:-generated": GENERATED, "end:_pb2_grpc": GENERATED,
    "infix:min": MINIFIED, "infix:gen": GENERATED, "infix:generated": GENERATED, "infix:pb": GENERATED, "infix:g": GENERATED, "infix:bundle": MINIFIED,
}

# -- attribute files ---------------------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> re.Pattern:
    """The regular expression of an attribute pattern, for paths relative to the attribute file's folder."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return re.compile(("" if anchored else "(?:[^/]+/)*") + "".join(out) + r"\Z")


def parse_attributes(text: str) -> list[tuple[re.Pattern, str, bool | None]]:
    """The rules of an attribute file in order: (pattern, generated or vendored, set / unset / unspecified)."""
    out = []
    for line in (text or "").splitlines():
        parts = line.split()
        if not parts or parts[0].startswith(("#", "[attr]", "!")):
            continue
        for attribute in parts[1:]:
            name = attribute.lstrip("-!").split("=", 1)[0]
            kind = {"linguist-generated": GENERATED, "linguist-vendored": VENDORED}.get(name)
            if kind is None:
                continue
            value = None if attribute[0] == "!" else not (attribute[0] == "-" or attribute.lower().endswith("=false"))
            out.append((glob_regex(parts[0]), kind, value))
    return out


def declared(path: str, files: list[tuple[str, list]]) -> dict[str, bool]:
    """What attribute files say about ``path``. ``files``: (folder, rules), of which folders that hold the path count,
    the outer ones first, so that nearer ones and later lines override."""
    out: dict[str, bool] = {}
    for folder, rules in sorted(files, key=lambda x: len(x[0])):
        if folder and not path.startswith(folder + "/"):
            continue
        inner = path[len(folder) + 1 :] if folder else path
        for pattern, kind, value in rules:
            if pattern.match(inner):
                if value is None:
                    out.pop(kind, None)
                else:
                    out[kind] = value
    return out


#: fewer characters of literals are a few settings, which people write; more, with no code beside them, are data
BULK_LITERALS = 400

# -- evidence in a file ------------------------------------------------------------------------------------------------

_C_LIKE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))")
_HASH = re.compile(r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(#[^\n]*)")
_HTML = re.compile(r"(<!--(?:[^-]|-(?!->))*(?:-->|\Z))")
_COMMENTS = {"py": _HASH, "css": _CSS, "html": _HTML}
_STRINGS = re.compile(r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")

_WORDS = ("generat", "generad", "generier", "erzeugt", "générée", "généré", "machine writ", "automatic", "changes will be lost", "do not modify", "do not edit", "contributors", "authors", "copied from", "unchanged from", "verbatim from", "upstream", "copyright", "sourcemappingurl")
_GENERATED = re.compile(
    r"auto-?generated|@generated\b|\bgenerated (?:file|code|by|from|with|using|automatically)|\bmachine[- ](?:generated|written)|\b(?:created|written|produced) automatically|\bautomatically (?:generated|created|written|produced)"
    r"|do not (?:edit|modify|change)\W+(?:this file|output of|generated)|changes will be lost|code generated\b|\bgenerad[oa] autom|autom[aá]ticamente|automatisch (?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée]e? automatiquement|automatiquement g[ée]n[ée]r",
    re.I,
)
_BY_HAND = re.compile(r"\b(?:not|never|once|formerly|originally|previously|initially|no longer|isn't|wasn't) (?:auto-?)?generated|\b(?:maintained|edited|written|kept|changed) by hand since|now maintained by hand|\bmaintained by hand|hand-?written|written and maintained by", re.I)
_VENDORED = re.compile(
    r"copyright\s+(?:\(c\)|©)?\s*\d{4}[-\d, ]*\s*(?:the\s+)?(?:contributors|authors|developers|[\w.-]+ (?:contributors|authors|developers|project))|\(c\)\s+(?:\d{4}[-\d, ]*\s+)?the [\w.-]+ (?:authors|contributors|developers)"
    r"|\bcopied from [\w@/.-]+@v?\d|\b(?:copied|taken|imported) (?:unchanged|verbatim) from\b|\bupstream (?:license|licence|repository|project|release)",
    re.I,
)
_PACKAGE = re.compile(
    r"contributors of ([\w.-]{3,})|\(c\)\s+(?:\d{4}\s+)?the ([\w.-]{3,}) (?:authors|contributors)|copied from ([\w.-]{3,})@|(?:unchanged|verbatim) from ([\w.-]{3,})|^[\W_]*([A-Za-z][\w.-]{2,}) (?:- )?v?\d+\.\d+\.\d+\b",
    re.I | re.M,
)
_LITERALS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b\d[\d._eExXa-fA-F+]*n?\b|\b(?:true|false|null|None|True|False|undefined)\b")
#: a cheap look before all literals are taken out: comments, then an assignment whose value begins with a literal or bracket
_ASSIGNED = re.compile(r"(?:\s|//[^\n]*|#[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"\"\"[\s\S]*?\"\"\")*+(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+)?(?:module\.exports|[A-Za-z_$][\w$]*)?(?:\s*+:\s*+[\w$<>\[\], |]++)?+\s*+=?\s*+[\[({\"'`\d-]")
#: what data files hold none of: calls, functions, types, control flow
_CODE = re.compile(r"=>|[\w$\])]\s*\(|\b(?:function|class|def|return|if|for|while|import|from|new|await|async|lambda|interface|type|enum)\b")
_FRAME_CHARS = re.compile(r"[\w$\s\[\](){},:;.=+*<>|-]*\Z")
_SERIAL = re.compile(r"[A-Za-z_]*?(\d+)[A-Za-z]*\b")
_SERIAL_NAME = re.compile(r"^[^\S\n]*(?:export\s+)?(?:(?:interface|class|function|def|const|enum|type|model)\s+)?\.?([A-Za-z_$][\w$-]*?)(\d+)([A-Za-z_]*)\b", re.M)


def comments_of(text: str, ext: str) -> str:
    return "\n".join(m for m in _COMMENTS.get(ext, _C_LIKE).findall(text) if m)


def notices(text: str, ext: str, scope: str) -> tuple[str, list[str]]:
    """What the comments say: a kind ("" for nothing), and the packages that vendoring notices name."""
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return "", []
    said = comments_of(text, ext)
    if not said:
        return "", []
    if _VENDORED.search(said) and not re.search(rf"\b{re.escape(scope)}\b", said):
        names = [next(x for x in g if x).lower().strip(".") for g in _PACKAGE.findall(said)]
        return VENDORED, names
    if _GENERATED.search(said) and not _BY_HAND.search(said):
        return GENERATED, []
    if "sourcemappingurl=" in said.lower():
        return MINIFIED, []
    return "", []


def dense(text: str) -> bool:
    """Minified: long lines with hardly a blank, full of punctuation."""
    body = [x for x in text.split("\n") if x.strip()]
    if not body:
        return False
    average = sum(map(len, body)) / len(body)
    if average < 110:
        return False
    bare = _STRINGS.sub('""', text)
    if len(bare) < 0.3 * len(text):
        return False
    blanks = sum(map(bare.count, " \t"))
    return blanks / len(bare) < 0.09 and sum(map(bare.count, "{}();:,")) / len(bare) > 0.08


def bulk(text: str, ext: str) -> bool:
    """Nothing but data: an assignment or a few whose right sides are literals, more than ``BULK_LITERALS`` characters of them."""
    if ext in ("css", "html", "prisma") or not _ASSIGNED.match(text):
        return False
    bare = _COMMENTS.get(ext, _C_LIKE).sub(lambda m: "" if m.group(1) else m.group(), text)
    literals = _LITERALS.sub("", bare)
    return len(bare) - len(literals) > BULK_LITERALS and len(re.findall(r"[A-Za-z_$][\w$]*", literals)) <= 12 and not _CODE.search(literals) and bool(_FRAME_CHARS.match(literals))


def serial(text: str) -> bool:
    """Generated: one declaration shape over and over, numbered through, and little beside it."""
    found = _SERIAL_NAME.findall(text)
    if len(found) < 6:
        return False
    numbers = [int(n) for _, n, _ in found if len(n) < 9]
    steps = sum(1 for a, b in zip(numbers, numbers[1:]) if b - a == 1)
    lines = text.count("\n") + 1
    return numbers[:1] in ([0], [1]) and steps >= 0.9 * (len(found) - 1) and steps >= 5 and len(found) >= lines / 14


def evidence(text: str, ext: str, scope: str) -> tuple[str, list[str]]:
    text = text.removeprefix("\ufeff")
    kind, names = notices(text, ext, scope)
    if not kind:
        kind = MINIFIED if dense(text) else DATA if bulk(text, ext) else GENERATED if serial(text) else ""
    return kind, names


# -- the operator ------------------------------------------------------------------------------------------------------


def read_evidence(chunks: DataFrame) -> DataFrame:
    """``source, kind, packages, attributes`` of every file; ``attributes`` is the text of an attribute file, else null."""
    files = file_pieces(chunks.select("source", "start_line", "end_line", "text"))

    def run(sources: list[str], texts: list[str], batch: pa.RecordBatch) -> dict:
        kinds, packages, attributes = [], [], []
        for source, text in zip(sources, texts):
            name = source.rsplit("/", 1)[-1]
            own = name == ".gitattributes"
            kind, named = ("", []) if own else evidence(text, name.rsplit(".", 1)[-1].lower(), source.split("/", 1)[0])
            kinds.append(kind)
            packages.append(named)
            attributes.append(text if own else None)
        return {"source": sources, "kind": kinds, "packages": pa.array(packages, pa.list_(pa.string())), "attributes": pa.array(attributes, pa.string())}

    return map_files(files, run, "source string, kind string, packages array<string>, attributes string")


def path_features(source) -> tuple:
    """The patterns of a path: folder names (those of the first two levels marked as such), nested pairs, infixes, ends of stems."""
    parts = F.split(source, "/")
    dirs = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    named = F.transform(dirs, lambda x, i: F.concat(F.when(i < 2, "top:").otherwise("dir:"), x))
    pairs = F.transform(F.slice(dirs, F.lit(2), F.greatest(F.size(dirs), F.lit(0))), lambda x, i: F.concat(F.lit("pair:"), F.element_at(dirs, i + 1), F.lit("/"), x))
    infix = F.split(F.element_at(parts, -1), r"\.")
    infixes = F.transform(F.slice(infix, 2, F.greatest(F.size(infix) - 2, F.lit(0))), lambda x: F.concat(F.lit("infix:"), x))
    end = F.regexp_extract(infix[0], r"([-_][A-Za-z0-9]+)$", 1)
    ends = F.when(end != "", F.array(F.concat(F.lit("end:"), end))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named, pairs, infixes, ends))


def mined_patterns(seen: DataFrame, support: int = 3, precision: float = 0.8, refuted_at: int = 20, refuted_below: float = 0.25) -> DataFrame:
    """``feature, files, marked, kind``: the path patterns that stand for a kind of file, from evidence and convention.

    ``seen`` is the evidence table. Per pattern the counts are combined before the shuffle, so a folder name that a
    third of all files share is no hot group.
    """
    names = seen.select(F.explode("packages").alias("word")).where(F.length("word") > 2).distinct()
    words = F.array_distinct(F.concat(F.slice(F.split("source", "/"), F.lit(4), F.size(F.split("source", "/"))), F.split(F.element_at(F.split("source", "/"), -1), "[-_.]")))
    carrying = seen.where("kind = ''").select("source", F.explode(words).alias("word")).join(names, "word", "left_semi").select("source").distinct().withColumn("carries", F.lit(VENDORED))
    marked = seen.join(carrying, "source", "left").select(F.explode(path_features(F.col("source"))).alias("feature"), F.when(F.col("kind") != "", F.col("kind")).otherwise(F.col("carries")).alias("k"), F.substring_index("source", "/", 1).alias("scope"))
    count = lambda c: F.sum(c.cast("int"))
    kinds = [GENERATED, MINIFIED, VENDORED, DATA]
    scored = marked.groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.count("k").alias("marked"), (F.min("scope") != F.max("scope")).alias("several"), *(count(F.coalesce(F.col("k") == k, F.lit(False))).alias(k) for k in kinds))
    share = F.col("marked") / F.col("files")
    most = F.greatest(*kinds)
    mined = (F.col("files") >= support) & (share >= precision) & F.col("several")  # one repository's folder is no rule for others
    known = F.lit(None).cast("string")
    for feature, kind in CONVENTIONAL.items():
        known = F.when(F.col("feature") == feature, kind).otherwise(known)
    held = known.isNotNull() & ~((F.col("files") >= refuted_at) & (share < refuted_below))
    kind = F.coalesce(known, F.when(most == F.col(VENDORED), VENDORED).when(most == F.col(GENERATED), GENERATED).when(most == F.col(MINIFIED), MINIFIED).otherwise(DATA))
    return scored.where(mined | held).select("feature", "files", "marked", kind.alias("kind"))


def declarations(seen: DataFrame) -> DataFrame | None:
    """``source, generated, vendored``: what attribute files say of the files that they speak of; None where none speaks.

    A file meets the attribute files by its folder and those above it, so no repository's rules travel as a whole, and
    a folder's rules are parsed once per batch. The nearest folder that says something about a kind decides it.
    """
    folder = F.when(F.col("source").contains("/"), F.regexp_replace("source", "/[^/]*$", "")).otherwise("")
    lines = F.array_join(F.filter(F.split("attributes", r"\r?\n"), lambda x: x.rlike("linguist-(?:generated|vendored)")), "\n")
    rules = seen.where("attributes is not null").select(folder.alias("folder"), lines.alias("rules")).where("rules != ''")
    if rules.isEmpty():
        return None
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = seen.where("attributes is null").select("source", F.explode(above).alias("folder")).join(rules, "folder")

    def match(batches):
        parsed: dict[str, list] = {}
        for batch in batches:
            folders, sources, texts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for place, source, text in zip(folders, sources, texts):
                if text not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[text] = parse_attributes(text)
                inner = source[len(place) + 1 :] if place else source
                last: dict[str, bool | None] = {}
                for pattern, kind, value in parsed[text]:
                    if pattern.match(inner):
                        last[kind] = value
                out += [(source, len(place), kind, value) for kind, value in last.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.bool_()))], ["source", "depth", "kind", "value"])

    said = near.select("folder", "source", "rules").mapInArrow(match, "source string, depth int, kind string, value boolean")
    nearest = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("depth", "value")))["value"]
    return said.groupBy("source").agg(nearest(GENERATED).alias(GENERATED), nearest(VENDORED).alias(VENDORED)).where(F.col(GENERATED).isNotNull() | F.col(VENDORED).isNotNull())


def judge_origin(chunks: DataFrame) -> DataFrame:
    """``source, scope, kind, why`` of every file but attribute files; ``kind`` is null for hand-written ones.

    ``why`` is ``declared``, the path pattern or ``content``. An empty file is hand-written; rows with a null source
    belong to no file; repeated rows count once.
    """
    seen = cut_lineage(read_evidence(chunks))
    scope = F.substring_index("source", "/", 1)
    patterns = mined_patterns(seen.where("attributes is null"))
    files = seen.where("attributes is null").select("source", scope.alias("scope"), F.when(F.col("kind") != "", F.col("kind")).alias("content"))
    hits = files.select("source", F.explode(path_features(F.col("source"))).alias("feature")).join(patterns.select("feature", F.col("kind").alias("k")), "feature")
    by_path = hits.groupBy("source").agg(F.min(F.struct("k", "feature")).alias("path"))
    rows = files.join(by_path, "source", "left")
    said = declarations(seen)
    if said is None:
        rows = rows.select("*", F.lit(None).cast("boolean").alias(GENERATED), F.lit(None).cast("boolean").alias(VENDORED), F.lit(False).alias("declares"))
    else:
        speaking = said.select(scope.alias("scope")).distinct().withColumn("declares", F.lit(True))
        rows = rows.join(said, "source", "left").join(speaking, "scope", "left").withColumn("declares", F.coalesce("declares", F.lit(False)))
    yes, no = F.col(GENERATED) | F.col(VENDORED), F.col(GENERATED).isNotNull() | F.col(VENDORED).isNotNull()
    by_pattern = F.col("path").isNotNull() & ~F.col("declares")
    kind = F.when(F.col(GENERATED), GENERATED).when(F.col(VENDORED), VENDORED).when(no, None).when(by_pattern, F.col("path.k")).otherwise(F.col("content"))
    why = F.when(F.coalesce(yes, F.lit(False)) | no, "declared").when(by_pattern, F.col("path.feature")).when(F.col("content").isNotNull(), "content")
    return rows.select("source", "scope", kind.alias("kind"), why.alias("why"))
