"""Text of results for people and prompts (K1-K6). Inputs are small: a few blocks or a report."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions import code


def file_blocks(blocks: DataFrame, compressed: bool = True) -> DataFrame:
    """``block``: each fused block as an escaped element (K1)."""
    suffix = code.extension(F.col("source"))
    body = code.compress_code(F.col("content"), suffix) if compressed else F.col("content")
    mark = ' compressed="true"' if compressed else ""
    text = F.concat(F.lit('<file path="'), code.xml_escape(F.col("source")), F.lit('" start_line="'), F.col("start_line").cast("string"), F.lit('" end_line="'), F.col("end_line").cast("string"), F.lit(f'"{mark}>\n'), code.xml_escape(body), F.lit("\n</file>"))
    return blocks.withColumn("block", text)


def related_blocks(found: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``block``: enrichment files (``file, branch, target, content``) as elements, contents cut at ``max_chars`` (K2)."""
    head = F.substring("content", 1, max_chars)
    kind = F.when(F.col("branch") == 0, "import").otherwise("dependency")
    imported = F.concat(F.lit('<imported_file path="'), code.xml_escape(F.col("file")), F.when(F.col("branch") == 1, F.concat(F.lit('" dependency_class="'), code.xml_escape(F.col("target")))).otherwise(""), F.lit('" relation_type="'), kind, F.lit('">\n'), code.xml_escape(head), F.lit("\n</imported_file>"))
    model = F.concat(F.lit('<related_model name="'), code.xml_escape(F.col("target")), F.lit('" source_file="'), code.xml_escape(F.col("file")), F.lit('">\n'), code.xml_escape(head), F.lit("\n</related_model>"))
    return found.withColumn("block", F.when(F.col("branch") == 2, model).otherwise(imported))


def context(blocks: list[str]) -> str:
    """The wrapper that a prompt carries (K3)."""
    return "<context>\n" + "\n".join(blocks) + "\n</context>"


def prompt(query: str, text: str) -> str:
    return f"Answer from the context alone; say so where it does not hold the answer.\n\n{text}\n\nQuestion: {query}"


def result_header(rows: list[dict]) -> str:
    files = {r["source"] for r in rows}
    spans = ", ".join(f"{r['source']}:{r['start_line']}-{r['end_line']}" for r in rows)
    return f"{len(files)} files: {spans}"


def metrics_text(report: dict) -> str:
    if report["status"] != "OK":
        return f"{report['status']}: the index holds no files"
    s = report["summary"]
    out = [f"{s['total_files']} files, {s['total_lines_codebase']} lines, {s['files_exceeding_threshold']} of {s['min_lines_threshold']} lines or more"]
    out += [f"  {r['risk_level']:<8} {r['lines_total']:>6} {r['source']}" for r in report["exceeding_files"]]
    out += [f"  {ext}: {v['file_count']} files, {v['total_lines']} lines" for ext, v in report["by_extension"].items()]
    return "\n".join(out)


def map_text(rows: list[dict], files: dict[str, int], models: list[str]) -> str:
    out = [f"{sum(files.values())} files"]
    for scope, group in groupby(rows, key=lambda r: r["scope"]):
        out.append(f"[{scope}] {files.get(scope, 0)} files")
        out += [f"  {r['category']} ({r['n']}): {r['classes']}" for r in group]
    if models:
        out.append("models: " + ", ".join(models))
    return "\n".join(out)


def audit_text(report: dict) -> str:
    counts = {s: sum(1 for i in report["issues"] if i["severity"] == s) for s in ("CRITICAL", "WARNING", "INFO")}
    out = [f"{report['total_issues']} issues: " + ", ".join(f"{n} {s}" for s, n in counts.items())]
    out += [f"{i['severity']:<8} {i['file']}:{i['start_line']} [{i['category']}] {i['message']} -> {i['recommendation']}" for i in report["issues"]]
    return "\n".join(out)


def styles_text(report: dict) -> str:
    out = [f"{f}: {len(x['classes'])} classes, {len(x['variables'])} variables" for f, x in report["files"].items()]
    out += [f"unused in {f}: " + ", ".join(c) for f, c in report["unused"].items()]
    out += [f"{r['component']} .{r['cls']} -> {r['css_file']}:{r['start_line']} {r['selector']}" for r in report["trace"]]
    out += [f"{r['css_file']}:{r['start_line']} {r['selector']} {r['matching']}" for r in report["property_matches"][:50]]
    return "\n".join(out)
