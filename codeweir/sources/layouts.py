"""Payloads of unlike layouts in one pass: JSON is parsed once, to VARIANT, and a layout says where
a tool keeps its items and their fields. A raw table of any tools is read once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.operators.findings import completed


@dataclass(frozen=True)
class Layout:
    """items: path of the array of items. Paths of an item's fields: text unless said otherwise;
    line_from: what lines are counted from."""

    items: str
    file: str
    line: str
    title: str
    message: str
    severity: str = ""
    category: str = "correctness"
    line_from: int = 1
    severities: dict[str, str] = field(default_factory=dict)
    other: str = "medium"


# Where tools keep what they found.
LAYOUTS = {
    "gitleaks": Layout("$", "$.File", "$.StartLine", "$.RuleID", "$.Description", category="security", other="critical"),
    "semgrep": Layout("$.results", "$.path", "$.start.line", "$.check_id", "$.extra.message", "$.extra.severity", "security", severities={"ERROR": "high", "WARNING": "medium"}, other="low"),
    "pyright": Layout("$.generalDiagnostics", "$.file", "$.range.start.line", "$.rule", "$.message", "$.severity", line_from=0, severities={"error": "high", "warning": "medium"}, other="low"),
    "ruff": Layout("$", "$.filename", "$.location.row", "$.code", "$.message"),
    "deptry": Layout("$", "$.location.file", "$.location.line", "$.error.code", "$.error.message", category="dependencies"),
}


def _by_source(layouts: dict[str, Layout], make) -> Column:
    """The column that make gives for a row's layout."""
    found = F.lit(None)
    for tool, layout in layouts.items():
        col = make(layout)
        if col is not None:
            found = F.when(F.col("source") == tool, col).otherwise(found)
    return found


def findings(raw: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """Findings of raw outputs (source, stdout, and any other columns) whose tools have a layout, with
    part (the payload's place, by monotonic id) left out: id is source:file:line:title. Payloads
    that aren't JSON, items of another kind and fields of a wrong type give nulls or
    nothing, never an error. Within a payload, ord is an item's place."""
    layouts = LAYOUTS if layouts is None else layouts
    rows = raw.where(F.col("source").isin(*layouts)).select("source", F.try_parse_json("stdout").alias("v"))
    items = _by_source(layouts, lambda t: F.try_variant_get("v", t.items, "array<variant>"))
    rows = rows.select("source", F.posexplode(items).alias("at", "x"))
    text = lambda path: F.try_variant_get("x", path, "string") if path else None
    line = _by_source(layouts, lambda t: F.try_variant_get("x", t.line, "int") + F.lit(1 - t.line_from))

    def severity(t: Layout) -> Column:
        found = F.lit(t.other)
        for said, means in t.severities.items():
            found = F.when(text(t.severity) == said, means).otherwise(found)
        return found

    cols = {"file": _by_source(layouts, lambda t: text(t.file)), "start_line": line.cast("int"), "title": _by_source(layouts, lambda t: text(t.title)), "message": _by_source(layouts, lambda t: text(t.message))}
    rows = rows.select("source", "at", *(c.cast("int" if n == "start_line" else "string").alias(n) for n, c in cols.items()), _by_source(layouts, severity).alias("severity"), _by_source(layouts, lambda t: F.lit(t.category)).alias("category"))
    said = F.concat_ws(":", "source", F.coalesce("file", F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.coalesce("title", F.lit("")))
    return completed(rows.where("title is not null or message is not null").withColumns({"id": said, "confidence": F.lit("high"), "ord": F.col("at").cast("long"), "tags": F.array("category")}))
