"""Registered queries on edges of the engine's operators: configuration, sources, sinks and
rules that the tables don't reach. Expected rows are written out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeweir import fixtures as fixed
from codeweir.operators import findings as fx
from codeweir.operators import leftovers as lo
from codeweir.operators.dead_chain import dead_chains
from codeweir.plans import scan as plans
from codeweir.queries import query
from codeweir.sources import tools
from codeweir.sources.config import Config, overlaid, read_yaml
from codeweir.sources.files import gitignore_globs, relative


def expected(rows: list[tuple], names: str, kinds: dict[str, str] | None = None) -> str:
    cols = ", ".join(f"CAST({c} AS {(kinds or {}).get(c, 'VARCHAR')}) AS {c}" for c in names.split(", "))
    return f"SELECT {cols} FROM {fixed.values(rows, names)}"


# All parsers' findings, put together in the tools' order, each tool's in its payload's.
UNION_ORDER = ("gitleaks", "osv-scanner", "semgrep", "tsc", "pyright", "biome", "ruff", "deptry", "knip", "vulture", "jscpd", "lizard", "radon", "coverage.py", "vitest", "jest")
UNION_ROWS = [(i, r[0]) for i, r in enumerate((r for t in UNION_ORDER for r in fixed.EXPECTED[t]), 1)]


@query("ordered_union", expected(UNION_ROWS, "place, id", {"place": "INTEGER"}))
def ordered_union(spark, sf_dir):
    rows = tools.parsed(fixed.raw_outputs(spark)).select("ord", "id").orderBy("ord").collect()  # a few fixture rows
    return spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows, 1)], "place int, id string")


@query("jest_below_minimum", expected([("jest:coverage", "medium", "Coverage is 55.5% which is below the configured minimum of 70%.")], "id, severity, message"))
def jest_below_minimum(spark, sf_dir):
    raw = spark.createDataFrame([("jest", '{"total":{"lines":{"pct":55.5}}}', "", 0, 10, "ok", None)], tools.RAW)
    return tools.parsed(raw, tools=["jest"]).select("id", "severity", "message")


@query("failed_command", expected([("ruff", "error", "bad config", "ruff check ."), ("tsc", "timeout", "Timed out after 90s.", "tsc --noEmit"), ("biome", "ok", None, None)], "id, status, message, command"))
def failed_command(spark, sf_dir):
    rows = [("ruff", "", "bad config\nmore", 2, 10, "error", None, "ruff check ."), ("tsc", "", "", None, 90000, "timeout", None, "tsc --noEmit"), ("biome", "{}", "", 0, 10, "ok", None, "biome check ."), ("knip", "", "", None, 1, "skipped", "Install it", "knip")]
    return tools.statuses(spark.createDataFrame(rows, tools.RAW_RUN)).select("id", "status", "message", "command")


PATH_ROWS = [("/work/app/src/a.ts", "src/a.ts"), ("src/a.ts", "src/a.ts"), ("/work/lib/b.ts", "../lib/b.ts"), ("/etc/x", "../../etc/x"), ("/work/app2/c.ts", "../app2/c.ts"), ("/work", ".."), ("", None)]


@query("relative_paths", expected([(p, r) for p, r in PATH_ROWS], "path, shown"))
def relative_paths(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in PATH_ROWS], "path string").select("path", relative(F.col("path"), "/work/app/").alias("shown"))


@query("gitignore_globs", expected([("logs/**",), ("*.md",), ("tmp",), ("a b",)], "rule"))
def gitignore_rules(spark, sf_dir):
    return spark.createDataFrame([(g,) for g in gitignore_globs("# notes\r\n/logs/\n\n*.md\n  tmp  \n!keep\n/a b\n")], "rule string")


@query("target_score", expected([(0, 85), (84, 85), (85, 90), (94, 99), (96, 100), (100, 100)], "overall, target", {"overall": "INTEGER", "target": "INTEGER"}))
def target_score(spark, sf_dir):
    return spark.createDataFrame([(x, plans.target_score(x)) for x in (0, 84, 85, 94, 96, 100)], "overall int, target int")


@query("category_list", expected([("security,tests", "security|tests"), (" dead_code , ,leftovers", "dead_code|leftovers"), ("", "all"), ("bogus", "error")], "given, kept"))
def category_list(spark, sf_dir):
    def kept(value: str) -> str:
        try:
            found = fx.parse_categories(value)
            return "all" if found is None else "|".join(found)
        except ValueError:
            return "error"

    return spark.createDataFrame([(x, kept(x)) for x in ("security,tests", " dead_code , ,leftovers", "", "bogus")], "given string, kept string")


# Letters of one kind sort together, small before capital, and accents between them: not by bytes.
CASES = ["apple", "Apple", "banana", "Banana", "Éclair", "eclair", "_x", "zebra"]
CASE_ORDER = ["_x", "apple", "Apple", "banana", "Banana", "eclair", "Éclair", "zebra"]


@query("sort_mixed_case", expected([(i, t) for i, t in enumerate(CASE_ORDER, 1)], "place, title", {"place": "INTEGER"}))
def sort_mixed_case(spark, sf_dir):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(CASES)], "title string, ord long")
    rows = fx.completed(rows.withColumns({"id": F.lit("x"), "source": F.lit("ruff"), "category": F.lit("correctness"), "severity": F.lit("low"), "confidence": F.lit("high"), "message": F.col("title"), "file": F.lit("a.py"), "start_line": F.lit(1)}))
    rows = rows.orderBy(*fx.order()).select("title").collect()  # a few fixture rows
    return spark.createDataFrame([(i, r["title"]) for i, r in enumerate(rows, 1)], "place int, title string")


CONFIG_TEXT = """
profile: strict   # a note
paths:
  include: [lib/**, "app, two/**"]
score:
  minimum: 91
baseline:
  enabled: false
checks:
  dead_code:
    enabled: false
unknown: 5
"""


@query("config_overlay", expected([("strict", "lib/**|app, two/**", "91", "false", "false", "true")], "profile, include, minimum, baseline, dead_code, leftovers"))
def config_overlay(spark, sf_dir):
    c = overlaid(Config(), read_yaml(CONFIG_TEXT))
    flag = lambda x: str(bool(x)).lower()
    row = (c.profile, "|".join(c.paths.include), str(c.score.minimum), flag(c.baseline.enabled), flag(c.checks.dead_code.enabled), flag(c.checks.leftovers.enabled))
    return spark.createDataFrame([row], "profile string, include string, minimum string, baseline string, dead_code string, leftovers string")


GATED = [("src/a.ts", "// legacy shim kept for old clients\n// const x = call(1);\nconst y = 1;\n")]
GATES = [("all", lo.LeftoverRules()), ("no comments", lo.LeftoverRules(comments=False)), ("no code", lo.LeftoverRules(commented_code=False)), ("none", lo.LeftoverRules(False, False, False))]


@query("leftover_gates", expected([("all", "commented-code"), ("all", "vocabulary"), ("no comments", "commented-code"), ("no code", "vocabulary")], "gate, kind"))
def leftover_gates(spark, sf_dir):
    files = spark.createDataFrame(GATED, "path string, content string")
    parts = []
    for name, rules in GATES:
        kind = F.when(F.array_contains("tags", "commented-code"), "commented-code").otherwise("vocabulary")
        parts.append(lo.leftovers(files, rules).where("start_line <= 2").select(F.lit(name).alias("gate"), kind.alias("kind")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


CHAIN_FILES = [("src/index.ts", "export const a = 1;\n"), ("src/plugins/oldPlugin.ts", "import { h } from './helper';\nexport const p = h;\n"), ("src/plugins/helper.ts", "export const h = 1;\n")]
CHAIN_SAYS = "No active entrypoint reaches this cluster. No tests reference this cluster. The files mostly call each other inside the same isolated cluster. Files: src/plugins/helper.ts, src/plugins/oldPlugin.ts Dependencies: @scope/helper"


@query("dynamic_chain", expected([("dead-chain:1:src/plugins/helper.ts", "medium", "low", CHAIN_SAYS)], "id, confidence, severity, snippet"))
def dynamic_chain(spark, sf_dir):
    unused = [("knip", '{"unusedFiles":[],"unusedExports":[],"unusedDependencies":["@scope/helper","other"]}', "", 0, 1, "ok", None)]
    files = spark.createDataFrame(CHAIN_FILES, "path string, content string")
    rows = dead_chains(files, tools.parsed(spark.createDataFrame(unused, tools.RAW), tools=["knip"]))
    return rows.select("id", "confidence", "severity", F.col("evidence.snippet").alias("snippet"))


@query("plan_texts_trimmed", expected([("one|two",)], "texts"))
def plan_texts_trimmed(spark, sf_dir):
    row = spark.createDataFrame([("one\n", " one\t", "\r\n", "two")], "a string, b string, c string, d string")
    return row.select(F.array_join(plans.distinct_texts(*(F.col(c) for c in "abcd")), "|").alias("texts"))


# Two outputs of one tool that landed apart: their findings have one place, and still one merge.
@query("landed_apart", expected([("F401", "Unused import", 1)], "title, message, n", {"n": "BIGINT"}))
def landed_apart(spark, sf_dir):
    item = {"filename": "pkg/m.py", "code": "F401", "message": "Unused import", "location": {"row": 1}}
    outputs = [json.dumps([item]), json.dumps([item | {"message": "unused  IMPORT"}])]
    raw = spark.createDataFrame([("ruff", x, "", 1, 1, "error", None) for x in outputs], tools.RAW)
    seen = {fx.merged(tools.parsed(rows, tools=["ruff"])).first()["message"] for rows in (raw, raw.orderBy(F.desc("stdout")).coalesce(1), raw.repartition(2, "stdout"))}
    return spark.createDataFrame([("F401", "Unused import" if seen <= {"Unused import", "unused  IMPORT"} else "?", len(seen))], "title string, message string, n long")

