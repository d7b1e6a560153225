"""Small code-shaped inputs for queries whose tables hold no source code, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/index.ts": "import { start } from './live';\nimport lodash from 'lodash';\nstart();\n",
    "src/live.ts": "export function start() {\n  return 1;\n}\n",
    "src/billing/oldInvoice.ts": "// TODO: remove later, legacy invoice path for now\nimport { total } from './helper';\nexport const legacyInvoice = (total: number) => total;\nexport function useOldFlow(flag: boolean) {\n  if (flag) { return compatTotals(); } else { return total; }\n}\n// const previousTotal = oldTotals.sum();\n/* Copyright the authors */\n",
    "src/billing/helper.ts": "import './oldInvoice';\nexport const total = process.env.BILLING_LEGACY_MODE ? 1 : 2; // fallback\n* unused block text\n",
    "src/routes/extra.tsx": "export { total } from '../billing/helper';\nconst oldExtra = 1;\n",
    "src/alone.js": "const compat_layer = require('./live');\n",
    "pkg/__init__.py": "from . import tools\n",
    "pkg/tools.py": "# deprecated: temp shim\nimport pkg.more\ndef old_tool(x):\n    try:\n        return fallback_value(x) if x else None\n    except ValueError:\n        return LEGACY_DEFAULT\n",
    "pkg/more.py": "from .tools import old_tool\nclass V1Client:\n    pass\n",
    "tests/test_more.py": "import pkg.more\n",
    "docs/readme.md": "legacy notes\n",
    "node_modules/dep/index.js": "// legacy\n",
}


def _long_file() -> str:
    block = "export function bigN(a, b) {\n" + "".join(f"  if (a > {i}) {{ for (const x of b) {{ while (x) {{ return {i}; }} }} }}\n" for i in range(9)) + "  const shared = compute(everything, again, twice);\n}\n"
    return "import x from 'x';\n" + "".join(block.replace("bigN", f"big{n}") for n in range(5)) + "def tail(z):\n  return z\nconst arrow = async (q) => q;\n"


REFACTOR_FILES = {
    "src/large.ts": _long_file(),
    "src/auth/session.ts": _long_file().replace("big", "login"),
    "src/small.py": "def one():\n    return 1\n",
    "src/made.ts": "// Generated by a tool\n" + _long_file(),
    "src/long_function.js": "function walk(list) {\n" + "".join(f"  step({i});\n" for i in range(85)) + "".join("  if (list) { for (;;) { break; } }\n" for _ in range(5)) + "}\n",
    "tests/large.test.ts": "import { big0 } from '../src/large';\n",
}


def files(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(given.items()), "path string, content string")


def quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def files_sql(given: dict[str, str]) -> str:
    return f"(SELECT * FROM {values(given.items(), 'path, content')})"


#: Raw tool outputs: source, stdout, stderr, exit code, ms, status, hint.
RAW = [
    ("gitleaks", '[{"RuleID":"generic-api-key","Description":"API key","File":"/project/src/config.ts","StartLine":3,"EndLine":3,"Match":"key=abc"},{"File":"src/a.ts","StartLine":1,"Secret":"s3cr3t"}]', "", 1, 900, "error", None),
    ("osv-scanner", '{"results":[{"packages":[{"package":{"name":"left-pad"},"vulnerabilities":[{"id":"OSV-1","summary":"Bad","severity":[{"score":"9.8"}]},{"summary":"Odd","severity":[{"score":"CVSS:3.1/AV:N"}]}]}]},{"packages":[{"vulnerabilities":[{"id":"OSV-2","severity":[{"score":"7.0"}]},{"id":"OSV-3","severity":[{"score":"4.2"}]}]}]}]}', "", 0, 1500, "ok", None),
    ("semgrep", '{"results":[{"check_id":"rule.one","path":"src/a.ts","start":{"line":4},"end":{"line":5},"extra":{"message":"Danger","severity":"ERROR","metadata":{"confidence":"HIGH","category":"security"},"lines":"eval(x)"}},{"check_id":"rule.two","path":"src/b.py","start":{"line":9},"extra":{"severity":"WARNING","metadata":{"category":"correctness"}}}]}', "", 0, 4000, "ok", None),
    ("tsc", "src/a.ts(10,5): error TS2322: Type 'x' is not assignable.\nnoise\nsrc/b.ts(2,1): error TS1005: ';' expected.", "src/c.ts(7,3): error TS7006: Implicit any.", 2, 3000, "error", None),
    ("pyright", '{"generalDiagnostics":[{"file":"/project/pkg/m.py","message":"No attribute","severity":"error","rule":"reportAttributeAccessIssue","range":{"start":{"line":4},"end":{"line":4}}},{"file":"pkg/n.py","message":"Maybe None","severity":"warning"},{"file":"pkg/o.py","message":"FYI","severity":"information","range":{"start":{"line":0},"end":{"line":2}}}]}', "", 1, 2000, "error", None),
    ("biome", '{"diagnostics":[{"category":"lint/style","severity":"error","description":"Use const","location":{"path":{"file":"src/a.ts"},"span":{"start":{"line":3},"end":{"line":4}}},"tags":["fixable"]},{"severity":"warn"},{"category":"format","severity":"info","description":"Reformat"}]}', "The --reporter option is unstable/experimental", 1, 700, "error", None),
    ("ruff", '[{"filename":"/project/pkg/m.py","code":"F401","message":"Unused import","location":{"row":1},"end_location":{"row":1},"fix":{"applicability":"safe"}},{"filename":"pkg/n.py","code":"S105","message":"Hardcoded password","location":{"row":8}},{"filename":"pkg/n.py","code":"W291","message":"Trailing space","location":{"row":9},"fix":null}]', "", 1, 300, "error", None),
    ("deptry", '[{"error":{"code":"DEP002","message":"\'requests\' defined but not used"},"module":"requests","location":{"file":"pyproject.toml","line":12}},{"error":{"code":"DEP003","message":"\'yaml\' is transitive"},"location":{"file":"pkg/m.py"}}]', "", 1, 800, "error", None),
    ("knip", '{"unusedFiles":["src/dead.ts"],"unusedExports":[{"file":"src/a.ts","line":7,"symbol":"helper"},{"file":"src/b.ts"}],"unusedDependencies":["left-pad"]}', '{"issues":[]}', 1, 2500, "error", None),
    ("vulture", '[{"filename":"pkg/m.py","first_lineno":3,"size":2,"name":"lost","type":"function","confidence":95},{"filename":"pkg/__init__.py","first_lineno":1,"size":1,"name":"tools","type":"import","confidence":90},{"filename":"pkg/n.py","first_lineno":5,"name":"x","type":"variable","confidence":70},{"filename":"pkg/n.py","first_lineno":6,"name":"y","type":"variable"}]', "", 3, 600, "error", None),
    ("jscpd", '{"duplicates":[{"format":"typescript","firstFile":{"name":"src/a.ts","start":1,"end":30},"secondFile":{"name":"src/b.ts","start":5,"end":34},"lines":29},{"firstFile":{"name":"src/c.ts"},"secondFile":{"name":"src/d.ts"},"tokens":80}]}', "", 0, 5000, "ok", None),
    ("lizard", '[{"filename":"src/a.ts","function_list":[{"name":"busy","start_line":2,"end_line":60,"cyclomatic_complexity":31},{"name":"calm","start_line":70,"end_line":80,"cyclomatic_complexity":3}]},{"filename":"src/b.ts","function_list":[{"start_line":1,"cyclomatic_complexity":15}]}]', "", 0, 2000, "ok", None),
    ("radon", '{"pkg/m.py":[{"name":"busy","lineno":2,"endline":40,"complexity":30,"rank":"D"},{"name":"calm","lineno":50,"complexity":2,"rank":"A"}],"pkg/n.py":[{"lineno":4,"complexity":16}]}', "", 0, 400, "ok", None),
    ("coverage.py", '{"totals":{"percent_covered":34.5}}', "", 0, 100, "ok", None),
    ("vitest", '{"total":{"lines":{"pct":61}}}', "Loaded  vitest@2.0  and @vitest/coverage-v8@2.0", 1, 9000, "error", None),
    ("jest", '{"total":{"lines":{"pct":88.2}}}', "", 0, 9000, "ok", None),
    ("custom-tool", "", "   \n" + "x" * 400 + "\nmore", 2, 61499, "error", None),
    ("slow-tool", "", "", None, 61499, "timeout", None),
    ("silent-tool", " \n ", "", None, 10, "error", None),
    ("absent-tool", "", "not found", None, 5, "skipped", "Install it first"),
]
RAW_COLUMNS = "source, stdout, stderr, exit_code, duration_ms, status, install_hint"


def raw_outputs(spark: SparkSession) -> DataFrame:
    from codeweir.sources.tools import RAW as SCHEMA

    return spark.createDataFrame(RAW, SCHEMA)


#: Expected findings of RAW by tool: id, category, severity, confidence, title, message, file,
#: start_line, end_line, safe fix, tags, snippet or raw id.
EXPECTED = {
    "gitleaks": [
        ("gitleaks:/project/src/config.ts:3:generic-api-key", "security", "critical", "high", "generic-api-key", "API key", "src/config.ts", 3, 3, 0, "security,secret", "key=abc"),
        ("gitleaks:src/a.ts:1:1", "security", "critical", "high", "Secret-like token", "Potential secret detected.", "src/a.ts", 1, None, 0, "security,secret", "s3cr3t"),
    ],
    "osv-scanner": [
        ("osv:left-pad:OSV-1", "dependencies", "critical", "high", "OSV-1", "left-pad: Bad", None, None, None, 0, "dependencies,security", None),
        ("osv:left-pad:1", "dependencies", "low", "high", "Dependency vulnerability", "left-pad: Odd", None, None, None, 0, "dependencies,security", None),
        ("osv:undefined:OSV-2", "dependencies", "high", "high", "OSV-2", "Dependency: Known vulnerability detected.", None, None, None, 0, "dependencies,security", None),
        ("osv:undefined:OSV-3", "dependencies", "medium", "high", "OSV-3", "Dependency: Known vulnerability detected.", None, None, None, 0, "dependencies,security", None),
    ],
    "semgrep": [
        ("semgrep:src/a.ts:4:rule.one", "security", "high", "high", "rule.one", "Danger", "src/a.ts", 4, 5, 0, "security,semgrep", "eval(x)"),
        ("semgrep:src/b.py:9:rule.two", "correctness", "medium", "low", "rule.two", "Semgrep reported a potential issue.", "src/b.py", 9, None, 0, "security,semgrep", None),
    ],
    "tsc": [
        ("tsc:src/a.ts:10:TS2322", "correctness", "high", "high", "TS2322", "Type 'x' is not assignable.", "src/a.ts", 10, None, 0, "typescript,types", None),
        ("tsc:src/b.ts:2:TS1005", "correctness", "medium", "high", "TS1005", "';' expected.", "src/b.ts", 2, None, 0, "typescript,types", None),
        ("tsc:src/c.ts:7:TS7006", "correctness", "high", "high", "TS7006", "Implicit any.", "src/c.ts", 7, None, 0, "typescript,types", None),
    ],
    "pyright": [
        ("pyright:/project/pkg/m.py:4:reportAttributeAccessIssue", "correctness", "high", "high", "reportAttributeAccessIssue", "No attribute", "pkg/m.py", 5, 5, 0, "python,types", None),
        ("pyright:pkg/n.py:0:1", "correctness", "medium", "high", "pyright", "Maybe None", "pkg/n.py", None, None, 0, "python,types", None),
        ("pyright:pkg/o.py:0:2", "correctness", "low", "high", "pyright", "FYI", "pkg/o.py", 1, 3, 0, "python,types", None),
    ],
    "biome": [
        ("biome:src/a.ts:0", "correctness", "medium", "high", "lint/style", "Use const", "src/a.ts", 3, 4, 1, "javascript,typescript,fixable", None),
        ("biome:unknown:1", "correctness", "low", "high", "biome", "Biome reported an issue.", None, None, None, 1, "javascript,typescript", None),
        ("biome:unknown:2", "correctness", "info", "high", "format", "Reformat", None, None, None, 1, "javascript,typescript", None),
    ],
    "ruff": [
        ("ruff:/project/pkg/m.py:1:F401", "correctness", "medium", "high", "F401", "Unused import", "pkg/m.py", 1, 1, 1, "python,lint", "F401"),
        ("ruff:pkg/n.py:8:S105", "correctness", "high", "high", "S105", "Hardcoded password", "pkg/n.py", 8, None, 0, "python,lint", "S105"),
        ("ruff:pkg/n.py:9:W291", "correctness", "low", "high", "W291", "Trailing space", "pkg/n.py", 9, None, 0, "python,lint", "W291"),
    ],
    "deptry": [
        ("deptry:pyproject.toml:12:DEP002:0", "dependencies", "medium", "high", "DEP002", "'requests' defined but not used", "pyproject.toml", 12, None, 0, "python,dependencies", None),
        ("deptry:pkg/m.py:0:DEP003:1", "dependencies", "low", "high", "DEP003", "'yaml' is transitive", "pkg/m.py", None, None, 0, "python,dependencies", None),
    ],
    "knip": [
        ("knip:file:src/dead.ts", "dead_code", "medium", "high", "Unused file", "src/dead.ts is not reachable from detected entrypoints.", "src/dead.ts", None, None, 0, "javascript,typescript,dead-code", None),
        ("knip:export:src/a.ts:7:helper", "dead_code", "low", "high", "Unused export", "helper appears unused.", "src/a.ts", 7, None, 0, "javascript,typescript,dead-code", None),
        ("knip:export:src/b.ts:undefined:undefined", "dead_code", "low", "high", "Unused export", "Export appears unused.", "src/b.ts", None, None, 0, "javascript,typescript,dead-code", None),
        ("knip:dependency:left-pad", "dependencies", "low", "medium", "Unused dependency", "left-pad appears unused in the current JS/TS graph.", None, None, None, 0, "javascript,typescript,dependencies", None),
    ],
    "vulture": [
        ("vulture:pkg/m.py:3:lost", "dead_code", "low", "high", "Unused function", "lost appears unused according to Vulture.", "pkg/m.py", 3, None, 0, "python,dead-code", None),
        ("vulture:pkg/__init__.py:1:tools", "dead_code", "low", "low", "Review package initializer import", "tools is in a package initializer and needs manual review before removal.", "pkg/__init__.py", 1, None, 0, "python,dead-code,review-only", None),
        ("vulture:pkg/n.py:5:x", "dead_code", "low", "medium", "Unused variable", "x appears unused according to Vulture.", "pkg/n.py", 5, None, 0, "python,dead-code", None),
        ("vulture:pkg/n.py:6:y", "dead_code", "low", "low", "Unused variable", "y appears unused according to Vulture.", "pkg/n.py", 6, None, 0, "python,dead-code", None),
    ],
    "jscpd": [
        ("jscpd:src/a.ts:1:0", "maintainability", "medium", "high", "Duplicated code block", "29 duplicated lines between src/a.ts and src/b.ts.", "src/a.ts", 1, 30, 0, "duplication,typescript", None),
        ("jscpd:src/c.ts:0:1", "maintainability", "low", "high", "Duplicated code block", "80 duplicated lines between src/c.ts and src/d.ts.", "src/c.ts", None, None, 0, "duplication,unknown", None),
    ],
    "lizard": [
        ("lizard:src/a.ts:2:busy", "maintainability", "high", "high", "High cyclomatic complexity", "busy complexity is 31.", "src/a.ts", 2, 60, 0, "complexity", None),
        ("lizard:src/b.ts:1:undefined", "maintainability", "medium", "high", "High cyclomatic complexity", "Function complexity is 15.", "src/b.ts", 1, None, 0, "complexity", None),
    ],
    "radon": [
        ("radon:pkg/m.py:2:busy", "maintainability", "high", "high", "Complex Python block (D)", "busy complexity is 30.", "pkg/m.py", 2, 40, 0, "python,complexity", None),
        ("radon:pkg/n.py:4:undefined", "maintainability", "medium", "high", "Complex Python block (?)", "Block complexity is 16.", "pkg/n.py", 4, None, 0, "python,complexity", None),
    ],
    "coverage.py": [("coverage.py:overall", "tests", "high", "high", "Python coverage below target", "Coverage is 34.5% which is below the configured minimum of 70%.", None, None, None, 0, "python,coverage", None)],
    "vitest": [("vitest:coverage", "tests", "medium", "high", "JS/TS coverage below target", "Coverage is 61% which is below the configured minimum of 70%.", None, None, None, 0, "javascript,typescript,coverage", None)],
    "jest": [],
}
EXPECTED_COLUMNS = "id, category, severity, confidence, title, message, file, start_line, end_line, safe, tags, note"
