"""Raw tool output to findings: a parser for each tool, over raw_outputs (source, stdout,
stderr, exit_code, duration_ms, status, install_hint).

A parser filters its source's rows, reads the JSON with a fixed schema (malformed text
gives no rows), explodes it and projects the columns of a finding. Nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.functions.text import number_text, templated, text_or, trim
from codeweir.operators.findings import EVIDENCE, completed
from codeweir.sources.files import relative

RAW = "source string, stdout string, stderr string, exit_code int, duration_ms bigint, status string, install_hint string"
#: Outputs of tools that this engine ran itself.
RAW_RUN = RAW + ", command string"


@dataclass(frozen=True)
class ToolRules:
    root: str = "/project"
    min_complexity: int = 15
    min_coverage: float = 70


# Payload schemas, in the order of the report.
PAYLOADS = {
    "gitleaks": "array<struct<RuleID string, Description string, File string, StartLine int, EndLine int, Match string, Secret string>>",
    "osv-scanner": "struct<results array<struct<packages array<struct<package struct<name string>, vulnerabilities array<struct<package struct<name string>, id string, summary string, severity array<struct<score string>>>>>>>>>",
    "semgrep": "struct<results array<struct<check_id string, path string, start struct<line int>, `end` struct<line int>, extra struct<message string, severity string, metadata struct<confidence string, category string>, lines string>>>>",
    "pyright": "struct<generalDiagnostics array<struct<file string, message string, severity string, rule string, range struct<start struct<line int>, `end` struct<line int>>>>>",
    "biome": "struct<diagnostics array<struct<category string, severity string, description string, location struct<path struct<file string>, span struct<start struct<line int>, `end` struct<line int>>>, tags array<string>>>>",
    "ruff": "array<struct<filename string, code string, message string, location struct<row int>, end_location struct<row int>, fix string>>",
    "deptry": "array<struct<error struct<code string, message string>, module string, location struct<file string, line int>>>",
    "knip": "struct<unusedFiles array<string>, unusedExports array<struct<file string, line int, symbol string>>, unusedDependencies array<string>>",
    "vulture": "array<struct<filename string, first_lineno int, size int, name string, type string, confidence int>>",
    "jscpd": "struct<duplicates array<struct<format string, firstFile struct<name string, start int, `end` int>, secondFile struct<name string, start int, `end` int>, lines int, tokens int>>>",
    "lizard": "array<struct<filename string, function_list array<struct<name string, start_line int, end_line int, cyclomatic_complexity int>>>>",
    "radon": "map<string, array<struct<name string, lineno int, endline int, complexity int, rank string>>>",
    "coverage.py": "struct<totals struct<percent_covered double>>",
    "vitest": "struct<total struct<lines struct<pct double>>>",
    "jest": "struct<total struct<lines struct<pct double>>>",
}
TSC_LINE = r"(?m)^(.+?)\((\d+),(\d+)\): error (TS\d+): (.+)$"


def payload(raw: DataFrame, tool: str) -> DataFrame:
    mine = raw.where((F.col("source") == tool) & (F.coalesce("status", F.lit("ok")) != "skipped"))
    return mine.select(F.from_json(trim(F.col("stdout")), PAYLOADS[tool]).alias("p"))


def rows(raw: DataFrame, tool: str, items: Column | None = None) -> DataFrame:
    """at (0-based), x of the payload's items."""
    return payload(raw, tool).select(F.posexplode(F.col("p") if items is None else items).alias("at", "x"))


def named_level(col: Column, levels: dict[str, str], other: str) -> Column:
    return reduce(lambda made, kv: made.when(col == kv[0], kv[1]), list(levels.items())[1:], F.when(col == next(iter(levels)), next(iter(levels.values())))).otherwise(other)


def shown(df: DataFrame, tool: str, **cols) -> DataFrame:
    fixed = {"source": tool, "ord": F.col("at").cast("long")} | cols
    return completed(df.select(*((c if isinstance(c, Column) else F.array(*map(F.lit, c)) if isinstance(c, list) else F.lit(c)).alias(n) for n, c in fixed.items())))


def evidence(snippet: Column | None = None, raw_id: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if snippet is None else snippet).alias("snippet"), (null if raw_id is None else raw_id).alias("tool_raw_id"), null.alias("matched_pattern")).cast(EVIDENCE)


def gitleaks(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "gitleaks"), "gitleaks", id=templated("gitleaks:", x.File, ":", x.StartLine, ":", F.coalesce(x.RuleID, F.col("at").cast("string"))), category="security", severity="critical", confidence="high",
        title=text_or(x.RuleID, "Secret-like token"), message=text_or(x.Description, "Potential secret detected."), file=relative(x.File, r.root), start_line=x.StartLine, end_line=x.EndLine,
        agent_instruction="Remove the secret from source, rotate the credential, and replace it with environment-based configuration.", tags=["security", "secret"], evidence=evidence(F.coalesce(x.Match, x.Secret)),
    )


def osv_scanner(raw: DataFrame, r: ToolRules) -> DataFrame:
    each = payload(raw, "osv-scanner").select(F.posexplode("p.results").alias("i", "result")).select("i", F.posexplode("result.packages").alias("j", "pkg"))
    each = each.select("i", "j", F.col("pkg.package").alias("pkg"), F.posexplode("pkg.vulnerabilities").alias("k", "x"))
    # Its place among all of the report's vulnerabilities orders rows; ids use the vulnerability's own.
    each = each.withColumn("at", (F.col("i").cast("long") * (1 << 20) + F.col("j")) * (1 << 20) + F.col("k"))
    x, name = F.col("x"), F.coalesce("x.package.name", "pkg.name")
    score = F.coalesce(F.try_element_at(x.severity, F.lit(1)).score.try_cast("double"), F.lit(0.0))
    return shown(
        each, "osv-scanner", id=templated("osv:", name, ":", F.coalesce(x.id, F.col("k").cast("string"))), category="dependencies", confidence="high",
        severity=F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low"), title=text_or(x.id, "Dependency vulnerability"),
        message=F.concat(text_or(name, "Dependency"), F.lit(": "), text_or(x.summary, "Known vulnerability detected.")), tags=["dependencies", "security"],
        agent_instruction="Upgrade or replace the affected dependency after checking compatibility and changelog risk.",
    )


def semgrep(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "semgrep", F.col("p.results")), "semgrep", id=templated("semgrep:", x.path, ":", x.start.line, ":", x.check_id), category=F.when(x.extra.metadata.category == "correctness", "correctness").otherwise("security"),
        severity=named_level(x.extra.severity, {"ERROR": "high", "WARNING": "medium"}, "low"), confidence=named_level(x.extra.metadata.confidence, {"HIGH": "high", "MEDIUM": "medium"}, "low"),
        title=x.check_id, message=text_or(x.extra.message, "Semgrep reported a potential issue."), file=relative(x.path, r.root), start_line=x.start.line, end_line=x["end"].line, tags=["security", "semgrep"],
        agent_instruction="Review the data flow around this finding and make the smallest safe fix.", evidence=evidence(x.extra.lines),
    )


def tsc(raw: DataFrame, r: ToolRules) -> DataFrame:
    mine = raw.where((F.col("source") == "tsc") & (F.coalesce("status", F.lit("ok")) != "skipped"))
    text = F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit("")))
    each = mine.select(F.posexplode(F.split(text, "\r?\n")).alias("at", "t")).where(F.col("t").rlike(TSC_LINE))
    file, line, code, said = (F.regexp_extract("t", TSC_LINE, i) for i in (1, 2, 4, 5))
    return shown(
        each, "tsc", id=F.concat(F.lit("tsc:"), file, F.lit(":"), line, F.lit(":"), code), category="correctness", severity=F.when(code.rlike("TS2307|TS2322|TS2554|TS7006"), "high").otherwise("medium"), confidence="high", title=code,
        message=said, file=relative(file, r.root), start_line=line.cast("int"), agent_instruction="Fix the type error without changing public behavior unless required.", tags=["typescript", "types"],
    )


def pyright(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "pyright", F.col("p.generalDiagnostics")), "pyright", id=templated("pyright:", x.file, ":", F.coalesce(x.range.start.line, F.lit(0)), ":", F.coalesce(x.rule, F.col("at").cast("string"))), category="correctness",
        severity=named_level(x.severity, {"error": "high", "warning": "medium"}, "low"), confidence="high", title=text_or(x.rule, "pyright"), message=x.message, file=relative(x.file, r.root),
        start_line=x.range.start.line + 1, end_line=x.range["end"].line + 1, agent_instruction="Address the Python type issue and rerun the affected tests.", tags=["python", "types"],
    )


def biome(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "biome", F.col("p.diagnostics")), "biome", id=F.concat(F.lit("biome:"), text_or(x.location.path.file, "unknown"), F.lit(":"), F.col("at").cast("string")), category="correctness",
        severity=named_level(x.severity, {"error": "medium", "warn": "low"}, "info"), confidence="high", title=text_or(x.category, "biome"), message=text_or(x.description, "Biome reported an issue."),
        file=relative(x.location.path.file, r.root), start_line=x.location.span.start.line, end_line=x.location.span["end"].line, is_autofixable=True, safe_to_autofix=True, fix_command="biome check . --write",
        agent_instruction="Apply Biome's safe write mode for this file.", tags=F.concat(F.array(F.lit("javascript"), F.lit("typescript")), F.coalesce(x.tags, F.array().cast("array<string>"))),
    )


def ruff(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    fixable = F.coalesce(~F.col("x.fix").isin("", "false", "0", "null"), F.lit(False))
    return shown(
        rows(raw, "ruff"), "ruff", id=templated("ruff:", x.filename, ":", x.location.row, ":", x.code), category="correctness", severity=F.when(x.code.rlike("^F|^E9|^B"), "medium").when(x.code.rlike("^S"), "high").otherwise("low"),
        confidence="high", title=x.code, message=x.message, file=relative(x.filename, r.root), start_line=x.location.row, end_line=x.end_location.row, is_autofixable=fixable, safe_to_autofix=fixable,
        fix_command="ruff check . --fix && ruff format .", agent_instruction="Apply the Ruff fix if safe, then rerun the affected Python tests.", tags=["python", "lint"], evidence=evidence(raw_id=x.code),
    )


def deptry(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "deptry"), "deptry", id=templated("deptry:", x.location.file, ":", F.coalesce(x.location.line, F.lit(0)), ":", x.error.code, ":", F.col("at")), category="dependencies",
        severity=F.when(x.error.code == "DEP002", "medium").otherwise("low"), confidence="high", title=x.error.code, message=x.error.message, file=relative(x.location.file, r.root), start_line=x.location.line,
        agent_instruction="Fix the Python dependency declaration without removing packages that may be imported dynamically.", tags=["python", "dependencies"],
    )


def knip(raw: DataFrame, r: ToolRules) -> DataFrame:
    """Three shapes of one report, in this order. One pass over the payload explodes them
    all."""
    shape = "array<struct<kind:int,file:string,line:int,symbol:string>>"
    unused = lambda items, kind: F.transform(items, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("symbol")))
    exports = F.transform("p.unusedExports", lambda e: F.struct(F.lit(1).alias("kind"), e["file"].alias("file"), e["line"].alias("line"), e["symbol"].alias("symbol")))
    none = F.array().cast(shape)
    every = F.concat(*(F.coalesce(a.cast(shape), none) for a in (unused("p.unusedFiles", 0), exports, unused("p.unusedDependencies", 2))))
    x = F.col("x")
    pick = lambda a, b, c: F.when(x.kind == 0, a).when(x.kind == 1, b).otherwise(c)
    text = lambda *t: F.array(*map(F.lit, t))
    return shown(
        rows(raw, "knip", every), "knip", id=pick(templated("knip:file:", x.file), templated("knip:export:", x.file, ":", x.line, ":", x.symbol), templated("knip:dependency:", x.file)), category=pick("dead_code", "dead_code", "dependencies"),
        severity=pick("medium", "low", "low"), confidence=pick("high", "high", "medium"), title=pick("Unused file", "Unused export", "Unused dependency"),
        message=pick(F.concat(x.file, F.lit(" is not reachable from detected entrypoints.")), F.concat(text_or(x.symbol, "Export"), F.lit(" appears unused.")), F.concat(x.file, F.lit(" appears unused in the current JS/TS graph."))),
        file=F.when(x.kind < 2, relative(x.file, r.root)), start_line=x.line, tags=pick(text("javascript", "typescript", "dead-code"), text("javascript", "typescript", "dead-code"), text("javascript", "typescript", "dependencies")),
        agent_instruction=pick("Verify no runtime entrypoint or framework convention depends on this file before deletion.", "Remove the export only if external consumers and dynamic imports are ruled out.", "Remove the dependency only after checking scripts, config, and transitive runtime loading."),
    )


def vulture(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    package = F.replace(x.filename, F.lit("\\"), F.lit("/")).endswith("/__init__.py") | (x.filename == "__init__.py")
    sure = F.coalesce(x.confidence, F.lit(60))
    text = lambda *t: F.array(*map(F.lit, t))
    return shown(
        rows(raw, "vulture"), "vulture", id=templated("vulture:", x.filename, ":", x.first_lineno, ":", x["name"]), category="dead_code", severity="low",
        confidence=F.when(package, "low").when(sure >= 90, "high").when(sure >= 70, "medium").otherwise("low"), title=F.concat(F.when(package, "Review package initializer ").otherwise("Unused "), text_or(x["type"], "undefined")),
        message=F.concat(text_or(x["name"], "undefined"), F.when(package, " is in a package initializer and needs manual review before removal.").otherwise(" appears unused according to Vulture.")),
        file=relative(x.filename, r.root), start_line=x.first_lineno, tags=F.when(package, text("python", "dead-code", "review-only")).otherwise(text("python", "dead-code")),
        agent_instruction=F.when(package, "Review this package initializer manually; verify imports, package exports, and framework discovery before changing it.").otherwise("Treat this as advisory for Python: verify decorators, reflection, and framework registration before deletion."),
    )


def jscpd(raw: DataFrame, r: ToolRules) -> DataFrame:
    x = F.col("x")
    return shown(
        rows(raw, "jscpd", F.col("p.duplicates")), "jscpd", id=templated("jscpd:", x.firstFile["name"], ":", F.coalesce(x.firstFile.start, F.lit(0)), ":", F.col("at")), category="maintainability",
        severity=F.when(x.lines > 20, "medium").otherwise("low"), confidence="high", title="Duplicated code block",
        message=templated(F.coalesce(x.lines, x.tokens, F.lit(0)), " duplicated lines between ", x.firstFile["name"], " and ", x.secondFile["name"], "."), file=relative(x.firstFile["name"], r.root), start_line=x.firstFile.start, end_line=x.firstFile["end"],
        agent_instruction="Extract or consolidate the duplicated logic only if behavior can stay identical.", tags=F.array(F.lit("duplication"), text_or(x.format, "unknown")),
    )


def lizard(raw: DataFrame, r: ToolRules) -> DataFrame:
    files = rows(raw, "lizard").select(F.col("at").alias("i"), F.col("x.filename").alias("filename"), F.posexplode("x.function_list").alias("j", "x"))
    x = F.col("x")
    cc = F.coalesce(x.cyclomatic_complexity, F.lit(0))
    each = files.withColumn("at", F.col("i").cast("long") * (1 << 24) + F.col("j")).where(cc >= r.min_complexity)
    return shown(
        each, "lizard", id=templated("lizard:", F.col("filename"), ":", F.coalesce(x.start_line, F.lit(0)), ":", x["name"]), category="maintainability", severity=F.when(cc >= 2 * r.min_complexity, "high").otherwise("medium"),
        confidence="high", title="High cyclomatic complexity", message=F.concat(text_or(x["name"], "Function"), templated(" complexity is ", x.cyclomatic_complexity, ".")), file=relative(F.col("filename"), r.root),
        start_line=x.start_line, end_line=x.end_line, agent_instruction="Reduce branching with extraction or guard clauses while keeping current behavior stable.", tags=["complexity"],
    )


def radon(raw: DataFrame, r: ToolRules) -> DataFrame:
    files = payload(raw, "radon").select(F.posexplode(F.map_entries("p")).alias("i", "e")).select("i", F.col("e.key").alias("filename"), F.posexplode("e.value").alias("j", "x"))
    x = F.col("x")
    cc = F.coalesce(x.complexity, F.lit(0))
    each = files.withColumn("at", F.col("i").cast("long") * (1 << 24) + F.col("j")).where(cc >= r.min_complexity)
    return shown(
        each, "radon", id=templated("radon:", F.col("filename"), ":", F.coalesce(x.lineno, F.lit(0)), ":", x["name"]), category="maintainability", severity=F.when(cc >= 2 * r.min_complexity, "high").otherwise("medium"), confidence="high",
        title=F.concat(F.lit("Complex Python block ("), text_or(x["rank"], "?"), F.lit(")")), message=F.concat(text_or(x["name"], "Block"), templated(" complexity is ", x.complexity, ".")), file=relative(F.col("filename"), r.root),
        start_line=x.lineno, end_line=x.endline, agent_instruction="Split or simplify the complex Python logic after protecting behavior with tests.", tags=["python", "complexity"],
    )


def coverage(raw: DataFrame, r: ToolRules, tool: str, path: str, fixed_id: str, title: str, hint: str, tags: list[str]) -> DataFrame:
    """A finding for each report whose percentage is below the minimum."""
    pct = F.col(path)
    each = payload(raw, tool).where(pct < r.min_coverage).withColumn("at", F.lit(0))
    least = str(int(r.min_coverage)) if r.min_coverage == int(r.min_coverage) else str(r.min_coverage)
    said = F.concat(F.lit("Coverage is "), number_text(pct), F.lit(f"% which is below the configured minimum of {least}%."))
    return shown(each, tool, id=fixed_id, category="tests", severity=F.when(pct < r.min_coverage / 2, "high").otherwise("medium"), confidence="high", title=title, message=said, agent_instruction=hint, tags=tags)


def coverage_py(raw: DataFrame, r: ToolRules) -> DataFrame:
    return coverage(raw, r, "coverage.py", "p.totals.percent_covered", "coverage.py:overall", "Python coverage below target", "Add or strengthen Python tests before making broader refactors.", ["python", "coverage"])


def vitest(raw: DataFrame, r: ToolRules) -> DataFrame:
    return coverage(raw, r, "vitest", "p.total.lines.pct", "vitest:coverage", "JS/TS coverage below target", "Add or expand Vitest coverage before larger refactors.", ["javascript", "typescript", "coverage"])


def jest(raw: DataFrame, r: ToolRules) -> DataFrame:
    return coverage(raw, r, "jest", "p.total.lines.pct", "jest:coverage", "JS coverage below target", "Add or expand Jest coverage before larger refactors.", ["javascript", "coverage"])


Parser = Callable[[DataFrame, ToolRules], DataFrame]
#: Parsers in the order in which findings are put together.
PARSERS: dict[str, Parser] = {"gitleaks": gitleaks, "osv-scanner": osv_scanner, "semgrep": semgrep, "tsc": tsc, "pyright": pyright, "biome": biome, "ruff": ruff, "deptry": deptry, "knip": knip, "vulture": vulture, "jscpd": jscpd, "lizard": lizard, "radon": radon, "coverage.py": coverage_py, "vitest": vitest, "jest": jest}


@dataclass(frozen=True)
class Added:
    """What the engine knows of a registered tool beside its parser. detect gets the project's
    languages, lock files, framework hints and test commands; None: it fits any project. command:
    how to run it, a runner.Command; fix: a shell command that fixes what is safe to fix."""

    category: str = "correctness"
    detect: Callable[[list, list, list, list], bool] | None = None
    command: object | None = None
    fix: str | None = None


ADDED: dict[str, Added] = {}


def register(tool: str, schema: str, parser: Parser, category: str = "correctness", detect=None, command=None, fix: str | None = None) -> None:
    """Add a tool, or replace one: the schema of its JSON payload and a parser of raw outputs to
    findings (see rows() and shown()). New tools come last in the report. A scan plans the
    tool where checks of its category are on and detect holds, runs its command and
    keeps what it finds; fixes run where detect holds."""
    PAYLOADS[tool] = schema
    PARSERS[tool] = parser
    ADDED[tool] = Added(category, detect, command, fix)


def unregister(tool: str) -> None:
    """Forget a tool that register() has added."""
    if ADDED.pop(tool, None):
        PARSERS.pop(tool)
        PAYLOADS.pop(tool)


#: Room for a tool's own places in ord.
STRIDE = 1 << 56


def parsed(raw: DataFrame, rules: ToolRules = ToolRules(), tools: list[str] | None = None) -> DataFrame:
    """All tools' findings, in the tools' order by ord."""
    parts = [PARSERS[t](raw, rules).withColumn("ord", F.col("ord") + F.lit(i * STRIDE)) for i, t in enumerate(PARSERS) if tools is None or t in tools]
    return reduce(DataFrame.unionByName, parts)


def with_existing_coverage(raw: DataFrame, summary: DataFrame) -> DataFrame:
    """raw with the text of a coverage summary (value) in place of the test runners' outputs."""
    runner = F.explode(F.array(F.lit("vitest"), F.lit("jest"))).alias("source")
    null = F.lit(None)
    found = summary.select(runner, F.col("value").alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code"), F.lit(0).cast("bigint").alias("duration_ms"), F.lit("ok").alias("status"), null.cast("string").alias("install_hint"))
    return raw.where(~F.col("source").isin("vitest", "jest")).unionByName(found, allowMissingColumns=True)


# --- statuses ------------------------------------------------------------------------


def status_message() -> Column:
    """What a failed or timed-out tool said: its first line with text, of at most 300
    characters."""
    useful = lambda c: F.get(F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\r?\n"), trim), lambda s: s != ""), F.lit(0))
    late = F.concat(F.lit("Timed out after "), F.floor(F.col("duration_ms") / 1000 + 0.5).cast("string"), F.lit("s."))
    said = F.when(F.col("status") == "timeout", late).otherwise(F.coalesce(useful("stderr"), useful("stdout"), F.concat(F.lit("Exited with code "), text_or(F.col("exit_code"), "unknown"), F.lit("."))))
    return F.when(F.col("status").isin("error", "timeout"), F.when(F.length(said) > 300, F.concat(F.substring(said, 1, 297), F.lit("..."))).otherwise(said))


def statuses(raw: DataFrame) -> DataFrame:
    """id, status, message of tools that ran, and the command of those that failed if raw has it:
    some tools' ways of reporting findings by an exit code or a start-up log count as success."""
    ran = [F.when(F.col("status").isin("error", "timeout"), F.col("command")).alias("command")] if "command" in raw.columns else []
    rows = raw.where("status <> 'skipped'").select(F.col("source").alias("id"), "status", status_message().alias("message"), *ran)
    m = F.coalesce("message", F.lit(""))
    quiet = ((F.col("id") == "biome") & m.rlike("(?i)unstable|experimental")) | ((F.col("id") == "vitest") & m.rlike("(?i)Loaded .*vitest@.*coverage-v8"))
    report = (F.col("id") == "knip") & (F.col("status") == "error") & trim(m).startswith("{")
    status = F.when(quiet | report, "ok").otherwise(F.col("status"))
    message = F.when(quiet, None).when(report, "Reported issues (debt surfaced as findings)").otherwise(F.col("message"))
    said = [F.when(~quiet, F.col("command")).alias("command")] if ran else []
    return rows.select("id", status.alias("status"), message.alias("message"), *said).orderBy("id")


def skipped(raw: DataFrame) -> DataFrame:
    return raw.where("status = 'skipped'").select(F.col("source").alias("id"), "status", "install_hint").orderBy("id")
