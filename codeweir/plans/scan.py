"""A scan: which sources run, their findings merged, compared, scored and ordered; gates,
repair plans, explanations and category filters on the result."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.functions.text import matches_globs, trim
from codeweir.operators import findings as fx
from codeweir.operators.dead_chain import dead_chains
from codeweir.operators.graph import cut
from codeweir.operators.leftovers import LeftoverRules, leftovers
from codeweir.operators.refactor import RefactorRules, is_test_file, refactor_candidates
from codeweir.sources import tools
from codeweir.sources.config import Config, Policy
from codeweir.sources.project import Project

# Fixed values.
CATEGORY_OF = {"gitleaks": "security", "osv-scanner": "dependencies", "semgrep": "security", "tsc": "correctness", "pyright": "correctness", "biome": "correctness", "ruff": "correctness", "deptry": "dependencies", "knip": "dead_code", "vulture": "dead_code", "jscpd": "maintainability", "lizard": "maintainability", "radon": "maintainability", "coverage.py": "tests", "vitest": "tests", "jest": "tests", "custom-leftovers": "leftovers", "custom-refactor": "refactor_readiness"}
QUICK = {"ruff", "biome", "tsc", "pyright", "gitleaks", "osv-scanner", "custom-leftovers"}
NEEDS = {"tsc": {"typescript"}, "biome": {"javascript", "typescript"}, "knip": {"javascript", "typescript"}, "pyright": {"python"}, "ruff": {"python"}, "deptry": {"python"}, "vulture": {"python"}, "radon": {"python"}, "coverage.py": {"python"}}
ANY_LANGUAGE = {"semgrep", "jscpd", "lizard"}
MODES = ("default", "changed", "quick", "full")


def detected(tool: str, languages, lockfiles, hints, test_commands) -> bool:
    """Whether a tool fits the project, whatever the configuration says."""
    has = set(languages)
    detect = tools.ADDED[tool].detect if tool in tools.ADDED else None
    if detect:
        return bool(detect(languages, lockfiles, hints, test_commands))
    if tool == "osv-scanner":
        return bool(lockfiles)
    if tool in ANY_LANGUAGE:
        return bool(has)
    if tool in ("vitest", "jest"):
        return tool in hints or any(tool in t.lower() for t in test_commands)
    return tool not in NEEDS or bool(NEEDS[tool] & has)


def plan_sources(languages, lockfiles, hints, test_commands, config: Config, mode: str = "default") -> list[str]:
    """Ids of sources to run, in order: those of enabled checks that fit the project, registered ones
    last; quick mode has a list of its own. Sources not planned are never read."""
    c = config.checks
    enabled = {"security": c.security.enabled, "correctness": c.correctness.enabled, "dead_code": c.dead_code.enabled, "leftovers": c.leftovers.enabled, "refactor_readiness": c.refactor_readiness.enabled, "dependencies": c.dependencies.enabled}
    every = CATEGORY_OF | {t: a.category for t, a in tools.ADDED.items()}
    return [t for t, cat in every.items() if enabled.get(cat, True) and (mode != "quick" or t in QUICK) and detected(t, languages, lockfiles, hints, test_commands)]


@dataclass
class ScanResult:
    """Lazy tables of one scan; findings are cut once, as all else reads them."""

    findings: DataFrame
    statuses: DataFrame | None = None
    skipped: DataFrame | None = None
    test_commands: list[str] = field(default_factory=list)
    mode: str = "default"
    root: str = ""
    policy: Policy = Policy()

    @cached_property
    def overall(self) -> int:
        return fx.overall_score(self.findings).first()["overall"]

    @cached_property
    def category_scores(self) -> dict[str, float]:
        rows = {r["category"]: r["score_cents"] / 100 for r in fx.category_scores(self.findings).collect()}
        return {c: rows[c] for c in fx.PRIORITY}

    @property
    def ordered(self) -> DataFrame:
        return self.findings.orderBy(*fx.order())

    @property
    def blockers(self) -> DataFrame:
        return self.findings.where(fx.is_blocker()).orderBy(*fx.order())

    @property
    def fix_next(self) -> DataFrame:
        return fx.fix_next(self.findings)

    @property
    def top_findings(self) -> DataFrame:
        return fx.top_findings(self.findings)

    def of(self, category: str) -> DataFrame:
        return self.findings.where(F.col("category") == category).orderBy(*fx.order())

    def only(self, categories: list[str]) -> ScanResult:
        """The scan of some categories, scored and planned anew."""
        return replace(self, findings=fx.in_categories(self.findings, categories))


def detect(files: DataFrame, raw: DataFrame, config: Config, planned: list[str], root: str = "/project") -> DataFrame:
    """Findings of all planned sources, in their order by ord, then dead chains."""
    c = config.checks
    p = F.col("path")
    inside = files.where(matches_globs(p, list(config.paths.include), list(config.paths.exclude)))
    rules = tools.ToolRules(root, c.refactor_readiness.min_complexity, c.tests.min_coverage)
    parts = [tools.PARSERS[t](raw, rules).withColumn("ord", F.col("ord") + F.lit(i * tools.STRIDE)) for i, t in enumerate(tools.PARSERS) if t in planned]
    n = len(tools.PARSERS)
    if "custom-leftovers" in planned:
        found = leftovers(inside, LeftoverRules(c.leftovers.scan_comments, c.leftovers.scan_commented_code, c.leftovers.scan_legacy_fallbacks))
        parts.append(found.withColumn("ord", F.col("ord") + F.lit(n * tools.STRIDE)))
    if "custom-refactor" in planned:
        r = c.refactor_readiness
        tested = files.where(is_test_file(p)).limit(1).count() > 0
        found = refactor_candidates(inside, RefactorRules(r.min_file_lines, r.min_complexity, r.require_tests_before_refactor), tested)
        parts.append(found.withColumn("ord", F.col("ord") + F.lit((n + 1) * tools.STRIDE)))
    every = parts[0] if parts else fx.completed(raw.select(F.lit(0).alias("ord"))).where("false")
    for part in parts[1:]:
        every = every.unionByName(part)
    if not c.dead_code.enabled:
        return every
    every = cut(every)
    chains = dead_chains(files, every, c.dead_code.min_confidence_to_report)
    return every.unionByName(chains.withColumn("ord", F.col("ord") + F.lit((n + 2) * tools.STRIDE)))


def run_scan(files: DataFrame, raw: DataFrame, config: Config, project: Project, baseline: DataFrame | None = None, mode: str = "default", root: str = "/project", policy: Policy = Policy()) -> ScanResult:
    planned = plan_sources(project.languages, project.lockfiles, project.framework_hints, project.test_commands, config, mode)
    found = fx.merged(detect(files, raw, config, planned, root))
    if config.baseline.enabled and baseline is not None:
        found = fx.flagged(found, baseline)
    ours = raw.where(F.col("source").isin(*planned))
    return ScanResult(cut(found), tools.statuses(ours), tools.skipped(ours), list(project.test_commands), mode, root, policy)


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files among the changed ones (path): an option of its own. The changed mode of a scan
    itself takes all files."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


# --- gates ---------------------------------------------------------------------------


def gate_conditions(config: Config) -> dict[str, Column]:
    c, high = config.checks, fx.is_blocker()
    category, source = F.col("category"), F.col("source")
    vulnerable = (c.security.enabled and c.security.fail_on_new_high_vulnerabilities) or (c.dependencies.enabled and c.dependencies.fail_on_new_direct_vulnerabilities)
    on = lambda flag, cond: cond & F.lit(bool(flag))
    return {
        "secrets": on(c.security.enabled and c.security.fail_on_secrets, source == "gitleaks"),
        "dependencies": on(vulnerable, (category == "dependencies") & high),
        "missing": on(c.dependencies.enabled and c.dependencies.fail_on_missing_dependencies, (source == "deptry") & (F.col("title") == "DEP002")),
        "types": on(c.correctness.enabled and c.correctness.fail_on_type_errors, source.isin("tsc", "pyright") | ((category == "correctness") & high)),
        "tests": on(c.correctness.enabled and c.correctness.fail_on_test_failures, (category == "tests") & high),
    }


def gates(findings: DataFrame, config: Config) -> DataFrame:
    """One row of flags, from one pass over the findings that count."""
    counted = findings.where("is_new") if config.baseline.fail_only_on_new_issues else findings
    return counted.agg(*(F.coalesce(F.bool_or(cond), F.lit(False)).alias(n) for n, cond in gate_conditions(config).items()))


def exit_code(scan: ScanResult, config: Config) -> int:
    return 1 if scan.overall < config.score.minimum or any(gates(scan.findings, config).first()) else 0


# --- repair plan -----------------------------------------------------------------------

# Fixed values.
WORKFLOW = ("scan", "plan", "safe fix", "edit carefully", "verify", "scan again", "summarize")
RULES = ("Fix blockers before cleanup work.", "Do not delete low-confidence dead code.", "Do not refactor large files without tests.", "Do not lower test, lint, security, or coverage thresholds.")
PYTHON_TEST = r"(?i)(^|\s)(uv run |poetry run |pdm run |python -m )?pytest\b|\btox\b|\bnox\b"
JS_TEST = r"(?i)\b(npm|pnpm|yarn|bun)\b|\b(vitest|jest)\b"
PUBLIC = "Do not change public behavior unless required."
RESCAN = "codeweir scan --changed --report json"


def target_score(overall: int) -> int:
    return 85 if overall < 85 else min(100, overall + 5)


def allowed_actions(p: Policy) -> list[str]:
    some = [(True, "edit source files"), (True, "add tests"), (p.allow_safe_fix, "run safe fixes"), (p.allow_dead_code_delete, "delete verified high-confidence dead code"), (p.allow_dependency_upgrade, "upgrade dependencies with approval"), (p.allow_public_api_change, "change public APIs with approval")]
    return [text for on, text in some if on]


def forbidden_actions(p: Policy) -> list[str]:
    some = [(True, "disable tests"), (True, "lower thresholds"), (not p.allow_dead_code_delete, "delete low-confidence dead code"), (not p.allow_dependency_upgrade, "upgrade dependencies"), (not p.allow_public_api_change, "change public APIs without approval")]
    return [text for on, text in some if on]


def distinct_texts(*cols: Column) -> Column:
    texts = F.transform(F.array_compact(F.array(*cols)), lambda s: trim(s))
    return F.array_distinct(F.filter(texts, lambda s: s != ""))


def test_command(commands: list[str]) -> Column:
    """The command that verifies a finding, by its language."""
    import re

    known = list(dict.fromkeys(x.strip() for x in commands if x.strip()))
    python = next((x for x in known if re.search(PYTHON_TEST, x)), "pytest")
    script = next((x for x in known if re.search(JS_TEST, x)), known[0] if known else "npm test")
    file, tagged = F.coalesce("file", F.lit("")), lambda t: F.array_contains("tags", t)
    is_python = file.endswith(".py") | tagged("python")
    is_script = file.rlike(r"\.(ts|tsx|js|jsx)$") | tagged("typescript") | tagged("javascript")
    return F.when(is_python, python).when(is_script, script).otherwise(known[0] if known else "npm test")


def plan_tasks(findings: DataFrame, policy: Policy = Policy(), test_commands: list[str] | None = None, n: int = 5) -> DataFrame:
    """The first n findings as tasks: priority, id, title, files, instructions, verify,
    do_not_touch, commands."""
    first = fx.top(findings, n)
    # n rows are numbered, not the whole table.
    from pyspark.sql.window import Window

    rows = first.withColumn("priority", F.row_number().over(Window.orderBy(*fx.order())))
    by_category = F.when(F.col("category") == "dead_code", "Delete the code only after verifying there are no active runtime references.").when(F.col("category") == "leftovers", "Remove the stale path or marker after confirming it is no longer needed.").when(F.col("category") == "refactor_readiness", "Keep behavior stable and split the work into small, test-backed edits.").otherwise("Fix the issue without changing public behavior unless required.")
    hint = F.when(F.col("source") == "gitleaks", "Move the secret to an environment variable.").otherwise(F.coalesce("agent_instruction", by_category))
    none = F.array().cast("array<string>")
    verify = distinct_texts(test_command(test_commands or []) if policy.require_tests_after_edit else F.lit(None).cast("string"), F.lit(RESCAN if policy.require_scan_after_edit else None).cast("string"))
    commands = F.when(F.lit(policy.allow_safe_fix) & F.col("safe_to_autofix") & (F.length("fix_command") > 0), F.array("fix_command")).otherwise(none)
    return rows.select(
        "priority",
        F.concat(F.lit("task-"), F.col("priority").cast("string")).alias("id"),
        "title",
        F.when(F.length("file") > 0, F.array("file")).otherwise(none).alias("files"),
        distinct_texts(F.col("message"), hint, F.lit(PUBLIC)).alias("instructions"),
        verify.alias("verify"),
        (none if policy.allow_public_api_change else F.array(F.lit("Do not change public APIs without approval."))).alias("do_not_touch"),
        commands.alias("commands"),
    )


def agent_plan(scan: ScanResult, target: str = "generic") -> dict:
    """The plan of one scan: at most five tasks, and the tools that were skipped."""
    tasks = [{"id": r["id"], "title": r["title"], "priority": r["priority"], "files": list(r["files"]), "instructions": list(r["instructions"]), "verify": list(r["verify"]), "doNotTouch": list(r["do_not_touch"]), "commands": list(r["commands"])} for r in plan_tasks(scan.findings, scan.policy, scan.test_commands).orderBy("priority").collect()]
    missing = [r["id"] for r in scan.skipped.collect()] if scan.skipped is not None else []
    return {
        "goal": f"Raise health score from {scan.overall} to {target_score(scan.overall)}",
        "target": target,
        "workflow": list(WORKFLOW),
        "rules": list(RULES),
        "allowedActions": allowed_actions(scan.policy),
        "forbiddenActions": forbidden_actions(scan.policy),
        "doNotTouch": [f"Do not assume {x} was fully checked because the tool was skipped." for x in missing],
        "tasks": tasks,
    }


def explain(scan: ScanResult, finding_id: str) -> dict:
    """The first finding of an id, what to do, and the findings related to it."""
    found = scan.findings.where(F.col("id") == finding_id).orderBy(*fx.order()).limit(1).collect()
    if not found:
        return {"finding": None, "suggestions": ["Check the finding ID from `codeweir scan --report json`.", "Use `codeweir agent-plan` to see the current priority list."], "related": None}
    f = found[0]
    said = [f["agent_instruction"], f"Run: {f['fix_command']}" if f["fix_command"] else None, "Rotate any exposed credential after removing it from source." if f["source"] == "gitleaks" else None]
    return {"finding": f, "suggestions": list(dict.fromkeys(s.strip() for s in said if s and s.strip())), "related": fx.related(scan.findings, finding_id)}


#: What fixes that which is safe to fix.
FIXES = {"biome": "biome check . --write", "ruff": "ruff check . --fix && ruff format ."}


def fix_commands(languages, lockfiles, hints, test_commands) -> list[tuple[str, str]]:
    """Safe fixes of the tools that fit the project, in order, whichever checks are on."""
    known = FIXES | {t: a.fix for t, a in tools.ADDED.items() if a.fix}
    return [(t, line) for t, line in known.items() if detected(t, languages, lockfiles, hints, test_commands)]


def fixed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after, fixed: counts of findings, never less than none fixed."""
    one = before.agg(F.count(F.lit(1)).alias("before")).withColumn("k", F.lit(1))
    two = after.agg(F.count(F.lit(1)).alias("after")).withColumn("k", F.lit(1))
    return one.join(two, "k").select("before", "after", F.greatest(F.lit(0).cast("long"), F.col("before") - F.col("after")).alias("fixed"))


def changed_files(root: str) -> list[str]:
    """Paths changed since the base branch, by plain git; none outside a repository."""

    def git(*args: str) -> str:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=False)
        return done.stdout if done.returncode == 0 else ""

    if git("rev-parse", "--is-inside-work-tree").strip() != "true":
        return []
    base = next((x for ref in ("origin/main", "main", "origin/master", "master") if (x := git("merge-base", "HEAD", ref).strip())), "")
    return [x.strip() for x in git("diff", "--name-only", f"{base}...HEAD" if base else "HEAD").splitlines() if x.strip()]


def is_dirty(root: str) -> bool:
    done = subprocess.run(["git", "status", "--porcelain"], cwd=root, capture_output=True, text=True, check=False)
    return done.returncode == 0 and bool(done.stdout.strip())


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], tools.RAW)
