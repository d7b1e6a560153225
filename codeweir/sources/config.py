"""Configuration, policy and baseline files: driver-side, small."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.operators.findings import fingerprint
from codeweir.sources.files import DEFAULT_EXCLUDES

CONFIG_FILES = ("codeweir.yml", "codeweir.yaml", "codeweir.json")
HOME = ".codeweir"


@dataclass(frozen=True)
class Paths:
    include: tuple[str, ...] = ("src/**", "app/**", "packages/**", "services/**", "tests/**", "*.{js,jsx,ts,tsx,py}", "**/*.{js,jsx,ts,tsx,py}")
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES


@dataclass(frozen=True)
class Baseline:
    enabled: bool = True
    file: str = f"{HOME}/baseline.json"
    fail_only_on_new_issues: bool = True


@dataclass(frozen=True)
class Score:
    minimum: int = 80


@dataclass(frozen=True)
class Security:
    enabled: bool = True
    fail_on_secrets: bool = True
    fail_on_new_high_vulnerabilities: bool = True


@dataclass(frozen=True)
class Correctness:
    enabled: bool = True
    fail_on_type_errors: bool = True
    fail_on_test_failures: bool = True


@dataclass(frozen=True)
class DeadCode:
    enabled: bool = True
    min_confidence_to_report: str = "medium"


@dataclass(frozen=True)
class Leftovers:
    enabled: bool = True
    scan_comments: bool = True
    scan_commented_code: bool = True
    scan_legacy_fallbacks: bool = True


@dataclass(frozen=True)
class RefactorReadiness:
    enabled: bool = True
    min_file_lines: int = 500
    min_complexity: int = 15
    require_tests_before_refactor: bool = True


@dataclass(frozen=True)
class Tests:
    enabled: bool = True
    min_coverage: float = 70
    min_changed_code_coverage: float = 80


@dataclass(frozen=True)
class Dependencies:
    enabled: bool = True
    fail_on_missing_dependencies: bool = True
    fail_on_new_direct_vulnerabilities: bool = True


@dataclass(frozen=True)
class Checks:
    security: Security = Security()
    correctness: Correctness = Correctness()
    dead_code: DeadCode = DeadCode()
    leftovers: Leftovers = Leftovers()
    refactor_readiness: RefactorReadiness = RefactorReadiness()
    tests: Tests = Tests()
    dependencies: Dependencies = Dependencies()


@dataclass(frozen=True)
class Output:
    json: str = f"{HOME}/report.json"
    html: str = f"{HOME}/report.html"
    agent: str = f"{HOME}/agent-plan.md"


@dataclass(frozen=True)
class Config:
    version: int = 1
    profile: str = "startup"
    paths: Paths = Paths()
    baseline: Baseline = Baseline()
    score: Score = Score()
    checks: Checks = Checks()
    output: Output = Output()


@dataclass(frozen=True)
class Policy:
    allow_safe_fix: bool = True
    allow_dead_code_delete: bool = False
    allow_dependency_upgrade: bool = False
    allow_public_api_change: bool = False
    require_tests_after_edit: bool = True
    require_scan_after_edit: bool = True
    approval_required: tuple[str, ...] = field(default=("delete_file", "remove_backward_compatibility", "upgrade_dependency", "refactor_security_sensitive_file", "modify_ci_thresholds"))


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def overlaid(base, given: dict):
    """base with the values of given (names in camel or snake case). Records go down, lists
    replace, missing or unknown names keep or are left out."""
    values, named = {}, {snake(k): v for k, v in (given or {}).items()}
    for f in fields(base):
        if f.name not in named or named[f.name] is None:
            continue
        old, new = getattr(base, f.name), named[f.name]
        values[f.name] = overlaid(old, new) if is_dataclass(old) and isinstance(new, dict) else old if is_dataclass(old) else tuple(map(str, new)) if isinstance(old, tuple) and isinstance(new, (list, tuple)) else old if isinstance(old, tuple) else new
    return replace(base, **values)


def read_yaml(text: str):
    """Maps, lists of scalars and scalars by indentation: what configuration needs."""
    rows = [(len(line) - len(line.lstrip()), line.strip()) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]

    def scalar(s: str):
        s = s.strip() if s.strip()[:1] in "\"'" else re.sub(r"\s+#.*$", "", s).strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", s[1:-1])]
        known = {"true": True, "false": False, "null": None, "~": None, "": None}
        if s in known:
            return known[s]
        return int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s

    def block(at: int, depth: int):
        if at < len(rows) and rows[at][1].startswith("- "):
            items = []
            while at < len(rows) and rows[at][0] == depth and rows[at][1].startswith("- "):
                items.append(scalar(rows[at][1][2:]))
                at += 1
            return items, at
        made: dict = {}
        while at < len(rows) and rows[at][0] == depth:
            key, _, rest = rows[at][1].partition(":")
            key, at = scalar(key), at + 1
            if rest.strip():
                made[key] = scalar(rest)
            elif at < len(rows) and (rows[at][0] > depth or (rows[at][0] == depth and rows[at][1].startswith("- "))):
                made[key], at = block(at, rows[at][0])
            else:
                made[key] = None
        return made, at

    return block(0, rows[0][0])[0] if rows else {}


def load_config(root: str) -> tuple[Config, str | None]:
    """The first of the known files there is, over the defaults."""
    for name in CONFIG_FILES:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                text = f.read()
            given = json.loads(text) if name.endswith(".json") else read_yaml(text)
            return overlaid(Config(), given if isinstance(given, dict) else {}), path
    return Config(), None


def load_policy(root: str) -> Policy:
    path = os.path.join(root, HOME, "agent-policy.yml")
    if not os.path.exists(path):
        return Policy()
    with open(path, encoding="utf-8") as f:
        given = read_yaml(f.read())
    if not isinstance(given, dict):
        return Policy()
    rules = given.get("agentPolicy") or given.get("agent_policy") or {}
    approval = given.get("approvalRequired") or given.get("approval_required")
    return overlaid(Policy(), (rules if isinstance(rules, dict) else {}) | ({"approval_required": approval} if isinstance(approval, list) else {}))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint of a baseline: a JSON file {createdAt, findings: [{fingerprint}]}, or the
    folder of a table written by write_baseline_table(). A missing path is an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], "fingerprint string")
    if fs.getFileStatus(at).isDirectory():
        return spark.read.schema("fingerprint string").parquet(path)
    rows = spark.read.schema("createdAt string, findings array<struct<fingerprint string>>").json(path, multiLine=True)
    return rows.select(F.explode("findings.fingerprint").alias("fingerprint"))


def write_baseline_table(findings: DataFrame, path: str) -> None:
    """Fingerprints as a distributed table, for results of any size."""
    findings.select(fingerprint().alias("fingerprint")).distinct().write.mode("overwrite").parquet(path)


def write_baseline_file(findings: DataFrame, path: str) -> int:
    """A baseline of one project as one JSON file, in the order of ord."""
    prints = [r[0] for r in findings.orderBy("ord").select(fingerprint()).toLocalIterator()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"createdAt": datetime.now(UTC).isoformat(), "findings": [{"fingerprint": p} for p in prints]}, f, indent=2)
    return len(prints)
