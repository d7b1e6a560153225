"""Profile of a project from its paths: one aggregation over (path), and the metadata of
its package file."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lockb", "uv.lock", "poetry.lock", "pdm.lock")
CONFIG_FILES = ("package.json", "tsconfig.json", "biome.json", ".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", "jest.config.js", "jest.config.cjs", "jest.config.ts", "vitest.config.ts", "vitest.config.js", "pyproject.toml", "requirements.txt", "uv.lock", "poetry.lock", "pdm.lock", "pytest.ini", "ruff.toml", "mypy.ini", "pyrightconfig.json")
KNOWN_TOOLS = ("ruff", "biome", "knip", "vulture", "gitleaks", "osv-scanner", "semgrep", "tsc", "pyright", "eslint", "jest", "vitest", "coverage")
ENTRY = r"(^|/)(main|index|app|server|cli)\.(ts|tsx|js|jsx|py)$"
HINTED = {"next": "nextjs", "react": "react", "express": "express", "vitest": "vitest", "jest": "jest"}


def profile(files: DataFrame) -> DataFrame:
    """One row: languages, package_managers, framework_hints, config_files, lockfiles (sorted or
    in fixed order), has_tests, has_python_tests. Sets of a bounded number of names; the
    aggregation is partial in every task."""
    p = F.col("path")
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    has = lambda name: some(p == name)
    listed = lambda pairs: F.array_compact(F.array(*(F.when(c, n) for n, c in pairs)))
    js = F.when(has("pnpm-lock.yaml"), "pnpm").when(has("yarn.lock"), "yarn").when(has("bun.lockb"), "bun").otherwise("npm")
    py = F.when(has("uv.lock"), "uv").when(has("poetry.lock"), "poetry").when(has("pdm.lock"), "pdm").otherwise("pip")
    managers = F.sort_array(F.array_compact(F.array(F.when(has("package.json"), js), F.when(has("requirements.txt") | has("pyproject.toml"), py))))
    return files.agg(
        listed([("javascript", some(p.rlike(r"\.jsx?$"))), ("python", some(p.endswith(".py"))), ("typescript", some(p.rlike(r"\.tsx?$")))]).alias("languages"),
        managers.alias("package_managers"),
        listed([("django", some(p.rlike(r"(?i)manage\.py|django"))), ("python-web", some(p.rlike("(?i)fastapi|flask")))]).alias("framework_hints"),
        listed([(n, has(n)) for n in CONFIG_FILES]).alias("config_files"),
        listed([(n, has(n)) for n in LOCKFILES]).alias("lockfiles"),
        some(p.rlike(r"(^|/)tests?/|\.test\.")).alias("has_tests"),
        (has("pytest.ini") | some(p.rlike(r"(^|/)tests?/") & p.endswith(".py"))).alias("has_python_tests"),
    )


def entry_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(ENTRY) | (F.col("path") == "package.json")).select("path")


def package_metadata(packages: DataFrame, manager: Column) -> DataFrame:
    """path, test_commands, framework_hints of package.json files (path, content)."""
    kind = "struct<scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, workspaces string>"
    read = packages.withColumn("pkg", F.from_json("content", kind))
    name, plain = lambda e: e["key"], lambda e: e["key"] == "test"
    command = lambda e: F.when(manager.isin("pnpm", "yarn"), F.when(plain(e), F.concat(manager, F.lit(" test"))).otherwise(F.concat(manager, F.lit(" run "), name(e)))).when(manager == "bun", F.concat(F.lit("bun run "), name(e))).otherwise(F.when(plain(e), "npm test").otherwise(F.concat(F.lit("npm run "), name(e))))
    tests = F.filter(F.map_entries("pkg.scripts"), lambda e: e["key"].rlike("(?i)test|vitest|jest|pytest") | e["value"].rlike("(?i)vitest|jest|pytest"))
    none = F.array().cast("array<string>")
    used = lambda dep: F.coalesce(F.map_contains_key("pkg.dependencies", dep), F.lit(False)) | F.coalesce(F.map_contains_key("pkg.devDependencies", dep), F.lit(False))
    hints = F.array_compact(F.array(*(F.when(used(d), h) for d, h in HINTED.items()), F.when(F.col("pkg.workspaces").isNotNull(), "monorepo")))
    return read.select("path", F.coalesce(F.transform(tests, command), none).alias("test_commands"), hints.alias("framework_hints"))


@dataclass(frozen=True)
class Project:
    languages: tuple[str, ...]
    package_managers: tuple[str, ...]
    framework_hints: tuple[str, ...]
    config_files: tuple[str, ...]
    lockfiles: tuple[str, ...]
    test_commands: tuple[str, ...]
    tools: dict[str, bool]
    has_tests: bool


def detect_project(files: DataFrame) -> Project:
    """The profile of one project on the driver: two small rows."""
    p = profile(files).first()
    js = next((m for m in ("npm", "pnpm", "yarn", "bun") if m in p["package_managers"]), "npm")
    meta = package_metadata(files.where("path = 'package.json'"), F.lit(js)).first()
    commands = list(meta["test_commands"]) if meta else []
    if p["has_python_tests"]:
        runner = next((f"{m} run pytest" for m in ("uv", "poetry", "pdm") if m in p["package_managers"]), "pytest")
        commands.append(runner)
    hints = sorted({*p["framework_hints"], *(meta["framework_hints"] if meta else [])})
    return Project(tuple(p["languages"]), tuple(p["package_managers"]), tuple(hints), tuple(p["config_files"]), tuple(p["lockfiles"]), tuple(dict.fromkeys(commands)), {t: available(t) for t in KNOWN_TOOLS}, p["has_tests"])


def search_path(root: str) -> str:
    """PATH, after the tool folders of root and its parents."""
    found, at = [], os.path.abspath(root)
    while True:
        found += [os.path.join(at, *x) for x in (("node_modules", ".bin"), (".venv", "bin"), (".venv", "Scripts"), ("venv", "bin"), ("venv", "Scripts"))]
        if os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    return os.pathsep.join([*found, os.environ.get("PATH", "")])


def available(tool: str, root: str = ".") -> bool:
    import shutil

    return shutil.which(tool, path=search_path(root)) is not None


__all__ = ["Project", "available", "detect_project", "entry_files", "json", "package_metadata", "profile", "re", "search_path"]
