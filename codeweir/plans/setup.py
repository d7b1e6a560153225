"""The catalogue of tools and the plan to install those that a project lacks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codeweir.sources.project import Project


@dataclass(frozen=True)
class Tool:
    id: str
    ecosystem: str
    priority: str
    languages: tuple[str, ...] = ()
    package: str | None = None
    executable: str | None = None
    needs_lockfile: bool = False


# Fixed values.
JS, PY = ("javascript", "typescript"), ("python",)
CATALOG = (
    Tool("custom-leftovers", "built-in", "essential"),
    Tool("custom-dead-chain", "built-in", "essential"),
    Tool("custom-refactor", "built-in", "essential"),
    Tool("tsc", "npm", "essential", ("typescript",), "typescript", "tsc"),
    Tool("biome", "npm", "essential", JS, "@biomejs/biome", "biome"),
    Tool("knip", "npm", "essential", JS, "knip", "knip"),
    Tool("ruff", "python", "essential", PY, "ruff", "ruff"),
    Tool("pyright", "python", "essential", PY, "pyright", "pyright"),
    Tool("vulture", "python", "essential", PY, "vulture", "vulture"),
    Tool("gitleaks", "manual", "essential", (), None, "gitleaks"),
    Tool("osv-scanner", "manual", "essential", (), None, "osv-scanner", True),
    Tool("jscpd", "npm", "recommended", JS, "jscpd", "jscpd"),
    Tool("coverage.py", "python", "recommended", PY, "coverage", "coverage"),
    Tool("radon", "python", "recommended", PY, "radon", "radon"),
    Tool("deptry", "python", "recommended", PY, "deptry", "deptry"),
    Tool("lizard", "manual", "recommended", (), None, "lizard"),
    Tool("semgrep", "manual", "recommended", (), None, "semgrep"),
)
INCLUDES = ("essential", "recommended", "all", "npm", "python", "manual", "built-in")
JS_MANAGERS = {"pnpm": ("pnpm", "add", "-D"), "yarn": ("yarn", "add", "-D"), "bun": ("bun", "add", "-d"), "npm": ("npm", "install", "-D")}
PY_MANAGERS = {"uv": ("uv", "add", "--dev"), "poetry": ("poetry", "add", "--group", "dev"), "pdm": ("pdm", "add", "-dG", "dev")}


def setup_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.id, t.ecosystem, t.priority, t.executable) for t in CATALOG], "id string, ecosystem string, priority string, executable string")


@dataclass(frozen=True)
class SetupPlan:
    built_in: list[str]
    available: list[str]
    commands: list[list[str]]
    manual: list[str]
    skipped: list[str]


def setup_plan(project: Project, include: str = "recommended", has_venv: bool | None = None) -> SetupPlan:
    """Tools of the include level that fit the project: those there, commands for the rest."""
    if include not in INCLUDES:
        raise ValueError(f"unknown include level: {include}")
    chosen = [t for t in CATALOG if include in ("recommended", "all") or include in (t.priority, t.ecosystem)]
    fit = [t for t in chosen if (not t.languages or set(t.languages) & set(project.languages)) and (not t.needs_lockfile or project.lockfiles)]
    outside = [t for t in fit if t.ecosystem != "built-in"]
    there = [t for t in outside if project.tools.get(t.executable or "", project.tools.get(t.id, False))]
    missing = [t for t in outside if t not in there]
    of = lambda kind: [t for t in missing if t.ecosystem == kind]
    commands, skipped = [], []
    if of("npm"):
        manager = next((m for m in JS_MANAGERS if m in project.package_managers), None)
        if manager:
            commands.append([*JS_MANAGERS[manager], *(t.package for t in of("npm"))])
        else:
            skipped += [t.id for t in of("npm")]
    if of("python"):
        venv = bool(os.environ.get("VIRTUAL_ENV")) if has_venv is None else has_venv
        manager = next((m for m in PY_MANAGERS if m in project.package_managers), None)
        if manager or venv:
            commands.append([*(PY_MANAGERS[manager] if manager else ("python", "-m", "pip", "install", "-U")), *(t.package for t in of("python"))])
        else:
            skipped += [t.id for t in of("python")]
    return SetupPlan([t.id for t in fit if t.ecosystem == "built-in"], [t.id for t in there], commands, [t.id for t in of("manual")], skipped)


def render_setup(plan: SetupPlan, include: str = "recommended") -> str:
    out = ["Codeweir setup", "", f"Install set: {include}", ""]
    for title, names in (("Already built in", plan.built_in), ("Already available", plan.available), ("Automatable installs", [" ".join(c) for c in plan.commands]), ("Manual installs", plan.manual), ("Skipped until project setup exists", plan.skipped)):
        out += [title, *(f"- {n}" for n in names), ""] if names else []
    return "\n".join(out) + "\n"
