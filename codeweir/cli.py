"""Commands: scan, verify, report, agent-plan, explain, baseline, fix, init, agent, setup, mcp."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from codeweir.operators.findings import parse_categories
from codeweir.plans import reports
from codeweir.plans.assets import agent_init, doctor
from codeweir.plans.scan import ScanResult, agent_plan, changed_only, changed_files, exit_code, explain, fix_commands, is_dirty, plan_sources, run_scan
from codeweir.plans.setup import render_setup, setup_plan
from codeweir.sources import tools
from codeweir.sources.config import HOME, load_config, load_policy, read_baseline, write_baseline_file
from codeweir.sources.files import read_files
from codeweir.sources.project import detect_project, search_path
from codeweir.sources.runner import run_tools

RENDER = {"terminal": reports.terminal_report, "json": reports.json_report, "html": reports.html_report, "markdown": reports.markdown_report, "sarif": reports.sarif_report}


def session() -> SparkSession:
    return SparkSession.builder.appName("codeweir").getOrCreate()


def raw_outputs(spark: SparkSession, root: str, planned: list[str] | None = None) -> DataFrame:
    """Outputs that a landing folder holds as JSON lines; without it, those of the planned tools,
    which are run. A coverage summary that the project has goes before the outputs of its
    test runners, which aren't run then."""
    folder, summary = os.path.join(root, HOME, "raw"), os.path.join(root, "coverage", "coverage-summary.json")
    covered = os.path.exists(summary)
    if os.path.isdir(folder):
        raw = spark.read.schema(tools.RAW_RUN).json(folder)
    else:
        raw = run_tools(spark, root, [t for t in planned or [] if not (covered and t in ("vitest", "jest"))])
    if not covered:
        return raw
    return tools.with_existing_coverage(raw, spark.read.text(summary, wholetext=True))


def scanned(spark: SparkSession, root: str, mode: str = "default", only_changed: bool = False) -> tuple[ScanResult, object]:
    config, _ = load_config(root)
    files = read_files(spark, root).cache()
    project = detect_project(files)
    if only_changed:
        changed = [(p,) for p in changed_files(root)]
        files = changed_only(files, spark.createDataFrame(changed, "path string"))
    base = read_baseline(spark, os.path.join(root, config.baseline.file)) if config.baseline.enabled else None
    planned = plan_sources(project.languages, project.lockfiles, project.framework_hints, project.test_commands, config, mode)
    return run_scan(files, raw_outputs(spark, root, planned), config, project, base, mode, root, load_policy(root)), config


def write_artifacts(root: str, config, scan: ScanResult) -> None:
    for path, text in ((config.output.json, reports.json_report(scan)), (config.output.html, reports.html_report(scan)), (config.output.agent, reports.agent_markdown(agent_plan(scan)))):
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)


def render(scan: ScanResult, kind: str, target: str = "generic") -> str:
    if kind in ("agent", "agent-json"):
        plan = agent_plan(scan, target)
        return reports.agent_markdown(plan) if kind == "agent" else json.dumps(plan, indent=2)
    return RENDER[kind](scan)


def explained(scan: ScanResult, finding_id: str) -> str:
    got = explain(scan, finding_id)
    f = got["finding"]
    if f is None:
        return "Finding not found.\nSuggestions:\n- " + "\n- ".join(got["suggestions"]) + "\n"
    out = [f"Finding: {f['id']}", f"Title: {f['title']}", f"Severity: {f['severity']}", f"Category: {f['category']}", f"File: {f['file'] or 'n/a'}", f"Message: {f['message']}", "", "Suggestions:", *(f"- {s}" for s in got["suggestions"])]
    from codeweir.operators.findings import top

    near = [f"- {r['title']}: {r['message']}" for r in top(got["related"], 5).collect()]
    return "\n".join([*out, *(["", "Related findings:", *near] if near else [])]) + "\n"


def init(root: str) -> str:
    """A configuration of defaults and an empty baseline."""
    path = os.path.join(root, "codeweir.yml")
    rows = ["version: 1", "", "profile: startup", "", "paths:", "  include:", *(f"    - {x}/**" for x in ("src", "app", "packages", "services")), "", "baseline:", "  enabled: true", f"  file: {HOME}/baseline.json", "  fail_only_on_new_issues: true", "", "score:", "  minimum: 80", ""]
    os.makedirs(os.path.join(root, HOME), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows))
    with open(os.path.join(root, HOME, "baseline.json"), "w", encoding="utf-8") as f:
        json.dump({"createdAt": datetime.now(UTC).isoformat(), "findings": []}, f, indent=2)
    return path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("codeweir")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args, **more):
        c = sub.add_parser(name)
        c.add_argument("--root", default=".")
        for flags, kw in args:
            c.add_argument(*flags, **kw)
        return c

    flag = {"action": "store_true"}
    command("scan", (["--changed"], flag), (["--quick"], flag), (["--full"], flag), (["--only-changed-files"], flag), (["--category"], {}), (["--report"], {"default": "terminal", "choices": [*RENDER, "agent", "agent-json"]}))
    command("verify")
    command("report", (["--format"], {"default": "json", "choices": [*RENDER, "agent", "agent-json"]}))
    command("agent-plan", (["--target"], {"default": "generic"}))
    command("explain", (["id"], {}))
    command("baseline", (["action"], {"choices": ["create"]}))
    command("fix", (["--safe"], flag))
    command("init")
    command("agent", (["action"], {"choices": ["init", "sync", "doctor"]}), (["--force"], flag))
    command("mcp")
    command("setup", (["--include"], {"default": "recommended"}), (["--apply"], flag))
    a = p.parse_args(argv)
    root = os.path.abspath(a.root)
    if a.command == "init":
        print(init(root))
        return 0
    if a.command == "agent":
        # sync: the managed files anew, whatever they hold.
        found = doctor(root) if a.action == "doctor" else agent_init(root, a.force or a.action == "sync")
        print(json.dumps(found, indent=2))
        return 0 if a.action != "doctor" or all(found.values()) else 1
    if a.command == "mcp":
        from codeweir.mcp import serve

        serve(root, sys.stdin.buffer, sys.stdout.buffer)
        return 0
    categories = parse_categories(getattr(a, "category", None))
    spark = session()
    if a.command == "setup":
        project = detect_project(read_files(spark, root))
        plan = setup_plan(project, a.include)
        for c in plan.commands if a.apply else []:
            subprocess.run(c, cwd=root, env=os.environ | {"PATH": search_path(root)}, timeout=180, check=False)
        print(render_setup(plan, a.include))
        return 0
    mode = "changed" if a.command == "verify" or getattr(a, "changed", False) else "quick" if getattr(a, "quick", False) else "full" if a.command in ("report", "baseline") or getattr(a, "full", False) else "default"
    scan, config = scanned(spark, root, mode, getattr(a, "only_changed_files", False))
    if a.command in ("scan", "verify"):
        scan = scan if categories is None else scan.only(categories)
        write_artifacts(root, config, scan)
        print(render(scan, getattr(a, "report", "terminal")), end="")
        return exit_code(scan, config)
    if a.command == "baseline":
        print(write_baseline_file(scan.findings, os.path.join(root, config.baseline.file)))
    elif a.command == "fix":
        before = scan.findings.count()
        fixes = fix_commands(*_profile(spark, root))
        lines = ["Warning: working tree has uncommitted changes." if is_dirty(root) else "Working tree looks clean.", "", "Safe fix results:"]
        for tool, line in fixes:
            done = subprocess.run(line, shell=True, cwd=root, env=os.environ | {"PATH": search_path(root)}, timeout=180, check=False, capture_output=True)
            lines.append(f"- {tool}: {'ok' if done.returncode == 0 else 'skipped' if done.returncode == 127 else 'error'}")
        after = scanned(spark, root)[0].findings.count() if fixes else before
        print("\n".join([*lines, "", f"Before: {before} findings", f"After: {after} findings"]))
    else:
        print(render(scan, "agent", a.target) if a.command == "agent-plan" else explained(scan, a.id) if a.command == "explain" else render(scan, a.format), end="")
    return 0


def _profile(spark: SparkSession, root: str):
    p = detect_project(read_files(spark, root))
    return p.languages, p.lockfiles, p.framework_hints, p.test_commands


if __name__ == "__main__":
    sys.exit(main())
