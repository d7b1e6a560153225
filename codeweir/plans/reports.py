"""Reports of a scan. Distributed forms (JSON lines, SARIF results) are columns; documents
of one project are rendered on the driver from rows streamed in report order."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.plans.scan import ScanResult, agent_plan
from codeweir.sources.json_array import write_array

TITLE = "Codeweir"
KEYS = {"id": "id", "source": "source", "category": "category", "severity": "severity", "confidence": "confidence", "title": "title", "message": "message", "file": "file", "start_line": "startLine", "end_line": "endLine", "is_new": "isNew", "is_autofixable": "isAutofixable", "safe_to_autofix": "safeToAutofix", "fix_command": "fixCommand", "agent_instruction": "agentInstruction", "tags": "tags", "evidence": "evidence", "score_impact": "scoreImpact"}
EVIDENCE_KEYS = {"snippet": "snippet", "tool_raw_id": "toolRawId", "matched_pattern": "matchedPattern"}


def finding_json() -> Column:
    """A finding as one JSON object; missing fields are left out."""
    ev = F.when(F.col("evidence").isNotNull(), F.struct(*(F.col(f"evidence.{k}").alias(v) for k, v in EVIDENCE_KEYS.items())))
    return F.to_json(F.struct(*((ev if k == "evidence" else F.col(k)).alias(v) for k, v in KEYS.items())))


def sarif_result() -> Column:
    """A finding as a SARIF 2.1.0 result."""
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation")))
    level = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    return F.to_json(F.struct(F.col("id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(F.length("file") > 0, place).alias("locations")))


def streamed(df: DataFrame) -> Iterator:
    """Rows to the driver, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def plain(value: float) -> float | int:
    return int(value) if value == int(value) else value


def finding_dict(row) -> dict:
    out = {v: row[k] for k, v in KEYS.items() if k not in ("evidence", "tags") and row[k] is not None}
    out["tags"] = list(row["tags"])
    if row["evidence"] is not None:
        out["evidence"] = {v: row["evidence"][k] for k, v in EVIDENCE_KEYS.items() if row["evidence"][k] is not None}
    out["scoreImpact"] = plain(row["score_impact"])
    return {k: out[k] for k in KEYS.values() if k in out}


def status_dicts(df: DataFrame | None) -> list[dict]:
    names = {"install_hint": "installHint"}
    return [{names.get(k, k): v for k, v in r.asDict().items() if v is not None} for r in df.collect()] if df is not None else []


def json_report(scan: ScanResult) -> str:
    made = {
        "score": scan.overall,
        "categoryScores": {c: plain(scan.category_scores[c]) for c in ("security", "correctness", "dead_code", "leftovers", "maintainability", "dependencies", "tests", "efficiency", "refactor_readiness")},
        "findings": [finding_dict(r) for r in streamed(scan.ordered)],
        "topFindings": [finding_dict(r) for r in scan.top_findings.collect()],
        "toolStatuses": status_dicts(scan.statuses),
        "skippedTools": status_dicts(scan.skipped),
        "agentPlan": agent_plan(scan),
    }
    return json.dumps(made, indent=2, ensure_ascii=False).replace("\n", os.linesep) + os.linesep


def sarif_report(scan: ScanResult) -> str:
    results = [json.loads(r[0]) for r in streamed(scan.ordered.select(sarif_result()))]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": TITLE}}, "results": results}]}, indent=2, ensure_ascii=False)


def counts(scan: ScanResult) -> dict[str, int]:
    """The numbers of a summary, in one pass."""
    c = F.col("category")
    row = scan.findings.agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("Blockers"),
        F.least(F.lit(3), F.count_if(c != "leftovers")).alias("Fix next"),
        F.count_if(c == "leftovers").alias("Leftovers"),
        F.count_if(c == "dead_code").alias("Dead code candidates"),
        F.count_if(c == "refactor_readiness").alias("Refactor candidates"),
    ).first()
    return row.asDict()


def at(row, mark: str = "({})") -> str:
    return f" {mark.format(row['file'])}" if row["file"] else ""


def summary_lines(scan: ScanResult) -> list[str]:
    out = [f"Health: {scan.overall}/100 {'✅' if scan.overall >= 85 else '⚠️'}", ""]
    out += [f"{k}: {v}" for k, v in counts(scan).items()]

    def section(title: str, rows, text) -> None:
        listed = [f"{i}. {text(r)}" for i, r in enumerate(rows, 1)]
        if listed:
            out.extend(["", title, *listed])

    section("BLOCKERS", streamed(scan.blockers), lambda r: r["message"] + at(r))
    section("FIX NEXT", scan.fix_next.collect(), lambda r: r["title"] + at(r))
    section("LEFTOVERS", streamed(scan.of("leftovers")), lambda r: r["title"] + at(r))
    section("DEAD CHAINS", streamed(scan.of("dead_code")), lambda r: r["message"])
    section("SKIPPED TOOLS", status_dicts(scan.skipped), lambda r: r["id"] + (f" — {r['installHint']}" if r.get("installHint") else ""))
    section("ERRORED TOOLS", [s for s in status_dicts(scan.statuses) if s["status"] in ("error", "timeout")], lambda r: f"{r['id']} — {r.get('message') or r['status']}")
    return [*out, "", "READY FOR AGENT", "Run:", "codeweir agent-plan"]


def terminal_report(scan: ScanResult) -> str:
    return os.linesep.join(summary_lines(scan)) + os.linesep + "\n"


def markdown_report(scan: ScanResult) -> str:
    code = " — `{}`"
    place = lambda r: code.format(r["file"]) if r["file"] else ""
    out = [f"# {TITLE} Report", "", f"Health: **{scan.overall}/100**", "", "## Summary", *(f"- {k}: {v}" for k, v in counts(scan).items()), "", "## Blockers"]
    out += [f"- {r['title']}{place(r)}: {r['message']}" for r in streamed(scan.blockers)] or ["- None"]
    out += ["", "## Fix next", *(f"- {r['title']}{place(r)}" for r in scan.fix_next.collect())]
    dead = [f"- {r['title']}{place(r)}: {r['message']}" for r in scan.of("dead_code").limit(5).collect()]
    missing = [f"- {r['id']}" + (f" — {r['installHint']}" if r.get("installHint") else "") for r in status_dicts(scan.skipped)]
    out += ["", "## Dead chains and dead code", *dead] if dead else []
    out += ["", "## Skipped tools", *missing] if missing else []
    out += ["", "## Agent tasks", *(f"- {t['title']}" for t in agent_plan(scan)["tasks"])]
    return "\n".join(out) + "\n"


STYLE = "body{font:15px sans-serif;margin:2em auto;max-width:60em}.meta{color:#666}.score{font-size:1.5em}.pill{background:#eee;border-radius:1em;margin-right:.5em;padding:.2em .7em}"


def html_report(scan: ScanResult) -> str:
    esc = lambda s: html.escape(str(s), quote=False)
    colours = {"critical": "#b91c1c", "high": "#dc2626", "medium": "#d97706"}

    def listed(title: str, rows) -> str:
        items = []
        for r in rows:
            where = f" <code>{esc(r['file'])}{':' + str(r['start_line']) if r['start_line'] else ''}</code>" if r["file"] else ""
            items.append(f'<li><strong style="color:{colours.get(r["severity"], "#4b5563")}">{esc(r["title"])}</strong> ({r["severity"]}, {r["confidence"]}){where}<br>{esc(r["message"])}</li>')
        return f"<h3>{title} ({len(items)})</h3><ul>{''.join(items)}</ul>" if items else ""

    def tool_list(title: str, rows: list[dict]) -> str:
        items = [f"<li><strong>{esc(t['id'])}</strong> — {esc(t.get('status') or 'skipped')}{' <em>(' + esc(t['installHint']) + ')</em>' if t.get('installHint') else ''}</li>" for t in rows]
        return f"<h3>{title}</h3><ul>{''.join(items)}</ul>" if items else ""

    known = status_dicts(scan.statuses)
    short = {"Dead code candidates": "Dead chains", "Refactor candidates": "Refactor"}
    numbers = "".join(f'<span class="pill">{short.get(k, k)}: {v}</span>' for k, v in counts(scan).items())
    body = [
        f"<h1>{TITLE} Health Report</h1>",
        f'<div class="meta">Root: <code>{esc(scan.root)}</code> &middot; Mode: {scan.mode} &middot; Generated for agents &amp; humans</div>',
        f'<div class="score">Health: {scan.overall}/100 {"✅" if scan.overall >= 85 else "⚠️"}</div><div class="summary">{numbers}</div>',
        listed("BLOCKERS", streamed(scan.blockers)),
        listed("FIX NEXT", scan.fix_next.collect()),
        *(listed(t, streamed(scan.of(c))) for t, c in (("LEFTOVERS", "leftovers"), ("DEAD CHAINS", "dead_code"), ("REFACTOR CANDIDATES", "refactor_readiness"))),
        tool_list("Tool Statuses (non-ok)", [s for s in known if s["status"] != "ok"]),
        tool_list("Skipped Tools", status_dicts(scan.skipped)),
        tool_list("Errored / Timed Out Tools", [s for s in known if s["status"] in ("error", "timeout")]),
    ]
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{TITLE} Report — {esc(scan.root)}</title><style>{STYLE}</style></head>\n<body>\n' + "\n".join(x for x in body if x) + "\n</body></html>\n"


def agent_markdown(plan: dict) -> str:
    out = [f"# {TITLE} Agent Plan", "", f"Goal: {plan['goal']}.", "", f"Target: {plan['target']}", "", "## Workflow", "", *(f"{i}. {s}" for i, s in enumerate(plan["workflow"], 1))]
    for title, key in (("Allowed actions", "allowedActions"), ("Forbidden actions", "forbiddenActions"), ("Rules", "rules")):
        out += ["", f"## {title}", "", *(f"- {x}" for x in plan[key])]
    if plan["doNotTouch"]:
        out += ["", "## What not to trust blindly", "", *(f"- {x}" for x in plan["doNotTouch"])]
    for task in plan["tasks"]:
        out += ["", f"## Task {task['priority']}: {task['title']}", ""]
        out += ["Files:", *(f"- {x}" for x in task["files"]), ""] if task["files"] else []
        out += ["Instructions:", *(f"{i}. {x}" for i, x in enumerate(task["instructions"], 1))]
        out += ["", "Do not touch:", *(f"- {x}" for x in task["doNotTouch"])] if task["doNotTouch"] else []
        out += ["", "Commands:", *(f"- {x}" for x in task["commands"])] if task["commands"] else []
        out += ["", "Verify:", *(f"- {x}" for x in task["verify"])]
    return "\n".join(out) + "\n"


def write_findings(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines, written by the tasks that hold them."""
    findings.select(finding_json().alias("value")).write.mode("overwrite").text(path)


def write_sarif(findings: DataFrame, path: str) -> None:
    """One SARIF document of findings of any number, in their order: tasks write their results, and
    the commit joins them."""
    head, tail = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": TITLE}}, "results": []}]}).split("[]")
    write_array(findings.select(sarif_result().alias("value")), "value", path, f"{head}[", f"]{tail}")


def write_findings(findings: DataFrame, path: str) -> None:
    """The findings of a report as one JSON array."""
    write_array(findings.select(finding_json().alias("value")), "value", path)
