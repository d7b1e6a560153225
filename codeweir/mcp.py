"""The engine's commands as a tool server: JSON-RPC 2.0 messages with Content-Length
headers over standard input and output. Requests are answered one after the other."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
from collections.abc import Callable
from dataclasses import replace
from typing import BinaryIO

from codeweir import cli
from codeweir.operators.findings import PRIORITY
from codeweir.plans import reports
from codeweir.plans.scan import ScanResult, agent_plan, exit_code, explain, fix_commands
from codeweir.sources.config import load_policy
from codeweir.sources.project import search_path

PROTOCOL = "2024-11-05"
BOOLEAN, TEXT = {"type": "boolean"}, {"type": "string"}
CATEGORIES = {"type": "array", "items": {"type": "string", "enum": list(PRIORITY)}}


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def categories_of(given) -> list[str]:
    """Names to keep; none for all."""
    if given is None:
        return []
    if not isinstance(given, list):
        raise ValueError("categories must be an array")
    unknown = [str(x) for x in given if x not in PRIORITY]
    if unknown:
        raise ValueError(f"Unsupported categories: {', '.join(unknown)}")
    return given


def prepared(root: str, mode: str, categories: list[str] | None = None) -> tuple[ScanResult, object, int]:
    """A scan with its files written. Plans are made without the project's test commands."""
    scan, config = cli.scanned(cli.session(), root, mode)
    scan = replace(scan.only(categories) if categories else scan, test_commands=[])
    cli.write_artifacts(root, config, scan)
    return scan, config, exit_code(scan, config)


def status(blocked: bool, code: int) -> str:
    return "blocked" if blocked else "ok" if code == 0 else "warning"


def picked(rows, *names: str) -> list[dict]:
    return [{n: r[n] for n in names if r[n] is not None} for r in rows]


def scan_result(root: str, mode: str, args: dict) -> dict:
    scan, config, code = prepared(root, mode, categories_of(args.get("categories")))
    blockers = picked(reports.streamed(scan.blockers), "id", "title", "file", "severity")
    return {
        "score": scan.overall,
        "status": status(args.get("failOnBlockers") is True and bool(blockers), code),
        "exitCode": code,
        "blockers": blockers,
        "topFindings": picked(scan.top_findings.collect(), "id", "title", "category", "severity", "file"),
        "reportPath": config.output.json,
        "agentPlanPath": config.output.agent,
    }


def get_report(root: str, args: dict) -> dict:
    config, _ = cli.load_config(root)
    path = os.path.join(root, config.output.json)
    if args.get("refresh") is True or not os.path.exists(path):
        prepared(root, "full" if args.get("mode") == "full" else "changed")
    with open(path, encoding="utf-8") as f:
        return {"report": json.load(f)}


def get_plan(root: str, args: dict) -> dict:
    form, target = "markdown" if args.get("format") == "markdown" else "json", args.get("target") or "generic"
    plan = agent_plan(prepared(root, "default")[0], target)
    return {"format": form, "target": target, "plan": reports.agent_markdown(plan) if form == "markdown" else plan}


def explain_finding(root: str, args: dict) -> dict:
    wanted = args.get("findingId")
    if not isinstance(wanted, str) or not wanted.strip():
        raise ValueError("findingId is required")
    scan, _ = cli.scanned(cli.session(), root)
    got = explain(scan, wanted)
    related = [] if got["related"] is None else [reports.finding_dict(r) for r in reports.streamed(got["related"])]
    found = {} if got["finding"] is None else {"finding": reports.finding_dict(got["finding"])}
    return found | {"suggestions": got["suggestions"], "relatedFindings": related, "skippedTools": reports.status_dicts(scan.skipped)}


def fix_safe(root: str, args: dict) -> dict:
    if not load_policy(root).allow_safe_fix:
        raise ValueError("Safe fixes are disabled by the agent policy")
    before, config = cli.scanned(cli.session(), root)
    n, results = before.findings.count(), []
    for tool, line in fix_commands(*cli._profile(cli.session(), root)):
        done = subprocess.run(line, shell=True, cwd=root, env=os.environ | {"PATH": search_path(root)}, timeout=180, check=False, capture_output=True)
        results.append({"id": tool, "status": "ok" if done.returncode == 0 else "skipped" if done.returncode == 127 else "error", "command": line})
    after = cli.scanned(cli.session(), root)[0] if results else before
    cli.write_artifacts(root, config, after)
    m = after.findings.count()
    return {"beforeFindings": n, "afterFindings": m, "issuesFixed": max(0, n - m), "toolResults": results, "reportPath": config.output.json, "agentPlanPath": config.output.agent}


Tool = tuple[str, dict, Callable[[str, dict], dict]]
TOOLS: dict[str, Tool] = {
    "codeweir_scan_changed": ("Scan in changed mode.", {"categories": CATEGORIES, "failOnBlockers": BOOLEAN}, lambda root, a: scan_result(root, "changed", a)),
    "codeweir_scan_full": ("Scan with every source.", {"categories": CATEGORIES, "failOnBlockers": BOOLEAN}, lambda root, a: scan_result(root, "full", a)),
    "codeweir_fix_safe": ("Run safe fixes and count findings before and after.", {}, fix_safe),
    "codeweir_get_report": ("Read the JSON report, after a new scan if asked for.", {"refresh": BOOLEAN, "mode": {"type": "string", "enum": ["changed", "full"]}}, get_report),
    "codeweir_get_agent_plan": ("The repair plan, as JSON or Markdown.", {"format": {"type": "string", "enum": ["json", "markdown"]}, "target": TEXT}, get_plan),
    "codeweir_explain_finding": ("Explain one finding by its id.", {"findingId": TEXT}, explain_finding),
    "codeweir_verify": ("Scan in changed mode and say whether it passes.", {"failOnBlockers": BOOLEAN}, lambda root, a: scan_result(root, "changed", {"failOnBlockers": a.get("failOnBlockers")})),
}


def called(root: str, params: dict) -> dict:
    name = params.get("name")
    if not isinstance(name, str):
        raise Refused(-32602, "Tool name is required")
    if name not in TOOLS:
        raise Refused(-32601, f"Unknown tool: {name}")
    given = params.get("arguments")
    result = TOOLS[name][2](root, given if isinstance(given, dict) else {})
    return {"content": [{"type": "text", "text": json.dumps(result, indent=2, ensure_ascii=False)}], "structuredContent": result}


def answer(root: str, request: dict) -> dict | None:
    """The response to a request; None for notifications."""
    method, params = request.get("method"), request.get("params") or {}
    try:
        if not method:
            if "id" not in request:
                return None
            raise Refused(-32600, "Invalid request")
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "serverInfo": {"name": "codeweir", "version": "0.1.0"}, "capabilities": {"tools": {}}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p, _) in TOOLS.items()]}
        elif method == "tools/call":
            result = called(root, params)
        else:
            raise Refused(-32601, f"Unsupported method: {method}")
        return {"jsonrpc": "2.0", "id": request.get("id"), "result": result}
    except Refused as e:
        return error(request.get("id"), e.code, str(e))
    except Exception as e:  # a tool that fails is answered, and the server stays
        return error(request.get("id"), -32000, str(e))


def error(number, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def framed(message: dict) -> bytes:
    body = json.dumps(message, ensure_ascii=False).encode()
    return f"Content-Length: {len(body)}\r\n\r\n".encode() + body


def messages(buffer: bytes) -> tuple[list[dict], bytes]:
    """Whole messages at the buffer's start, and the rest."""
    found = []
    while (at := buffer.find(b"\r\n\r\n")) >= 0:
        size = re.search(rb"Content-Length:\s*(\d+)", buffer[:at], re.IGNORECASE)
        if not size:
            raise ValueError("Missing Content-Length header")
        end = at + 4 + int(size[1])
        if len(buffer) < end:
            break
        found.append(json.loads(buffer[at + 4 : end]))
        buffer = buffer[end:]
    return found, buffer


def serve(root: str, source: BinaryIO, sink: BinaryIO) -> None:
    buffer = b""
    while chunk := source.read1(65536):
        try:
            requests, buffer = messages(buffer + chunk)
        except ValueError as e:
            requests, buffer = [], b""
            sink.write(framed(error(None, -32700, str(e))))
        for request in requests:
            reply = answer(root, request)
            if reply is not None:
                sink.write(framed(reply))
        sink.flush()


if __name__ == "__main__":
    serve(os.path.abspath(sys.argv[1] if len(sys.argv) > 1 else "."), sys.stdin.buffer, sys.stdout.buffer)
