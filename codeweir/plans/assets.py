"""Files that the engine manages in a project: written if missing, or anew when forced."""

from __future__ import annotations

import os
from dataclasses import fields

from codeweir.sources.config import CONFIG_FILES, HOME, Policy

POLICY_FILE = f"{HOME}/agent-policy.yml"


def managed_write(path: str, text: str, force: bool = False) -> str:
    """created, updated (forced) or skipped (there already)."""
    there = os.path.exists(path)
    if there and not force:
        return "skipped"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return "updated" if there else "created"


def merged_results(results: list[dict[str, list[str]]]) -> dict[str, list[str]]:
    """Paths by outcome over several writes, each once, in order."""
    return {k: list(dict.fromkeys(p for r in results for p in r.get(k, []))) for k in ("created", "updated", "skipped")}


def policy_yaml(policy: Policy = Policy()) -> str:
    flags = [f"  {f.name}: {str(getattr(policy, f.name)).lower()}" for f in fields(policy) if f.name != "approval_required"]
    return "\n".join(["agent_policy:", *flags, "", "approval_required:", *(f"  - {x}" for x in policy.approval_required), ""])


def agent_init(root: str, force: bool = False) -> dict[str, list[str]]:
    done = managed_write(os.path.join(root, POLICY_FILE), policy_yaml(), force)
    return merged_results([{done: [POLICY_FILE]}])


def doctor(root: str) -> dict[str, bool]:
    """Which of the files that a scan uses are there."""
    has = lambda p: os.path.exists(os.path.join(root, p))
    return {"config": any(map(has, CONFIG_FILES)), "policy": has(POLICY_FILE), "baseline": has(f"{HOME}/baseline.json"), "report": has(f"{HOME}/report.json")}
