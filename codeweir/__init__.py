"""A PySpark-native engine for code-health analytics.

The names of EXPORTS are loaded when they are first used, so that workers which only need a
module of this package don't load them all.
"""

from importlib import import_module

EXPORTS = {
    "codeweir.cli": ("scanned", "render"),
    "codeweir.mcp": ("answer", "serve"),
    "codeweir.operators.dead_chain": ("dead_chains",),
    "codeweir.operators.findings": ("category_scores", "fingerprint", "flagged", "merged", "overall_score"),
    "codeweir.operators.leftovers": ("leftovers",),
    "codeweir.operators.refactor": ("refactor_candidates",),
    "codeweir.plans.assets": ("agent_init", "doctor"),
    "codeweir.plans.scan": ("ScanResult", "agent_plan", "exit_code", "explain", "plan_sources", "run_scan"),
    "codeweir.plans.setup": ("setup_plan",),
    "codeweir.sources.config": ("Config", "Policy", "load_config", "load_policy", "read_baseline", "write_baseline_file"),
    "codeweir.sources.files": ("read_files", "relative"),
    "codeweir.sources.project": ("Project", "detect_project"),
    "codeweir.sources.runner": ("run_tool", "run_tools"),
    "codeweir.sources.tools": ("parsed", "register", "statuses"),
}
_HOME = {name: module for module, names in EXPORTS.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
