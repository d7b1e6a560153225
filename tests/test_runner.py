"""Tools that are run, exports, registering a tool, and loading without the training-data operators."""

import os
import subprocess
import sys

from codeweir.sources import runner, tools

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def script(root, name, text):
    path = root / ".venv" / "bin" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("#!/bin/sh\n" + text)
    path.chmod(0o755)


def test_tools_of_the_project_run(spark, tmp_path):
    script(tmp_path, "ruff", """echo '[{"filename":"m.py","code":"F401","message":"Unused import","location":{"row":3}}]'; exit 1\n""")
    script(tmp_path, "deptry", """echo '[{"error":{"code":"DEP002","message":"unused"},"location":{"file":"pyproject.toml","line":2}}]' > "$3"\n""")
    script(tmp_path, "vulture", "echo 'vulture: No such file or directory' >&2; exit 127\n")
    script(tmp_path, "lizard", "exit 0\n")
    raw = runner.run_tools(spark, str(tmp_path), ["ruff", "deptry", "vulture", "lizard", "jscpd", "custom-leftovers"])
    got = {r["source"]: r for r in raw.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ruff": "error", "deptry": "ok", "vulture": "skipped", "lizard": "ok", "jscpd": "skipped"}
    assert got["ruff"]["command"] == "ruff check . --output-format json" and got["jscpd"]["exit_code"] is None and "npm install" in got["jscpd"]["install_hint"]
    assert [r["id"] for r in tools.parsed(raw).orderBy("ord").collect()] == ["ruff:m.py:3:F401", "deptry:pyproject.toml:2:DEP002:0"]
    said = {r["id"]: r["command"] for r in tools.statuses(raw).collect()}
    assert said["ruff"].startswith("ruff check") and said["deptry"] is None


def test_late_tools_are_stopped(tmp_path):
    script(tmp_path, "slow", "echo begun; exec sleep 20\n")
    row = runner.run_tool("slow", str(tmp_path), runner.Command(("slow",), 1, "none"))
    assert row[5] == "timeout" and row[3] is None and row[4] < 15_000 and row[1] == "begun\n"


def test_a_tool_can_be_registered(spark):
    def parse(raw, rules):
        from pyspark.sql import functions as F

        return tools.shown(tools.rows(raw, "own-tool"), "own-tool", id=F.col("x.name"), category="tests", severity="low", confidence="low", title="Own", message=F.col("x.name"), tags=["own"])

    tools.register("own-tool", "array<struct<name string>>", parse)
    try:
        raw = spark.createDataFrame([("own-tool", '[{"name":"b"},{"name":"a"}]', "", 0, 1, "ok", None)], tools.RAW)
        assert [r["id"] for r in tools.parsed(raw).orderBy("ord").collect()] == ["b", "a"]
    finally:
        tools.unregister("own-tool")
    assert "own-tool" not in tools.PARSERS and "own-tool" not in tools.PAYLOADS


def test_a_registered_tool_is_planned_run_and_fixed(spark, tmp_path):
    from codeweir.plans.scan import fix_commands, plan_sources
    from codeweir.sources import runner
    from codeweir.sources.config import Config

    def parse(raw, rules):
        from pyspark.sql import functions as F

        return tools.shown(tools.rows(raw, "own-tool"), "own-tool", id=F.col("x.name"), category="tests", severity="low", confidence="low", title="Own", message=F.col("x.name"), tags=["own"])

    command = runner.Command(("sh", "-c", "printf '[{\"name\":\"a\"}]'"), 20, "It comes with the system.")
    tools.register("own-tool", "array<struct<name string>>", parse, "tests", lambda languages, *_: "go" in languages, command, "own-tool --fix")
    try:
        go, other = (["go"], [], [], []), (["python"], [], [], [])
        assert plan_sources(*go, Config())[-1] == "own-tool" and "own-tool" not in plan_sources(*other, Config())
        assert ("own-tool", "own-tool --fix") in fix_commands(*go) and [t for t, _ in fix_commands(*other)] == ["ruff"]
        raw = runner.run_tools(spark, str(tmp_path), ["own-tool", "custom-leftovers"])
        assert [r["id"] for r in tools.parsed(raw, tools=["own-tool"]).collect()] == ["a"]
    finally:
        tools.unregister("own-tool")


def test_all_exports_are_there():
    import codeweir

    assert all(getattr(codeweir, n) for n in codeweir.__all__) and "merged" in codeweir.__all__


def test_engine_loads_without_the_other_operators():
    """Also where their import breaks."""
    code = "import sys; sys.modules['codeweir.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 60 and not any(n.startswith('op') for n in q if n[2:3].isdigit()) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr
