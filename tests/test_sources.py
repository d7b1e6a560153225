import json
import os

from pyspark.sql import functions as F

from codeweir import cli
from codeweir import fixtures as fixed
from codeweir.functions.text import glob_regex, matches_globs, normalise_path
from codeweir.plans import reports
from codeweir.plans.scan import agent_plan, run_scan
from codeweir.plans.setup import setup_plan
from codeweir.sources import config as cf
from codeweir.sources.files import gitignore_globs, read_files
from codeweir.sources.project import Project, detect_project
from codeweir.streaming.landing import start


def test_globs():
    import re

    yes = lambda g, p: re.search(glob_regex(g), p) is not None
    assert yes("src/**", "src/a/b.ts") and not yes("src/**", "src2/a.ts") and yes("**/*.{js,ts}", "a.ts") and yes("*.py", ".hidden.py") and not yes("*.py", "a/b.py")


def test_paths(spark):
    one = lambda p: spark.range(1).select(normalise_path(F.lit(p)).alias("p")).first()["p"]
    assert [one(p) for p in ("a/./b/../c", "../x", "a/../..", "./a//b")] == ["a/c", "../x", "..", "a/b"]
    assert spark.createDataFrame([("a.py",)], "path string").where(matches_globs(F.col("path"), [], [])).count() == 0


def test_config_aliases_and_merge(tmp_path):
    (tmp_path / "codeweir.yml").write_text("score:\n  minimum: 60\nchecks:\n  leftovers:\n    scan_comments: false\n  refactorReadiness:\n    minFileLines: 40\npaths:\n  include:\n    - lib/**\n")
    c, path = cf.load_config(str(tmp_path))
    assert path and c.score.minimum == 60 and not c.checks.leftovers.scan_comments and c.checks.leftovers.enabled and c.checks.refactor_readiness.min_file_lines == 40 and c.paths.include == ("lib/**",)
    assert cf.load_config(str(tmp_path / "none"))[0] == cf.Config() and cf.load_policy(str(tmp_path)) == cf.Policy()


def test_managed_files(tmp_path, capsys):
    from codeweir.plans.assets import agent_init, doctor, merged_results

    root = str(tmp_path)
    assert agent_init(root)["created"] and agent_init(root)["skipped"] and agent_init(root, True)["updated"]
    assert cf.load_policy(root) == cf.Policy() and doctor(root)["policy"] and not doctor(root)["config"]
    assert merged_results([{"created": ["a"]}, {"created": ["a", "b"]}])["created"] == ["a", "b"]
    assert cli.main(["agent", "doctor", "--root", root]) == 1 and cli.main(["agent", "init", "--root", root]) == 0


def test_gitignore():
    assert gitignore_globs("# c\n/logs/\n!x\n\n*.log") == ["logs/**", "*.log"]


def write_project(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_scan_from_files_to_reports(spark, tmp_path):
    write_project(tmp_path, fixed.FILES | {"package.json": '{"scripts":{"test":"vitest run"},"devDependencies":{"vitest":"3"}}', "requirements.txt": "x"})
    files = read_files(spark, str(tmp_path))
    assert "node_modules/dep/index.js" not in {r["path"] for r in files.collect()}
    project = detect_project(files)
    assert project.languages == ("javascript", "python", "typescript") and project.test_commands == ("npm test", "pytest")
    scan = run_scan(files, fixed.raw_outputs(spark), cf.Config(), project, spark.createDataFrame([], "fingerprint string"))
    report = json.loads(reports.json_report(scan))
    assert report["score"] == scan.overall and len(report["findings"]) == scan.findings.count() and report["agentPlan"]["tasks"]
    assert json.loads(reports.sarif_report(scan))["runs"][0]["results"]
    for text in (reports.markdown_report(scan), reports.html_report(scan), reports.terminal_report(scan), reports.agent_markdown(agent_plan(scan))):
        assert "Health" in text or "Goal" in text
    assert {f["source"] for f in report["findings"]} >= {"gitleaks", "knip", "custom-leftovers", "custom-dead-chain"}
    cf.write_baseline_file(scan.findings, str(tmp_path / ".codeweir/baseline.json"))
    again = run_scan(files, fixed.raw_outputs(spark), cf.Config(), project, cf.read_baseline(spark, str(tmp_path / ".codeweir/baseline.json")))
    assert again.findings.where("is_new").count() == 0
    assert again.only(["security"]).findings.where("category <> 'security'").count() == 0


def test_command_line(spark, tmp_path, capsys):
    write_project(tmp_path, {"src/a.ts": "// TODO: remove later\nexport const a = 1;\n"})
    assert cli.main(["init", "--root", str(tmp_path)]) == 0
    assert cli.main(["scan", "--root", str(tmp_path), "--report", "json", "--category", "leftovers"]) == 0
    found = json.loads(capsys.readouterr().out.split("\n", 1)[1])["findings"]
    assert [f["title"] for f in found] == ["Legacy or temporary marker"] and (tmp_path / ".codeweir/report.json").exists()
    assert cli.main(["explain", found[0]["id"], "--root", str(tmp_path)]) == 0
    assert "Suggestions:" in capsys.readouterr().out


def test_setup_plan():
    p = Project(("typescript",), ("pnpm",), (), (), (), (), {"tsc": True}, False)
    plan = setup_plan(p, "essential")
    assert plan.available == ["tsc"] and plan.commands == [["pnpm", "add", "-D", "@biomejs/biome", "knip"]] and plan.manual == ["gitleaks"]
    assert setup_plan(Project(("python",), (), (), (), (), (), {}, False), "python", has_venv=False).skipped == ["ruff", "pyright", "vulture", "coverage.py", "radon", "deptry"]


def test_stream_of_landed_outputs(spark, tmp_path):
    fixed.raw_outputs(spark).where("source in ('gitleaks', 'ruff')").write.json(str(tmp_path / "raw"))
    start(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_tool_server(spark, tmp_path):
    import io

    from codeweir import mcp

    write_project(tmp_path, {"src/a.ts": "// TODO: remove later\nexport const a = 1;\n", "coverage/coverage-summary.json": '{"total":{"lines":{"pct":20}}}', "package.json": '{"devDependencies":{"vitest":"3"}}'})
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nope"}, {"id": 4, "method": "tools/call", "params": {}},
        {"id": 5, "method": "tools/call", "params": {"name": "codeweir_scan_full", "arguments": {"failOnBlockers": True}}}, {"id": 6, "method": "tools/call", "params": {"name": "codeweir_get_report"}}, {"id": 7},
        {"id": 8, "method": "tools/call", "params": {"name": "codeweir_explain_finding", "arguments": {"findingId": "vitest:coverage"}}}, {"id": 9, "method": "tools/call", "params": {"name": "codeweir_verify", "arguments": {"categories": "x"}}},
    ]
    sink = io.BytesIO()
    mcp.serve(str(tmp_path), io.BytesIO(b"".join(mcp.framed(x) for x in ask)), sink)
    got, rest = mcp.messages(sink.getvalue())
    by = {x["id"]: x for x in got}
    assert not rest and len(by[2]["result"]["tools"]) == 7 and by[3]["error"]["code"] == -32601 and by[4]["error"]["code"] == -32602 and by[7]["error"]["code"] == -32600
    scan = by[5]["result"]["structuredContent"]
    assert scan["status"] == "blocked" and scan["exitCode"] == 1 and [b["id"] for b in scan["blockers"]] == ["vitest:coverage"]
    assert by[6]["result"]["structuredContent"]["report"]["score"] == scan["score"] and by[8]["result"]["structuredContent"]["finding"]["source"] == "vitest" and "result" in by[9]
    sink = io.BytesIO()
    mcp.serve(str(tmp_path), io.BytesIO(b"Bad: 1\r\n\r\n{}"), sink)
    assert b"-32700" in sink.getvalue()


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from datetime import datetime

    from codeweir.streaming.landing import events_by_window

    rows = [(datetime(2024, 1, 1, 0, 5), "tests"), (datetime(2024, 1, 1, 0, 50), "tests"), (datetime(2024, 1, 1, 1, 1), "security")]
    spark.createDataFrame(rows, "ts timestamp, category string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, category string").parquet(str(tmp_path / "in"))
    q = events_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["category"], r["n"]) for r in spark.table("windowed").collect()) == [("security", 1), ("tests", 2)]


def test_files_of_pruned_folders_are_not_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / "node_modules" / f"p{i}").mkdir(parents=True)
        (tmp_path / "node_modules" / f"p{i}" / "x.js").write_text("x" * 100)
    (tmp_path / "a.ts").write_text("hello")
    files = read_files(spark, str(tmp_path))
    files._jdf.queryExecution().toRdd().count()

    def scanned(node):
        own = [node.metrics().get("numFiles").get().value()] if "Scan" in node.nodeName() else []
        return sum(own) + sum(scanned(node.children().apply(i)) for i in range(node.children().size()))

    assert scanned(files._jdf.queryExecution().executedPlan()) == 1
