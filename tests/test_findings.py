from pyspark.sql import functions as F

from codeweir.functions.text import to_fixed
from codeweir.operators import findings as fx
from codeweir.plans.scan import Config, ScanResult, exit_code, plan_tasks
from codeweir.sources.config import overlaid

BASE = dict(id="ruff:src/app.py:1:F401", source="ruff", category="correctness", severity="low", confidence="high", title="F401", message="Unused import", file="src/app.py", start_line=1, safe_to_autofix=True, tags=["python"], ord=0)


def rows(spark, *given):
    cols = "id string, source string, category string, severity string, confidence string, title string, message string, file string, start_line int, safe_to_autofix boolean, is_new boolean, fix_command string, agent_instruction string, tags array<string>, evidence struct<snippet:string,tool_raw_id:string,matched_pattern:string>, ord bigint"
    names = [c.split()[0] for c in cols.split(", ")]
    made = [{"is_new": True, "fix_command": None, "agent_instruction": None, "evidence": None, "safe_to_autofix": False} | BASE | g for g in given]
    return fx.completed(spark.createDataFrame([tuple(m[n] for n in names) for m in made], cols))


def test_merge_takes_highest_severity_and_its_source(spark):
    out = fx.merged(rows(spark, {}, dict(source="biome", severity="medium", message=" unused   IMPORT ", tags=["js", "python"], ord=1, safe_to_autofix=False))).collect()
    assert len(out) == 1
    assert (out[0]["severity"], out[0]["source"], out[0]["message"], out[0]["tags"], out[0]["safe_to_autofix"]) == ("medium", "biome", "Unused import", ["python", "js"], True)


def test_single_rows_keep_repeated_tags(spark):
    assert fx.merged(rows(spark, dict(tags=["a", "a"]))).first()["tags"] == ["a", "a"]


def test_fingerprints(spark):
    snip = lambda s: (s, None, None)
    got = rows(spark, {}, dict(start_line=10, evidence=snip("SECRET_TOKEN=abc"), ord=1), dict(start_line=50, evidence=snip("SECRET_TOKEN=abc"), ord=2), dict(evidence=snip(""), ord=3)).orderBy("ord").select(fx.fingerprint().alias("f")).collect()
    same = "d4ffe6c373611a9a8676a39acf3e39a50728c86c"
    assert [r["f"] for r in got][1:] == [same, same, "2b131f230c6145543eddee78c8893dcf9b083b56"]


def test_baseline_flags_only_unknown_findings(spark):
    found = rows(spark, {}, dict(title="F402", ord=1))
    base = found.where("ord = 0").select(fx.fingerprint().alias("fingerprint"))
    assert {r["title"]: r["is_new"] for r in fx.flagged(found, base).collect()} == {"F401": False, "F402": True}


def test_scores(spark):
    secret = rows(spark, dict(source="gitleaks", category="security", severity="critical", file=None, safe_to_autofix=False))
    assert fx.category_scores(secret).where("category = 'security'").first()["score_cents"] == 2440
    assert fx.overall_score(secret).first()["overall"] == 83
    many = rows(spark, *(dict(title=f"F{i}", ord=i) for i in range(50)))
    assert fx.overall_score(many).first()["overall"] == 84
    assert fx.overall_score(many.where("false")).first()["overall"] == 100
    assert str(to_fixed(4.725)) == "4.72" and str(to_fixed(0.045)) == "0.04"


def test_sort_order_and_plan(spark):
    found = rows(spark, dict(category="leftovers", severity="high"), dict(source="gitleaks", category="security", severity="critical", title="secret", ord=1), dict(category="tests", severity="low", title="t", ord=2), dict(category="tests", severity="low", title="t", file="_x.py", ord=3))
    assert [r["ord"] for r in fx.top(found, 9).collect()] == [1, 3, 2, 0]
    tasks = plan_tasks(found, test_commands=["npm test", "pytest"]).orderBy("priority").collect()
    assert tasks[0]["instructions"][1] == "Move the secret to an environment variable." and tasks[0]["verify"][0] == "pytest"


def test_gates(spark):
    config = Config()
    code = lambda *g, c=config: exit_code(ScanResult(rows(spark, *g) if g else rows(spark, {}).where("false")), c)
    assert code() == 0
    assert code(dict(source="gitleaks", category="security", severity="low", is_new=False)) == 0
    assert code(dict(category="tests", severity="high")) == 1
    assert code(dict(source="deptry", category="dependencies", title="DEP002", severity="medium")) == 1
    assert code(dict(category="tests", severity="medium"), c=overlaid(config, {"score": {"minimum": 100}})) == 1


def test_related_treats_missing_files_as_equal(spark):
    found = rows(spark, dict(id="a", file=None), dict(id="b", file=None, category="tests", ord=1), dict(id="c", category="tests", ord=2), dict(id="d", ord=3))
    assert {r["id"] for r in fx.related(found, "a").collect()} == {"b", "d"}


def test_category_lists():
    assert fx.parse_categories(None) is None and fx.parse_categories("") is None and fx.parse_categories(",") == []
    assert fx.parse_categories("tests, security") == ["tests", "security"]


def test_scalars_of_empty_findings(spark):
    none = rows(spark, {}).where(F.lit(False))
    assert fx.merged(none).count() == 0 and fx.top_findings(none).count() == 0
