"""Registered queries of the engine's operators, and their SQL.

Table-driven queries read whole tables; findings are made from events. Queries on code
use small inline files, as the tables hold no source code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir import fixtures as fixed
from codeweir.functions.text import lines, matches_globs, trim, word
from codeweir.operators import findings as fx
from codeweir.operators import leftovers as lo
from codeweir.operators import refactor as rf
from codeweir.operators.dead_chain import dead_chains, import_edges, imports, source_nodes
from codeweir.operators.graph import reachable, weak_components
from codeweir.plans import scan as plans
from codeweir.plans.reports import finding_json, sarif_result
from codeweir.plans.setup import CATALOG, setup_tools
from codeweir.sources import project, tools
from codeweir.sources.config import Config
from codeweir.sources.files import pruned

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as files -----------------------------------------------------------

DOC_LINES = r"doc_lines AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)"
BRANCH = r"\b(?:if|else if|switch|case|catch|for|while|except)\b"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


@query("doc_line_explode", f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM doc_lines")
def doc_line_explode(spark, sf_dir):
    return doc_lines(spark, sf_dir)


VOCAB = {"license": ("copyright", "license"), "secret": ("password", "secret", "token"), "contact": ("@", "http")}
VOCAB_ROWS = [(g, p) for g, ps in VOCAB.items() for p in ps]


@query("vocab_match_docs", f"WITH {DOC_LINES}, v AS (SELECT * FROM {fixed.values(VOCAB_ROWS, 'grp, pattern')}) SELECT grp, pattern, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM doc_lines JOIN v ON contains(lower(line), pattern) GROUP BY grp, pattern")
def vocab_match_docs(spark, sf_dir):
    low = F.lower("line")
    found = F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(g).alias("grp"), F.lit(p).alias("pattern"))) for g, p in VOCAB_ROWS)))
    rows = doc_lines(spark, sf_dir).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
    return rows.groupBy("grp", "pattern", "doc_id").count().groupBy("grp", "pattern").agg(F.sum("count").alias("n_lines"), F.count(F.lit(1)).alias("n_docs"))


@query("refactor_line_metrics_docs", rf"SELECT doc_id, len(string_split_regex(text, '\r?\n')) AS n_lines, len(regexp_extract_all(text, '{BRANCH}')) AS branches, len(regexp_extract_all(text, '\b(?:import|from)\b')) AS imports, regexp_matches(text, '(?i)\b(?:payment|webhook|secret|token|signature|auth|session)\b') AS sensitive FROM documents WHERE text IS NOT NULL")
def refactor_line_metrics_docs(spark, sf_dir):
    t = F.col("text")
    docs = read(spark, sf_dir, "documents").where(t.isNotNull())
    return docs.select("doc_id", F.size(lines(t)).cast("bigint").alias("n_lines"), rf.count(t, rf.BRANCHES).cast("bigint").alias("branches"), rf.count(t, "import|from").cast("bigint").alias("imports"), t.rlike(f"(?i){word(rf.SENSITIVE_WORDS)}").alias("sensitive"))


@query("dup_line_score_docs", f"WITH {DOC_LINES}, t AS (SELECT doc_id, trim(line, E' \\t\\r\\n\\v\\f') AS s FROM doc_lines), c AS (SELECT doc_id, s, count(*) AS n FROM t WHERE length(s) > 20 GROUP BY doc_id, s) SELECT doc_id, count(*) FILTER (WHERE n > 1) AS duplicates, least(20, 2 * count(*) FILTER (WHERE n > 1)) AS score FROM c GROUP BY doc_id")
def dup_line_score_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = rf.repeated_lines(docs).select(F.col("path").alias("doc_id"), "duplicates")
    return found.withColumn("score", F.least(F.lit(20).cast("bigint"), F.col("duplicates") * 2))


# --- findings from events -------------------------------------------------------------

KIND = {"purchase": "dependencies", "error": "correctness", "click": "leftovers", "view": "maintainability", "signup": "security"}
TOOL = {"purchase": "osv-scanner", "error": "pyright", "click": "custom-leftovers", "view": "lizard", "signup": "gitleaks"}


def _case(col: str, names: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


RAW_CTE = f"""raw AS (
  SELECT event_id AS ord, 'ev:' || event_id AS id, {_case('event_type', TOOL)} AS source, {_case('event_type', KIND)} AS category,
    CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity,
    CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
    event_type || ' signal' AS title, '  Seen   at ' || (user_id % 4) || ' ' AS message,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'src/u' || (user_id % 20) || CASE WHEN user_id % 7 = 0 THEN '.test.ts' ELSE '.ts' END END AS file,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS start_line, event_id % 5 = 0 AS safe_to_autofix,
    ['event', event_type, 'u' || (user_id % 3)] AS tags, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE 'Snip ' || (user_id % 9) END AS snippet
  FROM events)"""
SEV_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
CONF_RANK = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
MERGE_CTE = rf"""keyed AS (SELECT *, {SEV_RANK} AS sr, {CONF_RANK} AS cr, category || '|' || coalesce(file, '') || '|' || coalesce(CAST(start_line AS VARCHAR), '') || '|' || lower(title) || '|' || lower(trim(regexp_replace(message, '\s+', ' ', 'g'))) AS k FROM raw),
merged AS (
  SELECT min(ord) AS ord, arg_min(id, ord) AS id, arg_max(source, (sr, -ord)) AS source, any_value(category) AS category,
    CASE max(sr) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
    CASE max(cr) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    arg_min(title, ord) AS title, arg_min(message, ord) AS message, arg_min(file, ord) FILTER (WHERE file IS NOT NULL) AS file, any_value(start_line) AS start_line,
    bool_or(safe_to_autofix) AS safe_to_autofix, arg_min(snippet, ord) FILTER (WHERE snippet IS NOT NULL) AS snippet, count(*) AS n, list(tags) AS tag_lists
  FROM keyed GROUP BY k)"""
PRINT_SQL = "sha1(category || ':' || source || ':' || title || ':' || coalesce(file, '') || ':' || CASE WHEN length(snippet) > 0 THEN '' ELSE coalesce(CAST(start_line AS VARCHAR), '') END || ':' || substr(sha1(lower(trim(coalesce(snippet, message)))), 1, 12))"
#: What the baseline holds: the fingerprints of findings first seen on even events.
FLAG_CTE = f"printed AS (SELECT *, {PRINT_SQL} AS fp FROM merged), base AS (SELECT DISTINCT fp AS bfp FROM printed WHERE ord % 2 = 0), flagged AS (SELECT printed.*, bfp IS NULL AS is_new FROM printed LEFT JOIN base ON fp = bfp)"
SCORE_ROWS = [(k, v) for k, v in fx.score_table().items()]
SCORE_CTE = f"costs AS (SELECT * FROM {fixed.values(SCORE_ROWS, 'combo, cents')}), scored AS (SELECT flagged.*, cents FROM flagged JOIN costs ON combo = severity || '|' || is_new || '|' || confidence || '|' || safe_to_autofix || '|' || coalesce(regexp_matches(file, '\\.test\\.|(^|/)tests?/'), false))"
DIM_ROWS = [(c, i, fx.WEIGHTS[c]) for i, c in enumerate(fx.PRIORITY)]
DIM_CTE = f"dim AS (SELECT * FROM {fixed.values(DIM_ROWS, 'category, priority, weight')})"
CATS_CTE = "cats AS (SELECT dim.category, priority, weight, CAST(coalesce(sum(cents), 0) AS BIGINT) AS penalty_cents, CAST(greatest(0, 10000 - coalesce(sum(cents), 0)) AS BIGINT) AS score_cents FROM dim LEFT JOIN scored ON scored.category = dim.category GROUP BY ALL)"
RANKED = f"row_number() OVER (ORDER BY list_position({list(fx.PRIORITY)!r}, category), {SEV_RANK} DESC, is_new DESC, coalesce(file, ''), coalesce(start_line, 0), title, id, ord)"
FINDINGS_CTE = f"WITH {RAW_CTE}, {MERGE_CTE}, {FLAG_CTE}, {SCORE_CTE}, {DIM_CTE}, {CATS_CTE}, ranked AS (SELECT *, {RANKED} AS rank FROM scored)"


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, kind = F.col("user_id"), F.col("event_type")
    name = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[kind]
    v = F.col("value")
    file = F.concat(F.lit("src/u"), (u % 20).cast("string"), F.when(u % 7 == 0, ".test.ts").otherwise(".ts"))
    snippet = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 > 1, F.concat(F.lit("Snip "), (u % 9).cast("string")))
    null = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("id"),
        name(TOOL).alias("source"),
        name(KIND).alias("category"),
        F.when(v >= 100, "critical").when(v >= 50, "high").when(v >= 20, "medium").when(v >= 5, "low").otherwise("info").alias("severity"),
        F.when(u % 3 == 0, "low").when(u % 3 == 1, "medium").otherwise("high").alias("confidence"),
        F.concat(kind, F.lit(" signal")).alias("title"),
        F.concat(F.lit("  Seen   at "), (u % 4).cast("string"), F.lit(" ")).alias("message"),
        F.when(u % 11 != 0, file).alias("file"),
        F.from_json("props", "k int")["k"].alias("start_line"),
        (F.col("event_id") % 5 == 0).alias("safe_to_autofix"),
        F.array(F.lit("event"), kind, F.concat(F.lit("u"), (u % 3).cast("string"))).alias("tags"),
        F.when(snippet.isNotNull(), F.struct(snippet.alias("snippet"), null.alias("tool_raw_id"), null.alias("matched_pattern"))).alias("evidence"),
    )
    return fx.completed(rows)


def merged_findings(spark, sf_dir) -> DataFrame:
    return fx.merged(raw_findings(spark, sf_dir))


def flagged_findings(spark, sf_dir) -> DataFrame:
    rows = merged_findings(spark, sf_dir)
    return fx.flagged(rows, rows.where("ord % 2 = 0").select(fx.fingerprint().alias("fingerprint")))


@query("findings_from_events", f"WITH {RAW_CTE} SELECT ord, id, source, category, severity, confidence, title, message, file, start_line, safe_to_autofix, array_to_string(tags, ',') AS tags, snippet FROM raw")
def findings_from_events(spark, sf_dir):
    return raw_findings(spark, sf_dir).select("ord", "id", "source", "category", "severity", "confidence", "title", "message", "file", "start_line", "safe_to_autofix", F.array_join("tags", ",").alias("tags"), "evidence.snippet")


@query("severity_bucket_events", f"WITH {RAW_CTE} SELECT category, severity, count(*) AS n FROM raw GROUP BY category, severity")
def severity_bucket_events(spark, sf_dir):
    return raw_findings(spark, sf_dir).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


MERGED_COLS = "ord, id, source, category, severity, confidence, title, message, file, start_line, safe_to_autofix, snippet"


@query("dedupe_events", f"WITH {RAW_CTE}, {MERGE_CTE} SELECT {MERGED_COLS} FROM merged")
def dedupe_events(spark, sf_dir):
    return merged_findings(spark, sf_dir).withColumn("snippet", F.col("evidence.snippet")).select(*MERGED_COLS.split(", "))


@query("dedupe_tags_union", f"WITH {RAW_CTE}, {MERGE_CTE} SELECT ord, array_to_string(list_sort(list_distinct(flatten(tag_lists))), ',') AS tags FROM merged")
def dedupe_tags_union(spark, sf_dir):
    return merged_findings(spark, sf_dir).select("ord", F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query("fingerprint_events", f"WITH {RAW_CTE} SELECT ord, {PRINT_SQL} AS fingerprint FROM raw")
def fingerprint_events(spark, sf_dir):
    return raw_findings(spark, sf_dir).select("ord", fx.fingerprint().alias("fingerprint"))


@query("baseline_flag_events", f"WITH {RAW_CTE}, {MERGE_CTE}, {FLAG_CTE} SELECT ord, id, is_new FROM flagged")
def baseline_flag_events(spark, sf_dir):
    return flagged_findings(spark, sf_dir).select("ord", "id", "is_new")


@query("score_per_finding", f"{FINDINGS_CTE} SELECT ord, CAST(cents AS BIGINT) AS cents FROM scored")
def score_per_finding(spark, sf_dir):
    return flagged_findings(spark, sf_dir).select("ord", fx.score_cents().alias("cents"))


@query("score_table_rule", f"SELECT combo, CAST(cents AS BIGINT) AS cents FROM {fixed.values(SCORE_ROWS, 'combo, cents')}")
def score_table_rule(spark, sf_dir):
    parts = [(s, n, c, a, t) for s in fx.SEVERITIES for n in (True, False) for c in fx.CONFIDENCES for a in (True, False) for t in (True, False)]
    rows = spark.createDataFrame([(s, n, c, a, "src/a.test.ts" if t else None) for s, n, c, a, t in parts], "severity string, is_new boolean, confidence string, safe_to_autofix boolean, file string")
    combo = F.concat_ws("|", "severity", F.col("is_new").cast("string"), "confidence", F.col("safe_to_autofix").cast("string"), fx.is_test_path(F.col("file")).cast("string"))
    return rows.select(combo.alias("combo"), fx.score_cents().alias("cents"))


@query("category_scores", f"{FINDINGS_CTE} SELECT category, CAST(priority AS INTEGER) AS priority, CAST(weight AS DOUBLE) AS weight, penalty_cents, score_cents FROM cats")
def category_scores(spark, sf_dir):
    return fx.category_scores(flagged_findings(spark, sf_dir))


OVERALL = "CAST(floor(" + " + ".join(f"(SELECT score_cents / 100.0::DOUBLE * {fx.WEIGHTS[c]}::DOUBLE FROM cats WHERE category = '{c}')" for c in fx.SUM_ORDER) + " + 0.5) AS INTEGER)"


@query("overall_score", f"{FINDINGS_CTE} SELECT {OVERALL} AS overall")
def overall_score(spark, sf_dir):
    return fx.overall_score(flagged_findings(spark, sf_dir))


# All findings of the category. The penalty is given too, as the score of many findings is 0 whatever is left out.
@query("category_rescore_all", f"{FINDINGS_CTE.replace('scored.category = dim.category', 'scored.category = dim.category AND scored.category = ' + chr(39) + 'leftovers' + chr(39))} SELECT {OVERALL} AS overall, (SELECT penalty_cents FROM cats WHERE category = 'leftovers') AS penalty_cents")
def category_rescore_all(spark, sf_dir):
    rows = fx.in_categories(flagged_findings(spark, sf_dir), ["leftovers"])
    penalty = fx.category_scores(rows).where("category = 'leftovers'").select("penalty_cents")
    return fx.overall_score(rows).crossJoin(penalty)


@query("finding_sort_rank", f"{FINDINGS_CTE} SELECT category, CAST(rank - min(rank) OVER (PARTITION BY category) + 1 AS INTEGER) AS place, id FROM ranked")
def finding_sort_rank(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("category").orderBy(*fx.order()))
    return flagged_findings(spark, sf_dir).select("category", place.alias("place"), "id")


@query("fix_next_top3", f"{FINDINGS_CTE} SELECT id, title, file FROM ranked WHERE category <> 'leftovers' ORDER BY rank LIMIT 3")
def fix_next_top3(spark, sf_dir):
    return fx.fix_next(flagged_findings(spark, sf_dir)).select("id", "title", "file")


@query("top_findings_conditional", f"{FINDINGS_CTE} SELECT id, severity, category FROM ranked WHERE severity IN ('high', 'critical') OR NOT EXISTS (SELECT 1 FROM scored WHERE severity IN ('high', 'critical')) ORDER BY rank LIMIT 5")
def top_findings_conditional(spark, sf_dir):
    return fx.top_findings(flagged_findings(spark, sf_dir)).select("id", "severity", "category")


@query("top_findings_without_blockers", f"{FINDINGS_CTE} SELECT id, severity, category FROM ranked WHERE severity NOT IN ('high', 'critical') ORDER BY rank LIMIT 5")
def top_findings_without_blockers(spark, sf_dir):
    return fx.top_findings(flagged_findings(spark, sf_dir).where(~fx.is_blocker())).select("id", "severity", "category")


@query("blockers", f"{FINDINGS_CTE} SELECT id, source, is_new FROM scored WHERE severity IN ('high', 'critical')")
def blockers(spark, sf_dir):
    return flagged_findings(spark, sf_dir).where(fx.is_blocker()).select("id", "source", "is_new")


@query("slice_counts", f"{FINDINGS_CTE} SELECT count(*) FILTER (WHERE severity IN ('high', 'critical')) AS blockers, count(*) FILTER (WHERE category = 'leftovers') AS leftovers, count(*) FILTER (WHERE category = 'dead_code') AS dead_code, count(*) FILTER (WHERE category = 'refactor_readiness') AS refactor FROM scored")
def slice_counts(spark, sf_dir):
    of = lambda c: F.count_if(F.col("category") == c)
    return flagged_findings(spark, sf_dir).agg(F.count_if(fx.is_blocker()).alias("blockers"), of("leftovers").alias("leftovers"), of("dead_code").alias("dead_code"), of("refactor_readiness").alias("refactor"))


@query("agent_plan_tasks", f"{FINDINGS_CTE} SELECT CAST(rank AS INTEGER) AS priority, title, coalesce(file, '') AS files, trim(message) || ' / ' || CASE WHEN source = 'gitleaks' THEN 'Move the secret to an environment variable.' ELSE 'Fix the issue without changing public behavior unless required.' END || ' / Do not change public behavior unless required.' AS instructions, 'npm test / codeweir scan --changed --report json' AS verify FROM ranked WHERE rank <= 5")
def agent_plan_tasks(spark, sf_dir):
    rows = plans.plan_tasks(flagged_findings(spark, sf_dir), test_commands=["npm test", "pytest"])
    join = lambda c: F.array_join(c, " / ").alias(c)
    return rows.select("priority", "title", join("files"), join("instructions"), join("verify"))


@query("exit_gate", f"{FINDINGS_CTE}, o AS (SELECT {OVERALL} AS overall), g AS (SELECT bool_or(source = 'gitleaks') AS secrets, bool_or(category = 'dependencies' AND severity IN ('high', 'critical')) AS dependencies, bool_or(source = 'deptry' AND title = 'DEP002') AS missing, bool_or(source IN ('tsc', 'pyright') OR (category = 'correctness' AND severity IN ('high', 'critical'))) AS types, bool_or(category = 'tests' AND severity IN ('high', 'critical')) AS tests FROM scored WHERE is_new) SELECT g.*, CASE WHEN overall < 80 OR secrets OR dependencies OR missing OR types OR tests THEN 1 ELSE 0 END AS exit_code FROM g, o")
def exit_gate(spark, sf_dir):
    rows = flagged_findings(spark, sf_dir)
    config = Config()
    flags = plans.gates(rows, config).withColumn("k", F.lit(1))
    score = fx.overall_score(rows).withColumn("k", F.lit(1))
    fails = (F.col("overall") < config.score.minimum) | F.greatest(*(F.col(c) for c in plans.gate_conditions(config)))
    return flags.join(score, "k").select(*plans.gate_conditions(config), F.when(fails, 1).otherwise(0).alias("exit_code"))


@query("explain_related", f"{FINDINGS_CTE}, one AS (SELECT id, file, category FROM scored WHERE id = 'ev:0') SELECT s.id FROM scored s JOIN one ON s.id <> one.id AND (s.file IS NOT DISTINCT FROM one.file OR s.category = one.category)")
def explain_related(spark, sf_dir):
    return fx.related(flagged_findings(spark, sf_dir), "ev:0").select("id")


@query("safe_fix_counts", f"WITH {RAW_CTE}, {MERGE_CTE}, c AS (SELECT count(*) AS before, count(*) FILTER (WHERE NOT safe_to_autofix) AS after FROM merged) SELECT before, after, greatest(0, before - after) AS fixed FROM c")
def safe_fix_counts(spark, sf_dir):
    rows = merged_findings(spark, sf_dir)
    return plans.fixed_counts(rows, rows.where("not safe_to_autofix"))


@query("sarif_levels", f"WITH {RAW_CTE} SELECT id, CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, file AS uri, CASE WHEN file IS NOT NULL THEN start_line END AS line FROM raw")
def sarif_levels(spark, sf_dir):
    kind = "ruleId string, level string, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>"
    rows = raw_findings(spark, sf_dir).select(F.from_json(sarif_result(), kind).alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(F.col("r.ruleId").alias("id"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"))


@query("json_findings", f"WITH {RAW_CTE} SELECT id, CAST(file IS NOT NULL AS BOOLEAN) AS has_file, snippet IS NOT NULL AS has_evidence, start_line FROM raw")
def json_findings(spark, sf_dir):
    rows = raw_findings(spark, sf_dir).select(finding_json().alias("j"))
    kind = "id string, startLine int"
    return rows.select(F.from_json("j", kind)["id"].alias("id"), F.col("j").contains('"file":').alias("has_file"), F.col("j").contains('"evidence":').alias("has_evidence"), F.from_json("j", kind)["startLine"].alias("start_line"))


# --- tool parsers ------------------------------------------------------------------------


def _parser(tool: str) -> Query:
    def run(spark, sf_dir):
        rows = tools.PARSERS[tool](fixed.raw_outputs(spark), tools.ToolRules())
        note = F.coalesce("evidence.snippet", "evidence.tool_raw_id")
        return rows.select("id", "category", "severity", "confidence", "title", "message", "file", "start_line", "end_line", F.col("safe_to_autofix").cast("int").alias("safe"), F.array_join("tags", ",").alias("tags"), note.alias("note"))

    return run


def _expected(tool: str) -> str:
    rows = fixed.EXPECTED[tool] or [(None,) * 12]
    kinds = {"start_line": "INTEGER", "end_line": "INTEGER", "safe": "INTEGER"}
    cols = ", ".join(f"CAST({c} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in fixed.EXPECTED_COLUMNS.split(", "))
    return f"SELECT {cols} FROM {fixed.values(rows, fixed.EXPECTED_COLUMNS)} WHERE id IS NOT NULL"


for _tool in tools.PARSERS:
    query(f"parse_{_tool.replace('-', '_').replace('.', '_')}", _expected(_tool))(_parser(_tool))

LONG = "x" * 297 + "..."
STATUS_ROWS = [("biome", "ok", None), ("coverage.py", "ok", None), ("custom-tool", "error", LONG), ("deptry", "error", "Exited with code 1."), ("knip", "ok", "Reported issues (debt surfaced as findings)"), ("slow-tool", "timeout", "Timed out after 61s."), ("silent-tool", "error", "Exited with code unknown."), ("vitest", "ok", None)]


@query("tool_statuses", f"SELECT CAST(id AS VARCHAR) AS id, CAST(status AS VARCHAR) AS status, CAST(message AS VARCHAR) AS message FROM {fixed.values(STATUS_ROWS, 'id, status, message')}")
def tool_statuses(spark, sf_dir):
    raw = fixed.raw_outputs(spark).withColumn("stdout", F.when(F.col("source") == "deptry", "").otherwise(F.col("stdout")))
    return tools.statuses(raw).where(F.col("id").isin(*(r[0] for r in STATUS_ROWS)))


@query("skipped_tools", "SELECT 'absent-tool' AS id, 'skipped' AS status, 'Install it first' AS install_hint")
def skipped_tools(spark, sf_dir):
    return tools.skipped(fixed.raw_outputs(spark))


# --- detectors on inline files ------------------------------------------------------------

IGNORED = " OR ".join(f"regexp_matches(t, {fixed.quoted('(?i)' + p)})" for p in (lo.DOCUMENTS, lo.ABOUT_RULES, lo.ABOUT_DETECTOR, lo.ABOUT_CHANGES)) + f" OR (regexp_matches(t, {fixed.quoted('(?i)' + lo.EXAMPLES)}) AND regexp_matches(t, {fixed.quoted('(?i)' + lo.EXAMPLE_USES)}))"
VOCAB_SQL = fixed.values([(g, p, i) for i, (g, p) in enumerate((g, p) for g, ps in lo.VOCABULARY.items() for p in ps)], "grp, pattern, place")
LINES_CTE = rf"""f AS (SELECT path, unnest(string_split_regex(content, '\r?\n')) AS raw, unnest(range(1, len(string_split_regex(content, '\r?\n')) + 1)) AS line FROM {fixed.files_sql(fixed.FILES)} x WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|py)$')),
l AS (SELECT path, line, raw, trim(raw, E' \t\r\n') AS s, lower(raw) AS low, lower(trim(raw, E' \t\r\n')) AS t FROM f),
c0 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^//', ''), '^#', ''), '^/\*', ''), '^\*', ''), E' \t') AS txt FROM l WHERE starts_with(s, CASE WHEN ends_with(path, '.py') THEN '#' ELSE '//' END) OR starts_with(s, '/*') OR starts_with(s, '*')),
c AS (SELECT path, line, txt FROM (SELECT path, line, txt, lower(txt) AS t FROM c0) q WHERE NOT ({IGNORED})),
k AS (SELECT * FROM l WHERE NOT ({IGNORED}))"""
COMMENTS_SQL = f"SELECT path, line, grp, pattern, txt AS text, 'medium' AS confidence, 'low' AS severity FROM c JOIN (SELECT * FROM {VOCAB_SQL}) v ON contains(lower(txt), pattern)"
CODE_SQL = rf"SELECT path, line, 'commented-code' AS grp, 'commented code' AS pattern, txt AS text, 'high' AS confidence, 'low' AS severity FROM c WHERE regexp_matches(txt, '\b({lo.CODE_WORDS})\b')"
NAMES_SQL = rf"SELECT path, line, 'name-signal' AS grp, p AS pattern, s AS text, 'low' AS confidence, 'low' AS severity FROM k JOIN (SELECT * FROM {fixed.values([(n,) for n in lo.NAMES], 'p')}) n ON regexp_matches(raw, '(?i)\b' || p) WHERE regexp_matches(low, '\b({lo.DECLARATIONS})\b')"
FLAGS_SQL = rf"SELECT path, line, 'flag-signal' AS grp, sig AS pattern, s AS text, 'medium' AS confidence, 'low' AS severity FROM (SELECT *, CASE WHEN regexp_matches(s, '\b{lo.ENV_FLAG}\b') THEN regexp_extract(s, '\b({lo.ENV_FLAG})\b', 1) ELSE regexp_extract(s, '\b({lo.FEATURE_FLAG})\b', 1) END AS sig FROM k) q WHERE sig <> ''"
FALL_SQL = rf"SELECT path, line, 'fallback-branch' AS grp, CASE WHEN contains(low, 'legacy') THEN 'legacy branch' ELSE 'fallback branch' END AS pattern, s AS text, CASE WHEN regexp_matches(raw, '\b{lo.ENV_GUARD}\b') THEN 'medium' ELSE 'high' END AS confidence, 'medium' AS severity FROM k WHERE regexp_matches(low, 'legacy|fallback|compat|oldflow') AND (regexp_matches(low, '\b({lo.BRANCHES})\b') OR (contains(low, '?') AND contains(low, ':')))"


def _matcher(step: int, groups: tuple[str, ...] = ()) -> Query:
    def run(spark, sf_dir):
        rows = lo.matched_lines(fixed.files(spark, fixed.FILES)).where(F.col("step") == step)
        rows = rows.where(F.col("group").isin(*groups)) if groups else rows
        return rows.select("path", F.col("line").cast("bigint").alias("line"), F.col("group").alias("grp"), "pattern", "text", "confidence", "severity")

    return run


query("vocab_match_fixture", f"WITH {LINES_CTE} {COMMENTS_SQL}")(_matcher(0, tuple(lo.VOCABULARY)))
query("commented_code_fixture", f"WITH {LINES_CTE} {CODE_SQL}")(_matcher(0, ("commented-code",)))
query("name_signal_fixture", f"WITH {LINES_CTE} {NAMES_SQL}")(_matcher(1))
query("flag_signal_fixture", f"WITH {LINES_CTE} {FLAGS_SQL}")(_matcher(2))
query("fallback_branch_fixture", f"WITH {LINES_CTE} {FALL_SQL}")(_matcher(3))
FULL_SQL = f"WITH {LINES_CTE}, m AS ({COMMENTS_SQL} UNION ALL {CODE_SQL} UNION ALL {NAMES_SQL} UNION ALL {FLAGS_SQL} UNION ALL {FALL_SQL}), t AS (SELECT *, CASE grp WHEN 'commented-code' THEN 'Commented-out code' WHEN 'fallback-branch' THEN 'Legacy fallback path appears present' WHEN 'flag-signal' THEN 'Legacy flag or env toggle' ELSE 'Legacy or temporary marker' END AS title FROM m) SELECT path AS file, line AS start_line, title, CASE max(CASE severity WHEN 'medium' THEN 2 ELSE 1 END) WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE max({CONF_RANK}) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(list_sort(list_distinct(list_append(list(grp), 'leftovers'))), ',') AS tags FROM t GROUP BY path, line, title, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("leftovers_full_fixture", FULL_SQL)
def leftovers_full_fixture(spark, sf_dir):
    rows = fx.merged(lo.leftovers(fixed.files(spark, fixed.FILES)))
    return rows.select("file", F.col("start_line").cast("bigint").alias("start_line"), "title", "severity", "confidence", F.array_join(F.sort_array("tags"), ",").alias("tags"))


FN = rf.FUNCTION
BLOCKS_CTE = rf"""rl AS (SELECT path, unnest(string_split_regex(content, '\r?\n')) AS raw, unnest(range(1, len(string_split_regex(content, '\r?\n')) + 1)) AS line FROM {fixed.files_sql(fixed.REFACTOR_FILES)} x WHERE NOT regexp_matches(substr(content, 1, 200), '(?i)generated')),
starts AS (SELECT path, line, coalesce(nullif(regexp_extract(raw, '{FN}', 1), ''), nullif(regexp_extract(raw, '{FN}', 2), ''), nullif(regexp_extract(raw, '{FN}', 3), '')) AS name FROM rl WHERE regexp_matches(raw, '{FN}')),
ends AS (SELECT s.path, s.name, s.line AS start_line, coalesce(lead(s.line) OVER (PARTITION BY s.path ORDER BY s.line) - 1, (SELECT max(line) FROM rl WHERE rl.path = s.path)) AS end_line FROM starts s),
blocks AS (SELECT e.path, e.name, e.start_line, e.end_line, e.end_line - e.start_line + 1 AS length, CAST(sum(len(regexp_extract_all(raw, '{BRANCH}'))) AS BIGINT) AS complexity FROM ends e JOIN rl ON rl.path = e.path AND rl.line BETWEEN e.start_line AND e.end_line GROUP BY ALL)"""


@query("function_blocks_fixture", f"WITH {BLOCKS_CTE} SELECT * FROM blocks")
def function_blocks_fixture(spark, sf_dir):
    kept = fixed.files(spark, fixed.REFACTOR_FILES).where(~F.substring("content", 1, 200).rlike("(?i)generated"))
    return rf.functions(kept).select("path", "name", *(F.col(c).cast("bigint").alias(c) for c in ("start_line", "end_line", "length", "complexity")))


RULES = rf.RefactorRules(min_lines=40, min_complexity=8)
METRICS_CTE = rf"""big AS (SELECT path, arg_max(name, (length, -start_line)) AS name, max(length) AS length, arg_max(complexity, (length, -start_line)) AS cc, arg_max(start_line, (length, -start_line)) AS start_line, count(*) FILTER (WHERE complexity >= 8) AS n_complex FROM blocks GROUP BY path),
dup AS (SELECT path, count(*) AS n FROM (SELECT path, trim(raw) AS s FROM rl WHERE length(trim(raw)) > 20 GROUP BY path, trim(raw) HAVING count(*) > 1) q GROUP BY path),
m0 AS (SELECT x.path, len(string_split_regex(content, '\r?\n')) AS n_lines, len(regexp_extract_all(content, '{BRANCH}')) AS branches, len(regexp_extract_all(content, '\b(?:import|from)\b')) AS imports, len(regexp_extract_all(content, '\bexport\b')) + len(regexp_extract_all(content, '\bdef\b')) AS exports, regexp_matches(x.path, '(?i)payment|webhook|token|secret|signature|auth|session') OR regexp_matches(content, '(?i)\b(?:payment|webhook|secret|token|signature|auth|session)\b') AS sensitive, coalesce(dup.n, 0) AS duplicates, coalesce(n_complex, 0) AS n_complex, big.name, coalesce(big.length, 0) AS length, big.cc, big.start_line
  FROM {fixed.files_sql(fixed.REFACTOR_FILES)} x LEFT JOIN big ON big.path = x.path LEFT JOIN dup ON dup.path = x.path WHERE NOT regexp_matches(substr(content, 1, 200), '(?i)generated')),
m1 AS (SELECT *, CASE WHEN n_lines < 40 THEN 0 WHEN n_lines > 80 THEN 35 ELSE 20 END + CASE WHEN branches < 8 THEN 0 WHEN branches >= 16 THEN 30 ELSE 18 END + least(20, 2 * duplicates) + least(10, imports // 6) + least(10, exports // 6) + least(12, 3 * n_complex) + CASE WHEN length > 80 THEN 12 ELSE 0 END AS pain, 35 + greatest(0, 25 - exports // 2) + greatest(0, 20 - imports // 2) - CASE WHEN sensitive THEN 20 ELSE 0 END AS safety FROM m0),
m2 AS (SELECT *, safety >= 65 AS ready, pain >= 60 OR (safety >= 65 AND n_lines >= 70 AND n_complex > 0) AS whole FROM m1)"""


@query("refactor_metrics_fixture", f"WITH {BLOCKS_CTE}, {METRICS_CTE} SELECT path, CAST(n_lines AS BIGINT) AS n_lines, CAST(branches AS BIGINT) AS branches, CAST(duplicates AS BIGINT) AS duplicates, CAST(pain AS INTEGER) AS pain, CAST(safety AS INTEGER) AS safety FROM m2")
def refactor_metrics_fixture(spark, sf_dir):
    rows = rf.file_metrics(fixed.files(spark, fixed.REFACTOR_FILES), RULES, True)
    return rows.select("path", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("branches").cast("bigint").alias("branches"), F.col("duplicates").cast("bigint").alias("duplicates"), "pain", "safety")


@query("refactor_fixture", f"WITH {BLOCKS_CTE}, {METRICS_CTE} SELECT CASE WHEN whole THEN 'refactor:' || path ELSE 'refactor:function:' || path || ':' || start_line END AS id, CASE WHEN ready THEN 'low' ELSE 'medium' END AS severity, CASE WHEN whole AND ready THEN 'Ready for refactor' WHEN whole THEN 'Add tests before refactor' WHEN ready THEN 'Function ready for refactor' ELSE 'Add tests before function refactor' END AS title FROM m2 WHERE whole OR (length >= 80 AND cc >= 8)")
def refactor_fixture(spark, sf_dir):
    return rf.refactor_candidates(fixed.files(spark, fixed.REFACTOR_FILES), RULES).select("id", "severity", "title")


@query("largest_block_conversations", "SELECT conv_id, max(length) AS length FROM (SELECT u.conv_id, u.turn, coalesce(min(n.turn), (SELECT max(turn) + 1 FROM conversations c WHERE c.conv_id = u.conv_id)) - u.turn AS length FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.role = 'user' AND n.turn > u.turn WHERE u.role = 'user' GROUP BY u.conv_id, u.turn) q GROUP BY conv_id")
def largest_block_conversations(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    each = Window.partitionBy("conv_id")
    ends = turns.withColumn("n", F.max("turn").over(each) + 1).where("role = 'user'").withColumn("next", F.coalesce(F.lead("turn").over(each.orderBy("turn")), "n"))
    return ends.groupBy("conv_id").agg(F.max(F.col("next") - F.col("turn")).alias("length"))


# --- graph -------------------------------------------------------------------------------

EDGE_ROWS = [("pkg/__init__.py", "pkg/__init__.py"), ("pkg/more.py", "pkg/tools.py"), ("pkg/tools.py", "pkg/more.py"), ("src/alone.js", "src/live.ts"), ("src/billing/helper.ts", "src/billing/oldInvoice.ts"), ("src/billing/oldInvoice.ts", "src/billing/helper.ts"), ("src/index.ts", "src/live.ts"), ("src/routes/extra.tsx", "src/billing/helper.ts"), ("tests/test_more.py", "pkg/more.py")]


@query("import_edges_fixture", f"SELECT * FROM {fixed.values(EDGE_ROWS, 'src, dst')}")
def import_edges_fixture(spark, sf_dir):
    return import_edges(source_nodes(fixed.files(spark, fixed.FILES)))


@query("import_specifiers_fixture", f"SELECT * FROM {fixed.values([('src/index.ts', './live'), ('src/index.ts', 'lodash'), ('src/billing/oldInvoice.ts', './helper'), ('src/billing/helper.ts', './oldInvoice'), ('src/routes/extra.tsx', '../billing/helper'), ('src/alone.js', './live'), ('pkg/__init__.py', '.'), ('pkg/__init__.py', 'tools'), ('pkg/tools.py', 'pkg.more'), ('pkg/more.py', '.tools'), ('pkg/more.py', 'old_tool'), ('tests/test_more.py', 'pkg.more')], 'path, spec')} WHERE spec NOT IN ('tools', 'old_tool')")
def import_specifiers_fixture(spark, sf_dir):
    return imports(source_nodes(fixed.files(spark, fixed.FILES))).select("path", "spec")


CHAIN_ROWS = [
    ("dead-chain:2:src/billing/helper.ts", "low", "medium", "Dead chain candidate", "src/billing/helper.ts and 2 linked files look isolated from active entrypoints.", "dead-chain"),
]


@query("dead_chain_fixture", f"SELECT * FROM {fixed.values(CHAIN_ROWS, 'id, severity, confidence, title, message, tags')}")
def dead_chain_fixture(spark, sf_dir):
    rows = dead_chains(fixed.files(spark, fixed.FILES), tools.parsed(fixed.raw_outputs(spark), tools=["knip"]))
    return rows.select("id", "severity", "confidence", "title", "message", F.array_join("tags", ",").alias("tags"))


PART_EDGES = "e AS (SELECT p_partkey AS src, 2 * p_partkey AS dst FROM part WHERE p_partkey > 0 AND 2 * p_partkey <= (SELECT max(p_partkey) FROM part))"


def part_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    keys = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    edges = keys.where("path > 0").select(F.col("path").alias("src"), (F.col("path") * 2).alias("dst"))
    return keys, edges.join(keys.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst")


@query("reachability_part", f"WITH RECURSIVE {PART_EDGES}, r AS (SELECT 1::BIGINT AS path UNION SELECT 3::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.path) SELECT path FROM r")
def reachability_part(spark, sf_dir):
    _, edges = part_graph(spark, sf_dir)
    return reachable(edges, spark.createDataFrame([(1,), (3,)], "path bigint"))


# The nodes that nothing reaches from the seeds, as in dead chains.
@query("unreached_components_part", f"WITH RECURSIVE {PART_EDGES}, alive AS (SELECT 1::BIGINT AS path UNION SELECT 3::BIGINT UNION SELECT e.dst FROM alive JOIN e ON e.src = alive.path), n AS (SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT path FROM alive)), b AS (SELECT src, dst FROM e WHERE src IN (SELECT path FROM n) AND dst IN (SELECT path FROM n) UNION SELECT dst, src FROM e WHERE src IN (SELECT path FROM n) AND dst IN (SELECT path FROM n)), r(path, reach) AS (SELECT path, path FROM n UNION SELECT r.path, b.dst FROM r JOIN b ON b.src = r.reach) SELECT path, min(reach) AS component FROM r GROUP BY path")
def unreached_components_part(spark, sf_dir):
    keys, edges = part_graph(spark, sf_dir)
    return weak_components(keys.join(reachability_part(spark, sf_dir), "path", "left_anti"), edges)


# --- paths, projects, plans -----------------------------------------------------------------

PATHS = ["src/a.ts", "src/deep/b.py", ".hidden/c.js", "node_modules/x/index.js", "pkg/node_modules/y.ts", "dist/out.js", "a.py", "docs/readme.md", "coverage/lcov.info", "egg/x.egg-info/PKG.py", "app/__pycache__/m.py"]


@query("glob_filter", r"SELECT path FROM " + fixed.values([(p,) for p in PATHS], "path") + r" WHERE regexp_matches(path, '^(src/.+|(.*/)?[^/]+\.(js|py|ts))$') AND NOT regexp_matches(path, '(^|/)(node_modules|__pycache__)/.+|^(dist|coverage|build|vendor|\.next|\.git)/.+|(^|/)\.venv/.+|(^|/)dist/.+|(^|/)[^/]*\.egg-info/.+')")
def glob_filter(spark, sf_dir):
    from codeweir.sources.files import DEFAULT_EXCLUDES

    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return paths.where(matches_globs(F.col("path"), ["src/**", "**/*.{js,py,ts}"], list(DEFAULT_EXCLUDES)))


@query("directory_prune", r"SELECT path FROM " + fixed.values([(p,) for p in PATHS], "path") + r" WHERE NOT regexp_matches(path, '(^|/)(node_modules|__pycache__|dist)/|^(coverage|logs)/|/x\.egg-info/')")
def directory_prune(spark, sf_dir):
    from codeweir.sources.files import DEFAULT_EXCLUDES, gitignore_globs

    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return paths.where(~pruned(F.col("path"), [*DEFAULT_EXCLUDES, *gitignore_globs("# notes\n/logs/\n*.md\n!keep\n")]))


PROJECT_PATHS = ["package.json", "yarn.lock", "pyproject.toml", "uv.lock", "src/app.ts", "src/view.jsx", "service/manage.py", "tests/test_a.py", "tsconfig.json"]


@query("language_profile", "SELECT 'javascript,python,typescript' AS languages, 'uv,yarn' AS package_managers, 'django' AS framework_hints, 'package.json,tsconfig.json,pyproject.toml,uv.lock' AS config_files, 'yarn.lock,uv.lock' AS lockfiles, true AS has_tests, true AS has_python_tests")
def language_profile(spark, sf_dir):
    rows = project.profile(spark.createDataFrame([(p,) for p in PROJECT_PATHS], "path string"))
    return rows.select(*(F.array_join(c, ",").alias(c) for c in ("languages", "package_managers", "framework_hints", "config_files", "lockfiles")), "has_tests", "has_python_tests")


@query("document_profile", "SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(DISTINCT source) AS sources FROM documents")
def document_profile(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    langs = docs.select("lang").distinct().agg(F.array_join(F.sort_array(F.collect_list("lang")), ",").alias("langs")).withColumn("k", F.lit(1))
    sources = docs.select("source").where("source is not null").distinct().agg(F.count(F.lit(1)).alias("sources")).withColumn("k", F.lit(1))
    return langs.join(sources, "k").select("langs", "sources")


PACKAGE = '{"scripts":{"test":"vitest run","build":"tsc","e2e":"jest --ci"},"dependencies":{"react":"19","next":"16"},"devDependencies":{"vitest":"3"},"workspaces":["apps/*"]}'


@query("package_metadata", "SELECT 'pnpm test,pnpm run e2e' AS test_commands, 'nextjs,react,vitest,monorepo' AS framework_hints")
def package_metadata(spark, sf_dir):
    rows = project.package_metadata(spark.createDataFrame([("package.json", PACKAGE)], "path string, content string"), F.lit("pnpm"))
    return rows.select(F.array_join("test_commands", ",").alias("test_commands"), F.array_join("framework_hints", ",").alias("framework_hints"))


PLAN_ROWS = [("default", i, t) for i, t in enumerate(["gitleaks", "osv-scanner", "semgrep", "tsc", "biome", "knip", "jscpd", "lizard", "vitest", "custom-leftovers", "custom-refactor"])] + [("quick", i, t) for i, t in enumerate(["gitleaks", "osv-scanner", "tsc", "biome", "custom-leftovers"])]


@query("scan_plan", f"SELECT mode, CAST(place AS INTEGER) AS place, source FROM {fixed.values(PLAN_ROWS, 'mode, place, source')}")
def scan_plan(spark, sf_dir):
    rows = [(mode, i, t) for mode in ("default", "quick") for i, t in enumerate(plans.plan_sources(["typescript"], ["yarn.lock"], ["vitest"], ["yarn test"], Config(), mode))]
    return spark.createDataFrame(rows, "mode string, place int, source string")


AVAILABLE = ["tsc", "ruff", "gitleaks"]


@query("setup_missing_tools", "SELECT id, priority FROM " + fixed.values([(t.id, t.priority) for t in CATALOG if t.executable and t.executable not in AVAILABLE], "id, priority"))
def setup_missing_tools(spark, sf_dir):
    have = spark.createDataFrame([(x,) for x in AVAILABLE], "executable string")
    return setup_tools(spark).where("executable is not null").join(have, "executable", "left_anti").select("id", "priority")


@query("changed_file_semijoin", "SELECT path FROM " + fixed.values([("src/index.ts",), ("pkg/tools.py",)], "path"))
def changed_file_semijoin(spark, sf_dir):
    changed = spark.createDataFrame([("src/index.ts",), ("pkg/tools.py",), ("gone.ts",), ("src/index.ts",)], "path string")
    return plans.changed_only(fixed.files(spark, fixed.FILES), changed).select("path")


@query("corpus_scores", None)
def corpus_scores(spark, sf_dir):
    """The flagship: documents as text files, vocabulary matches as findings, merged, scored in
    all categories."""
    return fx.category_scores(fx.merged(doc_findings(spark, sf_dir))).select("category", "penalty_cents", "score_cents")


def doc_findings(spark, sf_dir) -> DataFrame:
    rows = doc_lines(spark, sf_dir)
    low = F.lower("line")
    found = F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(g).alias("grp"), F.lit(p).alias("pattern"))) for g, p in VOCAB_ROWS)))
    each = rows.select("doc_id", "line_no", "line", F.posexplode(found).alias("at", "m"))
    return fx.completed(
        each.select(
            F.concat_ws(":", F.lit("vocab"), "doc_id", "line_no", "m.pattern").alias("id"),
            F.lit("custom-leftovers").alias("source"),
            F.when(F.col("m.grp") == "secret", "security").otherwise("leftovers").alias("category"),
            F.when(F.col("m.grp") == "secret", "high").otherwise("low").alias("severity"),
            F.lit("medium").alias("confidence"),
            F.concat(F.lit("Vocabulary: "), F.col("m.grp")).alias("title"),
            trim(F.col("line")).alias("message"),
            F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"),
            F.col("line_no").alias("start_line"),
            F.array(F.lit("vocab"), F.col("m.grp")).alias("tags"),
            (F.col("doc_id") * (1 << 24) + F.col("line_no") * 64 + F.col("at")).alias("ord"),
        )
    )


SQL["corpus_scores"] = rf"WITH {DOC_LINES}, v AS (SELECT * FROM {fixed.values(VOCAB_ROWS, 'grp, pattern')}), m AS (SELECT DISTINCT doc_id, line_no, grp, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS msg FROM doc_lines JOIN v ON contains(lower(line), pattern)), p AS (SELECT CASE grp WHEN 'secret' THEN 'security' ELSE 'leftovers' END AS category, CAST(sum(CASE grp WHEN 'secret' THEN 1620 ELSE 216 END) AS BIGINT) AS penalty_cents FROM m GROUP BY 1) SELECT d.category, coalesce(penalty_cents, 0) AS penalty_cents, CAST(greatest(0, 10000 - coalesce(penalty_cents, 0)) AS BIGINT) AS score_cents FROM (VALUES ('security'), ('correctness'), ('dead_code'), ('leftovers'), ('maintainability'), ('dependencies'), ('tests'), ('efficiency'), ('refactor_readiness')) d(category) LEFT JOIN p ON p.category = d.category"

from codeweir import edge_queries, table_queries  # noqa: E402, F401  register their own
