"""The findings table: schema, dimensions, merge, fingerprints, scores and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir.functions.text import squeeze, to_fixed, trim

SCHEMA = """id string, source string, category string, severity string, confidence string, title string,
message string, file string, start_line int, end_line int, is_new boolean, is_autofixable boolean,
safe_to_autofix boolean, fix_command string, agent_instruction string, tags array<string>,
evidence struct<snippet:string,tool_raw_id:string,matched_pattern:string>, score_impact double, ord bigint"""
COLUMNS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
EVIDENCE = "struct<snippet:string,tool_raw_id:string,matched_pattern:string>"

# Sources, categories in the order of priority with their weights, ranks.
SOURCES = ("ruff", "biome", "tsc", "pyright", "semgrep", "gitleaks", "osv-scanner", "knip", "vulture", "deptry", "jscpd", "lizard", "radon", "coverage.py", "vitest", "jest", "custom-leftovers", "custom-refactor", "custom-dead-chain")
PRIORITY = ("security", "tests", "correctness", "dependencies", "dead_code", "leftovers", "refactor_readiness", "maintainability", "efficiency")
WEIGHTS = {"security": 0.22, "correctness": 0.18, "tests": 0.15, "dependencies": 0.13, "maintainability": 0.12, "dead_code": 0.08, "leftovers": 0.06, "refactor_readiness": 0.04, "efficiency": 0.02}
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
PENALTY = {"critical": 42, "high": 15, "medium": 6, "low": 2, "info": 0.5}
MULTIPLIER = {"low": 0.25, "medium": 0.6, "high": 1}


def ranked(col: Column, names: tuple[str, ...]) -> Column:
    """Place of a name in names, from 0; null for others."""
    return F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))[col]


def named(rank: Column, names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))[rank]


def is_test_path(file: Column) -> Column:
    """Tests by directory or .test. infix; .spec. isn't one here."""
    return F.coalesce(file.rlike(r"\.test\.|(^|/)tests?/"), F.lit(False))


def completed(df: DataFrame) -> DataFrame:
    """df with all columns of a finding: those it lacks are filled as for a new finding
    that no tool can fix."""
    given = {"is_new": True, "is_autofixable": False, "safe_to_autofix": False, "score_impact": 0.0}
    kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.replace("\n", " ").split(", "))
    return df.select(*((F.col(c) if c in df.columns else F.lit(given.get(c))).cast(kinds[c]).alias(c) for c in COLUMNS))


# --- merge -------------------------------------------------------------------

MERGE_KEY = ["k_category", "k_file", "k_line", "k_title", "k_message"]


def with_merge_key(findings: DataFrame) -> DataFrame:
    return findings.withColumns(
        {
            "k_category": F.col("category"),
            "k_file": F.coalesce("file", F.lit("")),
            "k_line": F.coalesce(F.col("start_line").cast("string"), F.lit("")),
            "k_title": F.lower("title"),
            "k_message": F.lower(squeeze(F.col("message"))),
        }
    )


def merged(findings: DataFrame) -> DataFrame:
    """One row for each merge key, in the place of its first row (by ord).

    The highest severity and the source that first has it, the highest confidence, any
    autofix flag, the ordered union of tags (a lone row's tags stay as they are), the
    first evidence, command and instruction there is; all else from the first row. Rows of
    one ord (outputs of a tool that landed apart, findings of several files) follow a hash
    of what they say. Findings are read once: rows are reduced by key and tag, then by key, so
    that a key of any number of rows stays small.
    """
    said = [c for c in COLUMNS if c != "ord"]
    keyed = with_merge_key(findings).withColumn("place", F.struct("ord", F.xxhash64(*said).alias("tie")))
    # A row for each tag; what else a finding says goes with its first one alone.
    each = keyed.select("*", F.posexplode_outer("tags").alias("at", "tag")).withColumn("first", F.coalesce(F.col("at") == 0, F.lit(True)))
    whole = [c for c in COLUMNS if c in ("id", "category", "title", "message", "file", "start_line", "end_line", "is_new", "tags")]
    placed = lambda when, *cols: F.min(F.when(F.col("first") & when, F.struct("place", *cols)))
    given = ("fix_command", "agent_instruction", "evidence")
    sev, conf = ranked(F.col("severity"), SEVERITIES), ranked(F.col("confidence"), CONFIDENCES)
    by_tag = each.groupBy(*MERGE_KEY, "tag").agg(
        F.min(F.struct("place", "at")).alias("o"),
        F.count_if("first").alias("n"),
        placed(F.lit(True), F.struct(*whole).alias("said")).alias("f"),
        F.max(F.when(F.col("first"), F.struct(sev.alias("sev"), (-F.col("ord")).alias("o"), F.bitwise_not("place.tie").alias("t"), "source"))).alias("s"),
        F.max(conf).alias("conf"),
        F.bool_or("is_autofixable").alias("is_autofixable"),
        F.bool_or("safe_to_autofix").alias("safe_to_autofix"),
        *(placed(F.col(c).isNotNull(), c).alias(c) for c in given),
        F.max("score_impact").alias("score_impact"),
    )
    rows = by_tag.groupBy(*MERGE_KEY).agg(
        F.sum("n").alias("n_merged"),
        F.min("f").alias("f"),
        F.max("s").alias("s"),
        named(F.max("conf"), CONFIDENCES).alias("confidence"),
        F.bool_or("is_autofixable").alias("is_autofixable"),
        F.bool_or("safe_to_autofix").alias("safe_to_autofix"),
        *(F.min(c)[c].alias(c) for c in given),
        F.max("score_impact").alias("score_impact"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("o", "tag")))), lambda x: x["tag"]).alias("all_tags"),
    )
    made = {c: F.col(f"f.said.{c}") for c in whole} | {
        "source": F.col("s.source"),
        "severity": named(F.col("s.sev"), SEVERITIES),
        "tags": F.when(F.col("n_merged") > 1, F.col("all_tags")).otherwise(F.col("f.said.tags")),
        "ord": F.col("f.place.ord"),
    }
    return rows.select(*(made[c].alias(c) if c in made else F.col(c) for c in COLUMNS))


# --- fingerprints and baseline ---------------------------------------------------


def fingerprint() -> Column:
    """SHA-1 of category, source, title, file, line (blank with a snippet) and a hash of the
    snippet, else of the message."""
    snippet = F.col("evidence.snippet")
    said = F.lower(trim(F.coalesce(snippet, F.col("message"), F.lit(""))))
    line = F.when(F.length(snippet) > 0, "").otherwise(F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    parts = [F.col("category"), F.col("source"), F.col("title"), F.coalesce("file", F.lit("")), line, F.substring(F.sha1(said), 1, 12)]
    return F.sha1(F.concat_ws(":", *parts))


def flagged(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """is_new: whether the baseline (column fingerprint) lacks the finding."""
    known = baseline.select(F.col("fingerprint").alias("b_fp")).distinct()
    rows = findings.withColumn("__fp", fingerprint()).join(known, F.col("__fp") == F.col("b_fp"), "left")
    own_id = F.when(F.length("id") > 0, F.col("id")).otherwise(F.col("__fp"))
    return rows.withColumns({"id": own_id, "is_new": F.col("b_fp").isNull()}).select(*COLUMNS)


# --- scores ------------------------------------------------------------------------


def score_table() -> dict[str, int]:
    """Cents of each combination of severity, novelty, confidence, safe fix and test path."""
    out = {}
    for s, penalty in PENALTY.items():
        for new in (True, False):
            for c, factor in MULTIPLIER.items():
                for safe in (True, False):
                    for test in (True, False):
                        x = penalty * (1.5 if new else 0.3) * factor * (0.5 if safe else 1) * (0.6 if test else 1.2)
                        out[f"{s}|{str(new).lower()}|{c}|{str(safe).lower()}|{str(test).lower()}"] = int(to_fixed(x) * 100)
    return out


def score_cents() -> Column:
    """Penalty of a finding in hundredths, from the table of all combinations."""
    key = F.concat_ws("|", "severity", F.col("is_new").cast("string"), "confidence", F.col("safe_to_autofix").cast("string"), is_test_path(F.col("file")).cast("string"))
    return F.create_map(*(F.lit(x) for kv in score_table().items() for x in kv))[key].cast("long")


def category_scores(findings: DataFrame) -> DataFrame:
    """category, priority, weight, penalty_cents, score_cents of all nine categories."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(c, i, WEIGHTS[c]) for i, c in enumerate(PRIORITY)], "category string, priority int, weight double")
    sums = findings.groupBy("category").agg(F.sum(score_cents()).alias("cents")).withColumnRenamed("category", "s_category")
    rows = dim.join(sums, F.col("category") == F.col("s_category"), "left")
    penalty = F.coalesce("cents", F.lit(0)).cast("long")
    return rows.select("category", "priority", "weight", penalty.alias("penalty_cents"), F.greatest(F.lit(0).cast("long"), F.lit(10000) - penalty).alias("score_cents"))


#: The order in which the weighted sum adds categories, in doubles.
SUM_ORDER = ("security", "correctness", "tests", "dependencies", "maintainability", "dead_code", "leftovers", "refactor_readiness", "efficiency")


def overall_score(findings: DataFrame) -> DataFrame:
    """One row: overall, the weighted sum of category scores rounded half up. One pass with
    nine conditional sums; the doubles are added in a fixed order."""
    cents = findings.withColumn("__cents", score_cents())
    sums = cents.agg(*(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("__cents"))), F.lit(0)).alias(c) for c in SUM_ORDER))
    total = F.lit(0.0)
    for c in SUM_ORDER:
        total = total + F.greatest(F.lit(0.0), (F.lit(10000) - F.col(c)) / 100.0) * F.lit(WEIGHTS[c])
    return sums.select(F.floor(total + 0.5).cast("int").alias("overall"))


# --- order and slices ---------------------------------------------------------------


def order() -> list[Column]:
    """The seven keys of the report order, then the place before."""
    text = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE")
    return [
        ranked(F.col("category"), PRIORITY).asc(),
        ranked(F.col("severity"), SEVERITIES).desc(),
        F.col("is_new").desc(),
        text("file").asc(),
        F.coalesce("start_line", F.lit(0)).asc(),
        text("title").asc(),
        text("id").asc(),
        F.col("ord").asc(),
    ]


def is_blocker() -> Column:
    return F.col("severity").isin("high", "critical")


def top(findings: DataFrame, n: int) -> DataFrame:
    return findings.orderBy(*order()).limit(n)


def fix_next(findings: DataFrame) -> DataFrame:
    return top(findings.where("category <> 'leftovers'"), 3)


def top_findings(findings: DataFrame) -> DataFrame:
    """The first five blockers, or, where there are none, the first five findings: one top-k
    sort with blockers first; the rest is decided on its five rows."""
    first = findings.orderBy(is_blocker().desc(), *order()).limit(5)
    some = F.max(is_blocker()).over(Window.partitionBy(F.lit(0)))
    return first.withColumn("__some", some).where(is_blocker() | ~F.col("__some")).drop("__some").orderBy(*order())


def in_categories(findings: DataFrame, categories: list[str]) -> DataFrame:
    unknown = [c for c in categories if c not in PRIORITY]
    if unknown:
        raise ValueError(f"Unsupported finding categories: {', '.join(unknown)}")
    return findings.where(F.col("category").isin(*categories)) if categories else findings.where("false")


def parse_categories(value: str | None) -> list[str] | None:
    """Names from a comma-separated list; None (no filter) for no text."""
    if not value:
        return None
    found = [x.strip() for x in value.split(",") if x.strip()]
    unknown = [c for c in found if c not in PRIORITY]
    if unknown:
        raise ValueError(f"Unsupported finding categories: {', '.join(unknown)}")
    return found


def related(findings: DataFrame, finding_id: str) -> DataFrame:
    """Findings of another id in the file (or lack of one) or category of the first finding
    of this id. That one row is looked up first; the rest is a filter."""
    one = findings.where(F.col("id") == finding_id).orderBy("ord").select("file", "category").limit(1).collect()
    if not one:
        return findings.where("false")
    file, category = one[0]
    return findings.where((F.col("id") != finding_id) & (F.col("file").eqNullSafe(F.lit(file)) | (F.col("category") == category)))
