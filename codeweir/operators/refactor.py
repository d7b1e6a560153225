"""Refactor readiness: metrics of files and functions, pain against safety."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir.functions.text import lines, templated, trim, word
from codeweir.operators.findings import EVIDENCE, completed
from codeweir.operators.leftovers import SOURCE_FILES

# Fixed values.
BRANCHES = "if|else if|switch|case|catch|for|while|except"
FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z0-9_]+)|^\s*def\s+([A-Za-z0-9_]+)|^\s*(?:export\s+)?const\s+([A-Za-z0-9_]+)\s*=\s*(?:async\s*)?\("
SENSITIVE_PATH = "payment|webhook|token|secret|signature|auth|session"
SENSITIVE_WORDS = "payment|webhook|secret|token|signature|auth|session"
READY, PAIN = 65, 60


@dataclass(frozen=True)
class RefactorRules:
    min_lines: int = 500
    min_complexity: int = 15
    require_tests: bool = True


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(word(pattern)))


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/|\.test\.")


def functions(files: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, length, complexity. A block runs to the line before
    the next function, the last one to the file's end; windows are within a file."""
    each = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "text"))
    name = F.coalesce(*(F.nullif(F.regexp_extract("text", FUNCTION, i), F.lit("")) for i in (1, 2, 3)))
    marked = each.select("path", "pos", name.alias("name"), count(F.col("text"), BRANCHES).alias("branches"))
    by_line = Window.partitionBy("path").orderBy("pos")
    block = marked.withColumn("start", F.last(F.when(F.col("name").isNotNull(), F.col("pos")), True).over(by_line)).where("start is not null")
    rows = block.groupBy("path", "start").agg(F.first("name", True).alias("name"), (F.max("pos") + 1).alias("end_line"), F.sum("branches").cast("int").alias("complexity"))
    return rows.select("path", "name", (F.col("start") + 1).alias("start_line"), "end_line", (F.col("end_line") - F.col("start")).alias("length"), "complexity")


def repeated_lines(files: DataFrame) -> DataFrame:
    """path, duplicates: different lines of over 20 characters that a file repeats. Counted
    by file and line, so a file of any length is dealt over many tasks."""
    each = files.select("path", F.explode(F.transform(lines(F.col("content")), trim)).alias("text")).where(F.length("text") > 20)
    return each.groupBy("path", "text").count().groupBy("path").agg(F.count_if(F.col("count") > 1).alias("duplicates"))


def file_metrics(files: DataFrame, rules: RefactorRules, has_tests: bool | Column) -> DataFrame:
    c, path = F.col("content"), F.col("path")
    kept = files.where(path.rlike(SOURCE_FILES) & (F.length(c) > 0) & ~F.substring(c, 1, 200).rlike("(?i)generated"))
    blocks = functions(kept)
    best = F.max_by(F.struct("name", "start_line", "end_line", "length", "complexity"), F.struct(F.col("length"), -F.col("start_line")))
    largest = blocks.groupBy(path.alias("b_path")).agg(best.alias("largest"), F.count_if(F.col("complexity") >= rules.min_complexity).alias("n_complex"))
    repeats = repeated_lines(kept).withColumnRenamed("path", "r_path")
    base = kept.select(
        "path",
        F.size(lines(c)).alias("n_lines"),
        count(c, BRANCHES).alias("branches"),
        count(c, "import|from").alias("imports"),
        (count(c, "export") + count(c, "def")).alias("exports"),
        (path.rlike(f"(?i){SENSITIVE_PATH}") | c.rlike(f"(?i){word(SENSITIVE_WORDS)}")).alias("sensitive"),
    )
    rows = base.join(largest, path == F.col("b_path"), "left").join(repeats, path == F.col("r_path"), "left")
    rows = rows.withColumns({"n_complex": F.coalesce("n_complex", F.lit(0)), "duplicates": F.coalesce("duplicates", F.lit(0))})
    n, b = F.col("n_lines"), F.col("branches")
    by_size = F.when(n < rules.min_lines, 0).when(n > 2 * rules.min_lines, 35).otherwise(20)
    by_branches = F.when(b < rules.min_complexity, 0).when(b >= 2 * rules.min_complexity, 30).otherwise(18)
    tenth = lambda col: F.least(F.lit(10), F.floor(F.col(col) / 6))
    pain = by_size + by_branches + F.least(F.lit(20), F.col("duplicates") * 2) + tenth("imports") + tenth("exports") + F.least(F.lit(12), F.col("n_complex") * 3) + F.when(F.col("largest.length") > 80, 12).otherwise(0)
    tested = F.lit(has_tests) if isinstance(has_tests, bool) else has_tests
    by_tests = F.when(tested, 35).otherwise(5) if rules.require_tests else F.lit(25)
    safety = by_tests + F.greatest(F.lit(0), 25 - F.floor(F.col("exports") / 2)) + F.greatest(F.lit(0), 20 - F.floor(F.col("imports") / 2)) - F.when(F.col("sensitive"), 20).otherwise(0)
    rows = rows.withColumns({"pain": pain.cast("int"), "safety": safety.cast("int")}).withColumn("ready", F.col("safety") >= READY)
    near = F.col("ready") & (n >= -(-rules.min_lines * 7 // 4)) & (F.col("n_complex") > 0)
    return rows.withColumn("near", near).drop("b_path", "r_path")


def refactor_candidates(files: DataFrame, rules: RefactorRules = RefactorRules(), has_tests: bool | Column | None = None) -> DataFrame:
    """Findings: one of the file, or of its largest function, or none. has_tests: null to look
    for any test path among the files."""
    if has_tests is None:
        has_tests = files.where(is_test_file(F.col("path"))).limit(1).count() > 0
    m = file_metrics(files, rules, has_tests)
    big, path, ready = F.col("largest"), F.col("path"), F.col("ready")
    whole = (F.col("pain") >= PAIN) | F.col("near")
    part = ~whole & F.coalesce((big["length"] >= 80) & (big["complexity"] >= rules.min_complexity), F.lit(False))
    pick = lambda f, t, u: F.when(part, f).when(ready, t).otherwise(u)
    named = big["name"]
    message = F.when(
        part, F.when(ready, F.concat(named, F.lit(" in "), path, F.lit(" is a focused extraction candidate."))).otherwise(F.concat(named, F.lit(" in "), path, F.lit(" is complex, but needs better test safety before refactoring.")))
    ).otherwise(F.when(ready, F.concat(path, F.lit(" is large and tangled enough to split with moderate safety."))).otherwise(F.concat(path, F.lit(" looks painful, but test safety is too weak for a confident refactor."))))
    start_with = F.when(big.isNotNull(), F.concat(F.lit(" Start with "), named, F.lit("."))).otherwise("")
    first_tests = "Add focused tests around current behavior before changing structure"
    hint = F.when(
        part, F.when(ready, F.concat(F.lit("Extract "), named, F.lit(" into a smaller helper while keeping the public API unchanged."))).otherwise(F.concat(F.lit("Add tests covering "), named, F.lit(" before attempting a refactor.")))
    ).otherwise(
        F.when(ready, F.concat(F.lit("Keep the public entrypoint stable and extract smaller modules in small patches."), start_with))
        .when(F.col("sensitive"), f"{first_tests}, especially around the security-sensitive paths.")
        .otherwise(f"{first_tests}.")
    )
    snippet = F.when(part, templated("function=", named, "; lines=", big["length"], "; complexity=", big["complexity"], "; safety=", F.col("safety"))).otherwise(
        templated("lines=", F.col("n_lines"), "; pain=", F.col("pain"), "; safety=", F.col("safety"), "; imports=", F.col("imports"), "; exports=", F.col("exports"), "; largestFunction=", F.coalesce(named, F.lit("n/a")), ":", F.coalesce(big["length"], F.lit(0)), "; securitySensitive=", F.col("sensitive"))
    )
    state = F.when(ready, "ready").otherwise("tests-first")
    rows = m.where(whole | part).select(
        F.when(part, templated("refactor:function:", path, ":", big["start_line"])).otherwise(templated("refactor:", path)).alias("id"),
        F.lit("custom-refactor").alias("source"),
        F.lit("refactor_readiness").alias("category"),
        F.when(ready, "low").otherwise("medium").alias("severity"),
        F.lit("medium").alias("confidence"),
        pick(F.when(ready, "Function ready for refactor").otherwise("Add tests before function refactor"), "Ready for refactor", "Add tests before refactor").alias("title"),
        message.alias("message"),
        path.alias("file"),
        F.when(part, big["start_line"]).alias("start_line"),
        F.when(part, big["end_line"]).alias("end_line"),
        hint.alias("agent_instruction"),
        F.when(part, F.array(F.lit("refactor"), F.lit("function-level"), state)).otherwise(F.array(F.lit("refactor"), state)).alias("tags"),
        F.struct(snippet.alias("snippet"), F.lit(None).cast("string").alias("tool_raw_id"), F.lit(None).cast("string").alias("matched_pattern")).cast(EVIDENCE).alias("evidence"),
        F.lit(0).cast("long").alias("ord"),
    )
    return completed(rows)
