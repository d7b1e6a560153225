"""Dead chains: files that no entry point reaches by imports, by connected cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.functions.text import basename, dirname, matches_globs, normalise_path
from codeweir.operators.automaton import containing
from codeweir.operators.findings import CONFIDENCES, EVIDENCE, completed, ranked
from codeweir.operators.graph import cut, reachable, weak_components
from codeweir.operators.leftovers import SOURCE_FILES
from codeweir.operators.numbering import numbered
from codeweir.sources.files import DEFAULT_EXCLUDES

# Fixed values.
PY_IMPORT = r"(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))"
JS_IMPORT = r"""(?:import|export)\s+(?:[^"'`]+?\s+from\s+)?["'`]([^"'`]+)["'`]"""
JS_REQUIRE = r"""require\(\s*["'`]([^"'`]+)["'`]\s*\)"""
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
ENTRY = r"(^|/)(main|index|app|server|cli)\.(ts|tsx|js|jsx|py)$"
SRC_ENTRY = r"^src/(index|main|app|server)\.(ts|tsx|js|jsx|py)$"
TITLE, REVIEW_TITLE = "Dead chain candidate", "Review-only dead chain candidate"
ISOLATED, MANUAL = " look isolated from active entrypoints", ", but package initializers require manual review"
UNREACHED = "No active entrypoint reaches this cluster."
HAS_PACKAGE = "One or more files are package initializers that may expose implicit package behavior."
HAS_TEST, NO_TEST = "One or more files are referenced by tests.", "No tests reference this cluster."
INSIDE = "The files mostly call each other inside the same isolated cluster."
REVIEW = "Review this chain manually before any deletion because it includes a Python package initializer:\n"
DELETE = "Review and, if unused at runtime, delete this chain as one unit:\n"


def is_test_node(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/|\.test\.|\.spec\.")


def source_nodes(files: DataFrame) -> DataFrame:
    """path, content, is_test, language of source files outside the default excludes."""
    p = F.col("path")
    language = F.when(p.endswith(".py"), "python").when(p.rlike(r"\.tsx?$"), "typescript").otherwise("javascript")
    kept = files.where(p.rlike(SOURCE_FILES) & matches_globs(p, ["**/*"], list(DEFAULT_EXCLUDES)))
    return kept.select("path", "content", is_test_node(p).alias("is_test"), language.alias("language"))


def imports(nodes: DataFrame) -> DataFrame:
    """path, spec: distinct import specifiers of each file."""
    c, python = F.col("content"), F.col("language") == "python"
    found = F.when(python, F.concat(F.regexp_extract_all(c, F.lit(PY_IMPORT), F.lit(1)), F.regexp_extract_all(c, F.lit(PY_IMPORT), F.lit(2)))).otherwise(
        F.concat(F.regexp_extract_all(c, F.lit(JS_IMPORT), F.lit(1)), F.regexp_extract_all(c, F.lit(JS_REQUIRE), F.lit(1)))
    )
    return nodes.where(F.length(c) > 0).select("path", "language", F.explode(F.array_distinct(found)).alias("spec")).where("spec <> ''")


def candidates(path: Column, language: Column, spec: Column) -> Column:
    """Paths a specifier may mean, best first; none for packages."""
    raw = normalise_path(F.concat(dirname(path), F.lit("/"), spec))
    script = F.array(raw, *(F.concat(raw, F.lit(e)) for e in JS_EXTENSIONS), *(F.concat(raw, F.lit(f"/index{e}")) for e in JS_EXTENSIONS))
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    rest = F.translate(F.substring(spec, dots + 1, F.length(spec)), ".", "/")
    up = F.concat(dirname(path), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    near = lambda tail: normalise_path(F.concat(up, F.lit("/"), rest, F.lit(tail)))
    dotted = F.translate(spec, ".", "/")
    none = F.array().cast("array<string>")
    python = F.when(spec.startswith("."), F.array(near(""), near(".py"), near("/__init__.py"))).otherwise(F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
    return F.when(language == "python", python).when(spec.startswith("."), script).otherwise(none)


def import_edges(nodes: DataFrame) -> DataFrame:
    """src, dst: each specifier with the best of its candidates that is a node. An equi-join
    on the path, then a minimum by rank."""
    options = imports(nodes).select(F.col("path").alias("src"), "spec", F.posexplode(candidates(F.col("path"), F.col("language"), F.col("spec"))).alias("rank", "option"))
    found = options.join(nodes.select(F.col("path").alias("dst")), F.col("option") == F.col("dst"))
    return found.groupBy("src", "spec").agg(F.min_by("dst", "rank").alias("dst")).select("src", "dst")


def entry_points(nodes: DataFrame) -> DataFrame:
    p = F.col("path")
    return nodes.where((p.rlike(ENTRY) & ~F.col("is_test")) | p.rlike(SRC_ENTRY)).select("path")


#: Names that are looked for at once.
NAMES = 100_000


def mentions(files: DataFrame, names: DataFrame) -> DataFrame:
    """component, o, name of the names whose base a file's path contains: an automaton over all
    bases reads each path once for each NAMES of them."""
    names = cut(names)
    blocks = -(-names.count() // NAMES)
    found = files.sparkSession.createDataFrame([], "component string, o long, name string")
    for nth in range(blocks):
        some = names.where(F.pmod(F.xxhash64("base"), F.lit(blocks)) == nth)
        bases = [r["base"] for r in some.select("base").distinct().collect()]  # a block
        numbers = files.sparkSession.createDataFrame(list(enumerate(bases)), "nth int, n_base string")
        at = containing(files, "path", bases).select("component", F.explode("found").alias("at")).distinct()
        rows = at.join(numbers, F.col("at") == F.col("nth")).join(some, F.col("n_base") == F.col("base"))
        found = found.union(rows.select("component", "o", "name"))
    return found.distinct()


def dead_chains(files: DataFrame, findings: DataFrame, min_confidence: str = "medium") -> DataFrame:
    """Findings of unreachable clusters: those of several files, or a file that a dead-code
    finding names. Numbered by the first file of the cluster.

    findings give the files with dead code and the names of unused dependencies. Their
    rows are reduced to distinct names first, whose basenames are looked for in all paths
    at once.
    """
    nodes = cut(source_nodes(files))
    edges = cut(import_edges(nodes))
    alive = reachable(edges, entry_points(nodes))
    dead = cut(nodes.where("not is_test").select("path").join(alive, "path", "left_anti"))
    members = cut(weak_components(dead, edges))
    flagged = findings.where((F.col("category") == "dead_code") & (F.length("file") > 0)).select(F.col("file").alias("path")).distinct().withColumn("has_dead", F.lit(True))
    tested = edges.join(nodes.where("is_test").select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct().withColumn("has_test", F.lit(True))
    p = F.col("path")
    dynamic = F.when(p.rlike(r"\.tsx?$"), p.rlike("(?i)route|plugin|dynamic")).otherwise(p.rlike("(?i)manage|settings|celery"))
    package = p.endswith("/__init__.py") | (p == "__init__.py")
    rows = members.join(flagged, "path", "left").join(tested, "path", "left").select("component", "path", "has_dead", "has_test", dynamic.alias("dynamic"), package.alias("package"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    groups = rows.groupBy("component").agg(F.sort_array(F.collect_list("path")).alias("files"), flag("has_dead"), flag("has_test"), flag("dynamic"), flag("package"))
    kept = groups.where((F.size("files") > 1) | F.col("has_dead"))
    names = findings.where((F.col("category") == "dependencies") & F.col("title").rlike("(?i)unused dependency"))
    names = names.groupBy(F.split("message", " ")[0].alias("name")).agg(F.min("ord").alias("o")).withColumn("base", basename(F.col("name"))).where("base <> ''")
    used = mentions(kept.select("component", F.explode("files").alias("path")), names).groupBy("component")
    used = used.agg(F.transform(F.array_sort(F.collect_set(F.struct("o", "name"))), lambda x: x["name"]).alias("deps"))
    rows = kept.join(used, "component", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    return completed(_described(numbered(rows, [F.col("files")[0]], "number"))).where(ranked(F.col("confidence"), CONFIDENCES) >= CONFIDENCES.index(min_confidence))


def _described(rows: DataFrame) -> DataFrame:
    files, package = F.col("files"), F.col("package")
    number = F.col("number")
    confidence = F.when(package | F.col("has_test"), "low").when(F.col("dynamic"), "medium").otherwise("high")
    listing = F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f)), "\n")
    reasons = F.array_compact(
        F.array(
            F.lit(UNREACHED),
            F.when(package, HAS_PACKAGE),
            F.when(F.col("has_test"), HAS_TEST).otherwise(NO_TEST),
            F.lit(INSIDE),
        )
    )
    linked = F.when(F.size(files) > 1, F.concat(F.lit(" and "), (F.size(files) - 1).cast("string"), F.lit(" linked files"))).otherwise("")
    deps = F.when(F.size("deps") > 0, F.concat(F.lit(" Dependencies: "), F.array_join("deps", ", "))).otherwise("")
    return rows.select(
        F.concat(F.lit("dead-chain:"), number.cast("string"), F.lit(":"), files[0]).alias("id"),
        F.lit("custom-dead-chain").alias("source"),
        F.lit("dead_code").alias("category"),
        F.when(confidence == "high", "medium").otherwise("low").alias("severity"),
        confidence.alias("confidence"),
        F.when(package, REVIEW_TITLE).otherwise(TITLE).alias("title"),
        F.concat(files[0], linked, F.lit(ISOLATED), F.when(package, MANUAL).otherwise(""), F.lit(".")).alias("message"),
        files[0].alias("file"),
        F.when(package, F.concat(F.lit(REVIEW), listing)).otherwise(F.concat(F.lit(DELETE), listing)).alias("agent_instruction"),
        F.when(package, F.array(F.lit("dead-chain"), F.lit("review-only"))).otherwise(F.array(F.lit("dead-chain"))).alias("tags"),
        F.struct(F.concat(F.array_join(reasons, " "), F.lit(" Files: "), F.array_join(files, ", "), deps).alias("snippet"), F.lit(None).cast("string").alias("tool_raw_id"), F.lit(None).cast("string").alias("matched_pattern")).cast(EVIDENCE).alias("evidence"),
        number.alias("ord"),
    )
