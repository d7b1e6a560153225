"""Source files as a table, and the globs that choose them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.functions.text import glob_regex

# Fixed values.
DEFAULT_EXCLUDES = ("node_modules/**", "**/node_modules/**", "dist/**", "**/dist/**", "build/**", ".venv/**", "**/.venv/**", "coverage/**", ".next/**", "vendor/**", ".git/**", "**/__pycache__/**", "**/*.egg-info/**")


def gitignore_globs(content: str) -> list[str]:
    """Patterns of a .gitignore as globs: comments and negations go, a leading slash goes, a
    trailing one means all below."""
    rows = [line.strip() for line in re.split(r"\r?\n", content)]
    return [x + "**" if x.endswith("/") else x for x in (r.removeprefix("/") for r in rows if r and r[0] not in "#!")]


def pruned(path: Column, globs: list[str]) -> Column:
    """Whether any directory above the path is left out: its path, or a file directly in it,
    matches a glob. Files themselves aren't tested."""
    if not globs:
        return F.lit(False)
    some = "|".join(glob_regex(g) for g in globs)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))
    return path.contains("/") & F.exists(parents, lambda d: d.rlike(some) | F.concat(d, F.lit("/__probe__")).rlike(some))


def relative(path: Column, root: str) -> Column:
    """A path as it is seen from root: without it below, by steps up beside or above. Paths that
    don't begin with a slash stay as they are. Null and empty: null."""
    parts = root.rstrip("/").split("/")
    seen = path
    for up in range(len(parts) - 1, -1, -1) if root.startswith("/") else [0]:
        above = "/".join(parts[: len(parts) - up]) + "/"
        inside = F.concat(path, F.lit("/")).startswith(above)
        rest = F.concat(F.lit("../" * up), F.substring(path, F.lit(len(above) + 1), F.length(path)))
        seen = F.when(inside, F.regexp_replace(rest, "/$", "")).otherwise(seen)
    return F.when(F.length(path) > 0, seen)


def read_files(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """path (relative), content of all files below root outside pruned directories, with the
    root's .gitignore on top of the excludes."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).withColumn("__at", F.col("_metadata.file_path"))
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    plain = F.regexp_replace(F.url_decode("__at"), "^file:/+", "/")
    files = rows.select(relative(plain, base).alias("path"), F.col("value").alias("content"))
    own = files.where("path = '.gitignore'").limit(1).collect()
    globs = [*(DEFAULT_EXCLUDES if excludes is None else excludes), *(gitignore_globs(own[0]["content"]) if own else [])]
    return files.where(~pruned(F.col("path"), globs))
