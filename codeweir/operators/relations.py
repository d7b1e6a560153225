"""Related findings of every finding: those of its file (or lack of one) or of its category. No
pair is formed: counts come from groups by inclusion and exclusion, and the first few
from each group's first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST = 5
_MARK = "__of"


def _grouped(keys: list[str], findings: DataFrame, name: str) -> DataFrame:
    """Keys with the number of their findings, as name; keys are named after the group."""
    return findings.groupBy(*(F.col(k).alias(f"{name}_{k}") for k in keys)).agg(F.count(F.lit(1)).alias(name))


def _same(keys: list[str], name: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
    return same


def _first_of(key: str, findings: DataFrame, first: int) -> DataFrame:
    """A group's first findings (ord, id): enough that, whichever id is left out, its first few
    are among them. At most `first` of an id count, and so twice as many are enough."""
    narrow = findings.select(F.col(key).alias(f"{_MARK}_{key}"), "ord", "id")
    of_id = F.row_number().over(Window.partitionBy(f"{_MARK}_{key}", "id").orderBy("ord"))
    few = narrow.withColumn("nth", of_id).where(F.col("nth") <= first).drop("nth")
    of_group = F.row_number().over(Window.partitionBy(f"{_MARK}_{key}").orderBy("ord"))
    few = few.withColumn("nth", of_group).where(F.col("nth") <= 2 * first)
    return few.groupBy(f"{_MARK}_{key}").agg(F.collect_list(F.struct("ord", "id")).alias(f"first_{key}"))


def related_to_all(findings: DataFrame, first: int = FIRST) -> DataFrame:
    """ord, id, n_related and related (ids of the first few by ord) of each finding. Related are
    findings of another id whose file or category is the same; missing files are one file.
    A null id is no other's. Null categories are the same as none, not even each other."""
    rows = findings.select("ord", "id", "file", "category")
    for name, keys in {"n_file": ["file"], "n_category": ["category"], "n_both": ["file", "category"], "own_file": ["id", "file"], "own_category": ["id", "category"], "own_both": ["id", "file", "category"]}.items():
        counted = _grouped(keys, findings, name)
        if "category" in keys:
            counted = counted.where(F.col(f"{name}_category").isNotNull())
        rows = rows.join(counted, _same(keys, name), "left").drop(*(f"{name}_{k}" for k in keys))
    many = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = many("n_file") + many("n_category") - many("n_both") - (many("own_file") + many("own_category") - many("own_both"))
    none = F.array().cast("array<struct<ord:bigint,id:string>>")
    for key in ("file", "category"):
        firsts = _first_of(key, findings, first)
        rows = rows.join(firsts, _same([key], _MARK), "left").drop(f"{_MARK}_{key}")
    of_category = F.when(F.col("category").isNotNull(), F.col("first_category"))
    near = F.array_sort(F.array_distinct(F.concat(F.coalesce("first_file", none), F.coalesce(of_category, none))))
    others = F.filter(near, lambda x: ~x["id"].eqNullSafe(F.col("id")))
    return rows.select("ord", "id", total.alias("n_related"), F.transform(F.slice(others, 1, first), lambda x: x["id"]).alias("related"))
