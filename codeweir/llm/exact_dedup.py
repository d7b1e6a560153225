"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of their normalised text, those that share a length
by a hash of a prefix, and only those that share that too by a hash of the full
content. Each refinement is a semi-join against a small key table, so texts are not
shuffled while that table is small enough to be broadcast (its size is checked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import checked_broadcast, table, written

#: Characters hashed by the second refinement.
PREFIX = 256
#: Rows up to which a key table (16 bytes a row) is broadcast.
MAX_BROADCAST = 500_000


def normalised(col: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Only runs that
    change are matched."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, full_hash (null unless
    length and prefix are shared) and the columns of carry (expressions over docs).

    The smallest id of equal texts stays. Null texts count as empty. A null id stays
    only if its group has no other; rows that repeat both id and text stay or go
    together. An empty table gives an empty result. Other columns are ignored.
    """
    text = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__t"), *(c.alias(f"__c_{n}") for n, c in (carry or {}).items()))
    sized = base.withColumn("__n", F.length("__t"))
    lengths = written(sized.groupBy("__n").count().where("count > 1").select(F.col("__n").alias("__ln")), "dedup-lengths")
    sharing = sized.join(checked_broadcast(lengths, MAX_BROADCAST), F.col("__n") == F.col("__ln"), "left")
    prefix = F.when(F.col("__ln").isNotNull(), F.xxhash64(F.substring("__t", 1, PREFIX)))
    keyed = sharing.withColumn("__p", prefix)
    prefixes = written(
        keyed.where("__p is not null").groupBy("__n", "__p").count().where("count > 1").select(F.col("__n").alias("__pn"), F.col("__p").alias("__pp")),
        "dedup-prefixes",
    )
    refined = keyed.join(checked_broadcast(prefixes, MAX_BROADCAST), (F.col("__n") == F.col("__pn")) & (F.col("__p") == F.col("__pp")), "left")
    full = F.when(F.col("__pn").isNotNull(), F.sha2("__t", 256))
    extra = [F.col(f"__c_{n}").alias(n) for n in (carry or {})]
    rows = written(refined.select(F.col("__id").alias(id_col), full.alias("full_hash"), *extra), "dedup-rows")
    shared = rows.where("full_hash is not null")
    groups = shared.groupBy(F.col("full_hash").alias("__h")).agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # One hash may hold a third of all rows: beside a broadcast they stay where they are;
    # beyond its bound the join is an equi-join that adaptive execution splits.
    groups = checked_broadcast(written(groups, "dedup-groups"), MAX_BROADCAST)
    grouped = shared.join(groups, F.col("full_hash") == F.col("__h")).drop("__h")
    single = rows.where("full_hash is null").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    found = grouped.select(single.columns).union(single)
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with their columns, without the rows that exact_duplicates() drops."""
    dropped = written(exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__drop"), F.col("full_hash").alias("__drop_hash")), "dedup-dropped")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))  # so that no name can clash
    same = (F.col("__row")[id_col].eqNullSafe(F.col("__drop"))) & (F.sha2(normalised(F.col("__row")[text_col]), 256) == F.col("__drop_hash"))
    return rows.join(checked_broadcast(dropped, MAX_BROADCAST // 4), same, "left_anti").select("__row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exact_duplicates(docs, carry={"text_sha256": F.sha2(normalised(F.col("text")), 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""
