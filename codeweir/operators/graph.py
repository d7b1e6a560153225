"""Distributed graph steps: reachability and weakly connected components. Each round is
written to the shared folder, so lineage stays short and lost executors
cost no more than a round."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, once, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all
    runs on this machine, a temporary folder of our own; on a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="codeweir-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """path of all nodes that edges (src, dst) reach from seeds (path), seeds included. A round
    expands only the last round's new nodes."""
    return closure(edges.select("src", "dst").distinct(), seeds)


#: Rounds that are kept apart before they are put together.
ROUNDS = 16


def closure(edges: DataFrame, begin: DataFrame, limit=lambda rows: rows) -> DataFrame:
    """path: of begin and of what distinct edges lead to, round by round, all that limit lets through.
    Edges are written once, so that no round makes them again from what they come from; a round
    writes its new nodes alone."""
    edges = cut(edges)
    new = cut(limit(begin.select("path").distinct()))
    rounds = [new]
    while not new.isEmpty():
        step = limit(edges.join(new, F.col("src") == F.col("path"), "left_semi").select(F.col("dst").alias("path")).distinct())
        new = cut(step.join(united(rounds), "path", "left_anti"))
        rounds.append(new)
        if len(rounds) == ROUNDS:
            rounds = [cut(united(rounds))]
    return united(rounds)


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, component (smallest path of its component) of nodes (path) under edges between
    them. Labels take the smallest neighbour label, then jump to their label's label,
    until none changes: rounds grow with the logarithm of a chain."""
    inside = edges.join(nodes.select(F.col("path").alias("src")), "src", "left_semi").join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
    links = cut(inside.union(inside.select("dst", "src")).where("src <> dst").distinct())
    labels = cut(nodes.select("path", F.col("path").alias("component")).distinct())
    while True:
        near = links.join(labels, F.col("dst") == F.col("path")).groupBy("src").agg(F.min("component").alias("least"))
        lower = labels.join(near, F.col("path") == F.col("src"), "left").select("path", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("mid"))
        # The label that one's own label now has.
        jump = lower.select(F.col("path").alias("j_path"), F.col("mid").alias("j_mid"))
        after = cut(lower.join(jump, F.col("mid") == F.col("j_path"), "left").select("path", "old", F.least("mid", F.coalesce("j_mid", "mid")).alias("component")))
        labels = after.select("path", "component")
        if after.where("old <> component").isEmpty():
            return labels
