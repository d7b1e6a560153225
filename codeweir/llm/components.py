"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweir.llm.common import written


def star_round(edges: DataFrame) -> DataFrame:
    """Edges (u above v) that connect the same nodes, each closer to the smallest: one round of components()."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = written(large, "large-star")
    least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    small = large.join(least, F.col("u") == F.col("n"))
    joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
    return written(joined, "small-star")


def settled(edges: DataFrame) -> bool:
    """Whether every node above others has one edge and is below none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").count() == 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that links reach) of every node that has links;
    links has the columns a and b. Each round joins every node's neighbours to the
    smallest of them, first those above it, then those below; rounds end when all edges
    are stars. Every round is written to the shared folder."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if settled(edges):
            break
        edges = star_round(edges)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
