"""A graph that changes: what is reached, and weak components, kept under batches of added and
deleted edges. What a batch may have broken is taken back first and derived again from
what stands; nodes that no change can touch are neither expanded nor relabelled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweir.operators.graph import closure, cut, reachable, weak_components


@dataclass
class GraphState:
    """edges (src, dst), seeds (path), reached (path), labels (path, component) of all nodes. Of the
    last batch: doubted (path), what it took back to derive again, and torn (path), what it labelled anew."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    reached: DataFrame
    labels: DataFrame
    doubted: DataFrame | None = None
    torn: DataFrame | None = None


def begin(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> GraphState:
    """The state of a whole graph, from nothing. Edges to or from what is no node are left out."""
    nodes = cut(nodes.select("path").distinct())
    edges = cut(_inside(edges.select("src", "dst").distinct(), nodes))
    seeds = cut(seeds.join(nodes, "path", "left_semi").select("path").distinct())
    return GraphState(nodes, edges, seeds, reachable(edges, seeds), weak_components(nodes, edges))


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    at = lambda c: nodes.select(F.col("path").alias(c))
    return edges.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi").select("src", "dst")


def changed(state: GraphState, added: DataFrame, deleted: DataFrame) -> GraphState:
    """The state after a batch: first deleted edges go, then added ones come (one that is in both
    is there afterwards). Edges that are there already, that aren't, or that no nodes have
    change nothing."""
    one = lambda rows: rows.select("src", "dst").distinct()
    asked = cut(_inside(one(added), state.nodes))
    gone = cut(one(deleted).join(state.edges, ["src", "dst"], "left_semi").join(asked, ["src", "dst"], "left_anti"))
    added = cut(asked.join(state.edges, ["src", "dst"], "left_anti"))
    edges = cut(state.edges.join(gone, ["src", "dst"], "left_anti").union(added))

    # What a lost edge from a reached node led to may have been reached by it alone.
    lost = gone.join(state.reached.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).join(state.seeds, "path", "left_anti")
    may = state.reached.join(state.seeds, "path", "left_anti")
    doubt = cut(closure(state.edges, lost, lambda rows: rows.join(may, "path", "left_semi")))
    sure = cut(state.reached.join(doubt, "path", "left_anti"))
    # It is, if an edge from what is still reached leads to it; so is what new edges lead to.
    into = edges.join(doubt.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst").union(added)
    first = into.join(sure, F.col("src") == F.col("path"), "left_semi").select(F.col("dst").alias("path"))
    found = closure(edges, first, lambda rows: rows.join(sure, "path", "left_anti"))
    reached = cut(sure.union(found))

    # Components that lost an edge are labelled anew by the edges that they have left.
    hit = gone.join(state.labels, F.col("src") == F.col("path")).select("component").distinct()
    torn = cut(state.labels.join(hit, "component", "left_semi").select("path"))
    own = _inside(edges.join(added, ["src", "dst"], "left_anti"), torn)
    labels = cut(state.labels.join(torn, "path", "left_anti").select("path", "component").union(weak_components(torn, own)))
    # New edges join components: labels are the nodes of a small graph.
    of = lambda c: labels.select(F.col("path").alias(c), F.col("component").alias(f"{c}_label"))
    joins = added.join(of("src"), "src").join(of("dst"), "dst").where("src_label <> dst_label").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"))
    joins = cut(joins.distinct())
    ends = joins.select(F.col("src").alias("path")).union(joins.select(F.col("dst").alias("path"))).distinct()
    new = cut(weak_components(ends, joins).select(F.col("path").alias("old"), F.col("component").alias("new")))
    labels = cut(labels.join(new, F.col("component") == F.col("old"), "left").select("path", F.coalesce("new", "component").alias("component")))
    return GraphState(state.nodes, edges, state.seeds, reached, labels, doubt, torn)
