"""Connected components of an undirected graph by alternating star contraction.

Each round joins every node to the smallest node around it, first over its larger and then
over its smaller neighbours, which needs a logarithmic number of rounds also on long chains.
The smallest neighbour is an aggregate combined before the shuffle, so a hub with a third of
all edges is no single task's work; joining it back is an equi-join with unique keys on the
other side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.session import checkpointed, dropped


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round on directed pairs `(u, v)`."""
    if larger:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = F.col("v") > F.col("u")
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        move = F.lit(True)
    roots = around.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    moved = around.where(move).join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.union(roots.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Every node with the smallest node of its component: `(node, component)`."""
    pairs = checkpointed(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        before, pairs = pairs, checkpointed(_star(_star(pairs, larger=True), larger=False))
        dropped(before)
        # Done when a round leaves the set of edges as it was.
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == seen:
            break
        seen = now
    labels = pairs.select(F.col("u").alias(node), F.col("v").alias("_root"))
    return nodes.select(node).distinct().join(labels, node, "left").select(
        node, F.coalesce("_root", node).alias("component")
    )


def edges_to_tree(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """How many edges are missing to join the components into one tree."""
    parts = connected_components(nodes, edges, node, src, dst)
    return parts.agg((F.count_if(F.col("component") == F.col(node)) - 1).alias("missing_edges"))
