"""Walks over a tree given as a table of edges, one join per level for all starts at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.session import checkpointed


def _walk(
    edges: DataFrame, start: DataFrame, here: str, there: str, keys: Sequence[str], visit: Callable[[Column], Column]
) -> DataFrame:
    """Rows `start` (keys, `node`, `context`) moved along edges from `here` to `there`."""
    columns = [c for c in edges.columns if c not in {*keys, here, there}]
    frontier, seen = start.select(*keys, F.col("node").alias("origin"), "node", "context"), None
    while True:
        moved = (
            frontier.withColumnRenamed("node", here)
            .join(edges, [*keys, here])
            .withColumn("context", visit(F.col("context")))
            .where("context IS NOT NULL")
            .select(*keys, "origin", F.col(here).alias("previous"), F.col(there).alias("node"), *columns, "context")
        )
        moved = checkpointed(moved)
        if moved.isEmpty():
            return moved if seen is None else seen
        seen = moved if seen is None else seen.union(moved)
        frontier = moved.select(*keys, "origin", "node", "context")


def descendants(
    edges: DataFrame, start: DataFrame, parent: str, node: str, visit: Callable[[Column], Column], keys: Sequence[str] = ()
) -> DataFrame:
    """All nodes below each start, with a context passed down.

    `visit` gives the context after an edge from that before it and the edge's columns; NULL
    prunes the branch. The start itself is not visited.
    """
    return _walk(edges, start, parent, node, keys, visit)


def ancestors(
    edges: DataFrame, start: DataFrame, parent: str, node: str, visit: Callable[[Column], Column], keys: Sequence[str] = ()
) -> DataFrame:
    """All nodes above each start, up to the root or until `visit` gives NULL."""
    return _walk(edges, start, node, parent, keys, visit)
