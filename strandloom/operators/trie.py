"""Dictionary trie of many strings, from the sorted strings.

A string has only those nodes of its own that lie beyond what it shares with the string before, as in front
coding; all tables are linear in these. The node that a string hangs on belongs to the nearest string before
it that shares less with the one before that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import lcp_length
from strandloom.operators.nearest import BLOCK, nearest_smaller
from strandloom.plans.ordering import blocked_running_sum, dense_index
from strandloom.plans.session import checkpointed, dropped


def _front_coded(df: DataFrame, s: str) -> DataFrame:
    """`(i, s, size, lcp)` of the distinct strings that are not empty, in order: `lcp` characters are those of
    the string before."""
    strings = df.where(F.length(s) > 0).select(F.col(s).alias("s")).distinct()
    numbered = dense_index(strings, ["s"], "i")
    before = numbered.select((F.col("i") + 1).alias("i"), F.col("s").alias("_before"))
    shared = F.coalesce(lcp_length(F.col("s"), F.col("_before")), F.lit(0)).cast("bigint")
    rows = numbered.join(before, "i", "left").select("i", "s", F.length("s").cast("bigint").alias("size"), shared.alias("lcp"))
    rows = checkpointed(rows)
    dropped(numbered)
    return rows


def trie_edges(df: DataFrame, s: str, block: int = BLOCK) -> DataFrame:
    """Edges `(parent, child, symbol)` of the trie, the root being 1.

    Nodes are numbered level by level, in alphabetical order within a level.
    """
    rows = _front_coded(df, s)
    near = nearest_smaller(rows, "i", "lcp", rows.count(), block).select(F.col("r").alias("i"), F.col("prev").alias("_from"))
    own = F.substring("s", (F.col("lcp") + 1).cast("int"), F.col("size").cast("int"))
    nodes = rows.select("i", "lcp", F.posexplode(F.split(own, "")).alias("_p", "symbol")).where("symbol <> ''")
    nodes = nodes.select("i", "lcp", (F.col("lcp") + F.col("_p") + 1).alias("depth"), "symbol")
    numbered = checkpointed(dense_index(nodes, ["depth", "i"], "_n").withColumn("child", F.col("_n") + 2).drop("_n"))
    first = F.col("depth") == F.col("lcp") + 1
    hung = numbered.join(near, "i").select("child", "symbol", F.when(first, F.col("_from")).otherwise(F.col("i")).alias("_i"), (F.col("depth") - 1).alias("_depth"))
    parents = numbered.select(F.col("i").alias("_i"), F.col("depth").alias("_depth"), F.col("child").alias("parent"))
    return hung.join(parents, ["_i", "_depth"], "left").select(F.coalesce("parent", F.lit(1).cast("bigint")).alias("parent"), "child", "symbol")


def _paths(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Numbers of the nodes along every string of a block: the last of each depth up to the string."""
    rows = rows.sort_values("i", ignore_index=True)
    last = np.zeros(int(rows["size"].max()) + 1 if len(rows) else 1, np.int64)
    last[starts["_depth"].to_numpy()] = starts["_before"].to_numpy()
    sizes, own = rows["size"].to_numpy(), rows["lcp"].to_numpy()
    out, low = [], 0
    while low < len(rows):  # about a million nodes at a time
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), 1 << 20, "right")) + low)
        size, ends = sizes[low:high], np.cumsum(sizes[low:high])
        depth = np.arange(ends[-1]) - np.repeat(ends - size, size) + 1
        new = depth > np.repeat(own[low:high], size)
        order = np.argsort(depth, kind="stable")
        upto = np.cumsum(new[order])
        head = np.flatnonzero(np.diff(depth[order], prepend=0))
        earlier = np.repeat((upto - new[order])[head], np.diff(np.append(head, len(order))))
        path = np.empty(len(depth), np.int64)
        path[order] = last[depth[order]] + upto - earlier
        last[: int(size.max()) + 1] += np.bincount(depth[new], minlength=int(size.max()) + 1)
        out += np.split(path, ends[:-1])
        low = high
    return pd.DataFrame({"lcp": own, "path": out})


def trie_ancestors(df: DataFrame, s: str, block: int = 4096) -> DataFrame:
    """`(origin, node, steps)`: from every node of `trie_edges` to each one above it, up to the root.

    The nodes of a depth are numbered in the strings' order, so the node of a string's prefix is the last one of
    its depth so far: counts per block of strings and depth tell all, and nothing is walked edge by edge.
    """
    rows = _front_coded(df, s).select("i", "size", "lcp", F.floor(F.col("i") / block).alias("_block"))
    each = rows.where("lcp < size").select("_block", F.explode(F.sequence(F.col("lcp") + 1, F.col("size"))).alias("_depth"))
    counts = checkpointed(each.groupBy("_block", "_depth").agg(F.count("*").alias("_n")))
    depths = counts.groupBy("_depth").agg(F.sum("_n").alias("_all")).withColumn("_one", F.lit(1))
    shallower = blocked_running_sum(depths, ["_one"], "_depth", "_all", "_upto")
    shallower = shallower.select("_depth", (F.col("_upto") - F.col("_all") + 1).alias("_first"))  # the root is 1
    # Every depth that a block's strings reach, also those whose nodes all came before it.
    deepest = rows.groupBy("_block").agg(F.max("size").alias("_deep"))
    grid = deepest.select("_block", F.explode(F.sequence(F.lit(1).cast("bigint"), "_deep")).alias("_depth"))
    filled = grid.join(counts, ["_block", "_depth"], "left").na.fill(0, ["_n"])
    along = Window.partitionBy("_depth").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("_sum", F.coalesce(F.sum("_n").over(along), F.lit(0))).join(shallower, "_depth")
    starts = starts.select(F.col("_block").alias("_of"), "_depth", (F.col("_first") + F.col("_sum")).alias("_before"))
    paths = rows.groupBy("_block").cogroup(starts.groupBy("_of")).applyInPandas(_paths, "lcp bigint, path array<bigint>")
    own = paths.where("lcp < size(path)").select("path", F.explode(F.sequence(F.col("lcp") + 1, F.size("path").cast("bigint"))).alias("_d"))
    origin = F.element_at("path", F.col("_d").cast("int")).alias("origin")
    above = F.concat(F.array(F.lit(1).cast("bigint")), F.slice("path", F.lit(1), (F.col("_d") - 1).cast("int")))
    up = own.select(origin, "_d", F.posexplode(above).alias("_at", "node"))
    return up.select("origin", "node", (F.col("_d") - F.col("_at")).cast("int").alias("steps"))


def compact_trie(df: DataFrame, index: str, s: str, block: int = BLOCK) -> DataFrame:
    """Nodes of the compact trie `(string, parent, label, str_index)`, without the root.

    Nodes are the strings themselves and the prefixes after which they part; a string given
    more than once keeps its last index.
    """
    rows = _front_coded(df, s)
    near = nearest_smaller(rows, "i", "lcp", rows.count(), block)
    least = F.lit(0).cast("bigint")
    forks = near.where("v > 0").select(F.col("prev").alias("i"), F.col("v").alias("depth"), F.greatest("prev_v", F.coalesce("next_v", least)).alias("up"))
    after = rows.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("_after"))
    shorter = F.when(F.col("_after") < F.col("size"), F.col("_after")).otherwise(least)
    ends = rows.join(after, "i", "left").select("i", F.col("size").alias("depth"), F.greatest("lcp", F.coalesce(shorter, least)).alias("up"))
    nodes = forks.unionByName(ends).groupBy("i", "depth").agg(F.max("up").alias("up"))
    last = df.where(F.length(s) > 0).groupBy(F.col(s).alias("s")).agg(F.max(index).alias("str_index"))
    texts = rows.select("i", "s", "size").join(last, "s")
    depth, up = F.col("depth").cast("int"), F.col("up").cast("int")
    return nodes.join(texts, "i").select(
        F.left("s", depth).alias("string"), F.left("s", up).alias("parent"), F.substring("s", up + 1, depth - up).alias("label"),
        F.when(F.col("depth") == F.col("size"), F.col("str_index")).alias("str_index"),
    )


def dictionary_lookup(df: DataFrame, index: str, s: str, queries: DataFrame, query: str) -> DataFrame:
    """Queries with the index of the same string in the dictionary (the last one), or NULL."""
    last = df.groupBy(F.col(s).alias(query)).agg(F.max(index).alias("str_index"))
    return queries.join(last, query, "left")
