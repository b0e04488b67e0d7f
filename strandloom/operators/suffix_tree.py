"""Compact suffix trees as tables, derived from the suffix array and its common prefixes.

An inner node is a run of suffixes that share more with each other than with those around the run. It is
named by the place before its run, the nearest one to the left that shares less, and the length shared; its
parent follows from the nearest smaller values on both sides. All tables are linear in the text.

Trees of texts that fit a task are made there, many at a time and in the same way with numpy, so that only texts are
shuffled and only edges leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.diagnostics import distribution
from strandloom.operators.nearest import BLOCK, last_smaller, nearest_smaller
from strandloom.operators.suffix import build_suffix_index, cut_by_size, local_texts, sorted_suffixes
from strandloom.plans.session import checkpointed, dropped


def _levels(nodes: DataFrame) -> DataFrame:
    """Nodes `(nid, up)` with the number of nodes above each but the root, by pointer doubling. Nodes
    that have arrived at the root are set aside."""
    state = checkpointed(nodes.select("nid", F.col("up").alias("_to"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("branch_depth")))
    while not state.where("_to IS NOT NULL").isEmpty():
        ahead = state.select(F.col("nid").alias("_to"), F.col("_to").alias("_next"), F.col("branch_depth").alias("_more"))
        moved = state.where("_to IS NOT NULL").join(ahead, "_to")
        moved = moved.select("nid", F.col("_next").alias("_to"), (F.col("branch_depth") + F.col("_more")).alias("branch_depth"))
        before, state = state, checkpointed(state.where("_to IS NULL").unionByName(moved))
        dropped(before)
    return state.drop("_to")


def _by_joins(df: DataFrame, key: str, seq: str, block: int) -> DataFrame:
    index = build_suffix_index(df, key, seq)
    sizes = df.select(key, F.length(seq).cast("bigint").alias("_size"))
    shared = index.common_prefixes().select(key, "r", "pos0", "prev0", "lcp")
    first = index.ordered.groupBy(key).agg(F.min(F.struct("r", "pos0")).alias("_first"))
    none = F.lit(None).cast("bigint").alias("prev0")
    heads = first.select(key, "_first.r", "_first.pos0", none, F.lit(-1).cast("bigint").alias("lcp"))
    rows = checkpointed(shared.unionByName(heads).join(sizes, key))
    near = checkpointed(nearest_smaller(rows, "r", "lcp", rows.count(), block))

    # An inner node is `(prev, v)`; its parent is the node of the longer of the neighbours that share less.
    after = F.coalesce("next_v", F.lit(-1))
    runs = near.where("v > 0").groupBy("prev", "v").agg(F.min("r").alias("nid"), F.max("prev_v").alias("prev_v"), F.max(after).alias("next_v"))
    before = near.select(F.col("r").alias("prev"), F.col("prev").alias("_before"))
    left = F.col("prev_v") >= F.col("next_v")
    inner = runs.join(before, "prev").select(
        "nid", "prev", "v", F.greatest("prev_v", "next_v").alias("up_v"), F.when(left, F.col("_before")).otherwise(F.col("prev")).alias("up_prev")
    )
    inner = checkpointed(inner)
    names = inner.select(F.col("prev").alias("up_prev"), F.col("v").alias("up_v"), F.col("nid").alias("up"))
    levels = _levels(inner.join(names, ["up_prev", "up_v"], "left").select("nid", "up"))
    placed = inner.join(levels, "nid")

    # A suffix that the next one begins with ends at the node of what they share, which starts there.
    members = near.where("v > 0").select("r", "prev", "v").join(rows.select(key, "r", "pos0", "prev0", "_size"), "r")
    ends = F.when(F.col("v") == F.col("_size") - F.col("prev0"), F.col("prev0"))
    of = members.groupBy("prev", "v").agg(F.max(key).alias(key), F.min("pos0").alias("pos0"), F.max(ends).alias("terminal"))
    nodes = placed.join(of, ["prev", "v"]).select(
        key, "pos0", F.col("v").alias("depth"), F.greatest("up_v", F.lit(0)).alias("parent_depth"), "branch_depth", "terminal"
    )

    # Every other suffix is a leaf below the longer prefix that it shares with its neighbours.
    right = rows.where("lcp >= 0").select((F.col("r") - 1).alias("r"), F.col("lcp").alias("_right"))
    leaves = rows.join(near.select("r", "prev"), "r").join(right, "r", "left").withColumn("_right", F.coalesce("_right", F.lit(0)))
    leaves = leaves.withColumn("depth", F.col("_size") - F.col("pos0")).where("_right < depth")
    here = F.col("lcp") >= F.col("_right")
    hung = leaves.select(
        key, "pos0", "depth", F.greatest("lcp", "_right", F.lit(0)).alias("up_v"), F.when(here, F.col("prev")).otherwise(F.col("r")).alias("up_prev")
    )
    above = placed.select(F.col("prev").alias("up_prev"), F.col("v").alias("up_v"), (F.col("branch_depth") + 1).alias("_below"))
    hung = hung.join(above, ["up_prev", "up_v"], "left")
    return nodes.unionByName(
        hung.select(
            key, "pos0", "depth", F.col("up_v").alias("parent_depth"), F.coalesce("_below", F.lit(0)).cast("bigint").alias("branch_depth"),
            F.col("pos0").alias("terminal"),
        )
    )


#: Steps to the left before a search; nearly all places need few.
_HOPS = 32


def _left_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the last one before it with a smaller value; -1 without one."""
    at = np.arange(-1, len(values) - 1)
    asking = np.arange(len(values))
    for _ in range(_HOPS):
        # All between a place and where it has come to is at least as large, also for the place it meets there.
        asking = asking[(at[asking] >= 0) & (values[np.maximum(at[asking], 0)] >= values[asking])]
        if not len(asking):
            return at
        at[asking] = at[at[asking]]
    asking = asking[at[asking] >= 0]
    at[asking] = last_smaller(values, at[asking] + 1, values[asking])
    return at


def _edges(size: np.ndarray, pos0: np.ndarray, prev0: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of the trees of all texts from their suffixes in order: of each the place of a suffix of its text, and then
    pos0, depth, parent_depth, branch_depth and terminal, -1 without one. `size` is that of the text, per suffix."""
    n, first = len(pos0), prev0 < 0
    lcp = np.where(first, -1, shared)  # parts the texts
    prev = _left_smaller(lcp)
    after = n - 1 - _left_smaller(lcp[::-1])[::-1]
    members = np.flatnonzero(lcp > 0)
    if not len(members):
        heads, node = members, np.full(n, -1)
    else:
        # The members of an inner node have the same place before and the same value.
        members = members[np.lexsort((lcp[members], prev[members]))]
        new = np.append(True, (prev[members[1:]] != prev[members[:-1]]) | (lcp[members[1:]] != lcp[members[:-1]]))
        heads, node = np.flatnonzero(new), np.full(n, -1)
        node[members] = np.cumsum(new) - 1
    at = members[heads]
    up_left = lcp[prev[at]]
    up_right = np.where(after[at] < n, lcp[np.minimum(after[at], n - 1)], -1)
    up_value = np.maximum(up_left, up_right)
    up = np.where(up_value > 0, node[np.where(up_left >= up_right, prev[at], np.minimum(after[at], n - 1))], -1)
    level, to = (up >= 0).astype(np.int64), up.copy()
    moving = np.flatnonzero(to >= 0)
    while len(moving):  # every round goes twice as far up
        more, further = level[to[moving]], to[to[moving]]
        level[moving] += more
        to[moving] = further
        moving = moving[further >= 0]
    ended = np.where(lcp[members] == size[members] - prev0[members], prev0[members], -1)
    some = (lambda how, x: how.reduceat(x, heads)) if len(heads) else (lambda how, x: x)
    inner = (at, some(np.minimum, pos0[members]), lcp[at], np.maximum(up_value, 0), level, some(np.maximum, ended))

    # Every suffix that the next one does not begin with is a leaf.
    right = np.maximum(np.append(lcp[1:], 0), 0)
    leaf = np.flatnonzero(right < size - pos0)
    here = lcp[leaf] >= right[leaf]
    above = node[np.where(here, leaf, np.minimum(leaf + 1, n - 1))]
    up_value = np.maximum(lcp[leaf], right[leaf])
    below = np.where((up_value > 0) & (above >= 0), np.append(level, 0)[above] + 1, 0)
    leaves = (leaf, pos0[leaf], (size - pos0)[leaf], np.maximum(up_value, 0), below, pos0[leaf])
    return tuple(np.concatenate(both) for both in zip(inner, leaves, strict=True))


def _trees_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["_seq"]).to_numpy()):
            row, pos0, prev0, shared, codes = sorted_suffixes(batch["_seq"].slice(low, high - low).to_pylist())
            sizes = np.bincount(row)
            of, *edges = _edges(sizes[row], pos0, prev0, shared)
            del pos0, prev0, shared
            start = np.cumsum(sizes) - sizes
            for at in range(0, len(of), 1 << 16):
                some = slice(at, at + (1 << 16))
                text = row[of[some]]
                *counted, terminal = [e[some] for e in edges]
                letter = codes[start[text] + counted[0] + counted[2]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_key"].take(pa.array(text + low)), *map(pa.array, counted), pa.array(terminal, mask=terminal < 0),
                        pa.array(map(chr, letter.tolist()), pa.string()),
                    ],
                    ["_key", "pos0", "depth", "parent_depth", "branch_depth", "terminal", "first_char"],
                )


def suffix_tree(df: DataFrame, key: str, seq: str, block: int = BLOCK, first_char: bool = False) -> DataFrame:
    """Edges, one per node but the root: `(key, pos0, depth, parent_depth, branch_depth, terminal)`.

    `pos0` is a position of the node's string, `depth` its length; `terminal` is the start of
    the suffix that ends at the node, if any; `branch_depth` counts the edges above its edge. The edge's
    characters are those from `parent_depth` to `depth` of the suffix at `pos0`; with `first_char`, the first of
    them is added.
    """
    texts, rest = local_texts(df, key, seq)
    kind = texts.schema["_key"].dataType.simpleString()
    shape = f"_key {kind}, pos0 bigint, depth bigint, parent_depth bigint, branch_depth bigint, terminal bigint, first_char string"
    columns = ["pos0", "depth", "parent_depth", "branch_depth", "terminal", *(["first_char"] if first_char else [])]
    own = texts.mapInArrow(_trees_here, shape).select(F.col("_key").alias(key), *columns)
    if rest is None:
        return own
    tree = _by_joins(rest, key, seq, block)
    if first_char:
        tree = tree.join(rest.select(key, F.col(seq).alias("_text")), key)
        tree = tree.withColumn("first_char", F.substring("_text", (F.col("pos0") + F.col("parent_depth") + 1).cast("int"), F.lit(1)))
    return own.unionByName(tree.select(key, *columns))


def edge_labels(tree: DataFrame, df: DataFrame, key: str, seq: str) -> DataFrame:
    """Add the characters on each edge."""
    label = F.substring(
        F.col("_text"), (F.col("pos0") + F.col("parent_depth") + 1).cast("int"),
        (F.col("depth") - F.col("parent_depth")).cast("int"),
    )
    return tree.join(df.select(key, F.col(seq).alias("_text")), key).withColumn("label", label).drop("_text")


def tree_stats(tree: DataFrame, key: str) -> DataFrame:
    """Per text: number of nodes without the root, which is that of edges, and the
    distributions of edge lengths and branch depths."""
    measured = checkpointed(tree.withColumn("edge_length", F.col("depth") - F.col("parent_depth")).select(key, "edge_length", "branch_depth"))
    counts = measured.groupBy(key).agg(F.count("*").alias("nodes"), F.count("*").alias("edges"))
    both = [distribution(measured, c, [key], p) for c, p in (("edge_length", "edge_"), ("branch_depth", "branch_"))]
    return counts.join(both[0], key).join(both[1], key)
