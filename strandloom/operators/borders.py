"""Prefixes of a text inside it, and border arrays, from the suffix index.

What a suffix shares with the whole text is the least common prefix of neighbours between the two in the
order of suffixes: a running minimum from the whole text's rank outwards, in blocks. A border that
ends at a position is a prefix found further right; the longest one starts first.

For texts that fit a task both are done there, many texts at a time, and only texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.suffix import build_suffix_index, cut_by_size, least_since, local_texts, sorted_suffixes
from strandloom.plans.ordering import blocked_running_min
from strandloom.plans.session import checkpointed


def prefix_matches(df: DataFrame, key: str, seq: str, width: int = 4096) -> DataFrame:
    """`(key, pos0, shared)`: how many characters the suffix at every position but the first shares with the
    whole text. One row per text with a unique `key`; texts of any length."""
    index = build_suffix_index(df, key, seq)
    whole = index.ordered.where("pos0 = 0").select(key, F.col("r").alias("_whole"))
    pairs = index.common_prefixes().join(whole, key)
    # The pair of ranks r - 1 and r belongs to the one that is further from the whole text.
    above = F.col("r") > F.col("_whole")
    steps = checkpointed(pairs.select(
        key, above.alias("_above"), F.when(above, F.col("r") - F.col("_whole")).otherwise(F.col("_whole") - F.col("r") + 1).alias("_steps"),
        F.when(above, F.col("pos0")).otherwise(F.col("prev0")).alias("pos0"), "lcp",
    ))
    return blocked_running_min(steps, [key, "_above"], "_steps", "lcp", "shared", width).select(key, "pos0", "shared")


def _by_joins(df: DataFrame, key: str, seq: str, width: int) -> DataFrame:
    matches = prefix_matches(df, key, seq, width).where("shared > 0")
    starts = matches.groupBy(key, (F.col("pos0") + F.col("shared") - 1).alias("_end")).agg(F.min("pos0").alias("_start"))
    sizes = df.select(F.col(key).alias("_of"), F.length(seq).cast("bigint").alias("_size")).where("_size > 0")
    each = sizes.select("_of", "_size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1)).alias("pos0"))
    rows = each.join(starts, (F.col("_of") == F.col(key)) & (F.col("pos0") == F.col("_end")), "left")
    rows = checkpointed(rows.select(F.col("_of").alias(key), "pos0", (F.col("_size") - 1 - F.col("pos0")).alias("_left"), "_start"))
    # The first start of a prefix that reaches the position.
    reached = blocked_running_min(rows, [key], "_left", "_start", "_first", width)
    border = F.when(F.col("_first") <= F.col("pos0"), F.col("pos0") + 1 - F.col("_first")).otherwise(F.lit(0))
    return reached.select(key, "pos0", F.coalesce(border, F.lit(0)).alias("border"))


def _borders(row: np.ndarray, pos0: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Border arrays of texts behind one another, from their suffixes in order."""
    whole = pos0 == 0
    rank = np.arange(len(row))
    start = np.searchsorted(row, row)  # of the text, among ranks as among positions
    after = rank > np.flatnonzero(whole)[row]
    up = least_since(shared, whole)
    down = least_since(np.append(shared[1:], 0)[::-1], whole[::-1])[::-1]
    prefix = np.zeros(len(row), np.int64)
    prefix[start + pos0] = np.where(whole, 0, np.where(after, up, down))
    found = np.flatnonzero(prefix)
    begins = np.full(len(row), len(row))
    np.minimum.at(begins, found + prefix[found] - 1, found)
    # The first start of a prefix that reaches the position; those of the texts behind begin further right.
    first = np.minimum.accumulate(begins[::-1])[::-1]
    return np.maximum(rank + 1 - first, 0)


def _borders_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["_seq"]).to_numpy()):
            row, pos0, _, shared, _ = sorted_suffixes(batch["_seq"].slice(low, high - low).to_pylist())
            border, pos0 = _borders(row, pos0, shared), np.arange(len(row)) - np.searchsorted(row, row)
            for at in range(0, len(row), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [batch["_key"].take(pa.array(row[some] + low)), pa.array(pos0[some]), pa.array(border[some])], ["_key", "pos0", "border"]
                )


def border_arrays(df: DataFrame, key: str, seq: str, width: int = 4096) -> DataFrame:
    """`(key, pos0, border)`: the length of the longest proper border of the prefix that ends at each position."""
    texts, rest = local_texts(df, key, seq)
    kind = texts.schema["_key"].dataType.simpleString()
    own = texts.mapInArrow(_borders_here, f"_key {kind}, pos0 bigint, border bigint").select(F.col("_key").alias(key), "pos0", "border")
    return own if rest is None else own.unionByName(_by_joins(rest, key, seq, width))
