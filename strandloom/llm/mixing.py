"""Mix sources to target weights by whole documents.

Sources, ordered by code point with null last, have weights that repeat (3, 1, 2, 3, 1, ...).
Together they get `boost` times all words. A source's target stops at `most` times its own
words; what is over goes to the others by weight until none is above.

A target is met in whole passes over the source plus a subset of its documents. The subset comes
from the counts of documents per exact length: first the same share of every length, rounded down;
then one more of a length, those rounded down furthest first, while it fits; what then is
missing is a bounded knapsack, solved by dynamic programming over the missing words. Which
documents of a length are taken is the order of a seeded hash.

Only counts per source and length reach a Python task: its rows are as many as a source has
different lengths. Within a hot length, documents are ranked by stretches of the hash.
Documents without words take part with size 0; a null text has none. Very long texts are documents of their
length, taken whole or not at all. Rows without a key, and repeated rows, count as documents of their own; of rows
that are equal in key and size, any may be taken. An empty table gives an empty result. Only the three columns are read,
so names of others cannot clash. Rows of one key share a stretch of the hash, so a key should not hold a large share of
the rows of one length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.ordering import dense_index
from strandloom.plans.session import checkpointed

_WORD = r"[^\x20\x09-\x0D]+"
_STRETCHES = 4096


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def knapsack(sizes: np.ndarray, copies: np.ndarray, budget: int) -> np.ndarray:
    """How often to take each size (at most `copies`) so that the sum comes closest to `budget`
    from below. Time and memory go with the budget."""
    take = np.zeros(len(sizes), np.int64)
    use = np.flatnonzero((sizes > 0) & (sizes <= budget) & (copies > 0))
    if not len(use) or budget <= 0:
        return take
    by = np.full(budget + 1, -1, np.int64)  # the item that first reached a sum
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in use:
        left, part = int(min(copies[i], budget // sizes[i])), 1
        while left > 0 and not reached[budget]:
            part = min(part, left)
            step = int(sizes[i]) * part
            if step <= budget:
                new = np.flatnonzero(reached[: budget + 1 - step] & ~reached[step:]) + step
                reached[new] = True
                by[new] = len(items)
                items.append((int(i), part))
            left -= part
            part *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, part = items[by[at]]
        take[i] += part
        at -= int(sizes[i]) * part
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, most: int, window: int = 1 << 16) -> tuple[int, np.ndarray]:
    """Whole passes, and how many documents of each size to take once more."""
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts, strict=True))
    if total <= 0:
        return 0, np.zeros(len(sizes), np.int64)
    passes = min(most, int(target // total))
    missing = 0 if passes >= most else min(total, round(target - passes * total))
    exact = counts * (missing / total)
    extra = np.minimum(np.floor(exact).astype(np.int64), counts)
    missing -= sum(int(s) * int(e) for s, e in zip(sizes, extra, strict=True))
    for i in np.argsort(extra - exact, kind="stable"):
        if missing > window and 0 < sizes[i] <= missing and extra[i] < counts[i]:
            extra[i] += 1
            missing -= int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):  # only if single documents exceed the window
        if missing > window and sizes[i] > 0:
            n = min(int(counts[i] - extra[i]), int(missing // sizes[i]))
            extra[i] += n
            missing -= n * int(sizes[i])
    while missing < 0:  # rounding of the share; one document of the smallest size goes back
        i = next(j for j in np.argsort(sizes, kind="stable") if extra[j] > 0 and sizes[j] > 0)
        extra[i] -= 1
        missing += int(sizes[i])
    return passes, extra + knapsack(sizes, counts - extra, int(min(missing, window)))


def targets(sources: DataFrame, size: str, weight: str, boost: float, most: int) -> DataFrame:
    """Add `target`: the level at which capped shares add up to `boost` times all words.

    Every round caps the sources above their limit and shares the rest anew; there are as many
    rounds as the set of capped sources changes, and only sums reach the driver.
    """
    total, level = sources.agg(F.sum(size)).first()[0] or 0, 0.0
    capped = -1
    while total:
        over = F.col(weight) * F.lit(level) >= most * F.col(size)
        row = sources.agg(
            F.count_if(over), F.sum(F.when(over, most * F.col(size)).otherwise(0)), F.sum(F.when(~over, F.col(weight)).otherwise(0))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (boost * total - row[1]) / row[2]
    return sources.withColumn("target", F.least(F.col(weight) * F.lit(float(level)), (most * F.col(size)).cast("double")))


def mix(docs: DataFrame, key: str, text: str, source: str, weights=(3, 1, 2), boost: float = 1.5, most: int = 2, seed: int = 20) -> DataFrame:
    """`(key, size, source_size, target, taken)` for every row: `taken` is the number of words
    that the mix has of this document, repeats counted."""
    sized = checkpointed(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(text).alias("size")))
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("_source").isNull())
    ranked = dense_index(sums, ["_last", "_source"], "_rank")
    cycle = F.array(*(F.lit(w) for w in weights))
    weighted = ranked.withColumn("_weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    aimed = checkpointed(targets(checkpointed(weighted), "source_size", "_weight", boost, most))
    aimed = aimed.select(F.col("_source").alias("_named"), "_rank", "source_size", "target")
    rows = sized.join(aimed, F.col("_source").eqNullSafe(F.col("_named"))).drop("_source", "_named")
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_key"))
    stretches = checkpointed(
        rows.groupBy("_rank", "target", "size", F.pmod("_hash", F.lit(_STRETCHES)).alias("_stretch")).agg(F.count("*").alias("_n"))
    )

    def plan(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        passes, extra = fit(lengths["size"].to_numpy(), lengths["_count"].to_numpy(), float(lengths["target"].iloc[0]), most)
        return pd.DataFrame({"_rank": lengths["_rank"], "size": lengths["size"], "_passes": passes, "_extra": extra})

    lengths = stretches.groupBy("_rank", "target", "size").agg(F.sum("_n").alias("_count"))
    planned = lengths.groupBy("_rank").applyInPandas(plan, "_rank bigint, size bigint, _passes bigint, _extra bigint")
    before = Window.partitionBy("_rank", "size").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_extra") - F.coalesce("_before", F.lit(0))))
    shares = (
        stretches.withColumn("_before", F.sum("_n").over(before))
        .join(planned, ["_rank", "size"])
        .select("_rank", "size", "_stretch", "_passes", quota.alias("_quota"))
    )
    inside = Window.partitionBy("_rank", "size", "_stretch").orderBy("_hash", "_key")
    ranked_rows = rows.withColumn("_stretch", F.pmod("_hash", F.lit(_STRETCHES))).withColumn("_place", F.row_number().over(inside))
    out = ranked_rows.join(shares, ["_rank", "size", "_stretch"])
    once_more = F.when(F.col("_place") <= F.col("_quota"), 1).otherwise(0)
    return out.select(
        F.col("_key").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("_passes") + once_more)).alias("taken")
    )
