"""Global order without a single-partition window.

A window without PARTITION BY, or one whose partition key is hot, sends everything to one
task. The helpers here sort by range instead: Spark samples the sort key, spreads the rows
over range partitions, and only one number per partition is summed up afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.session import checkpointed

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Add 0-based positions of the rows in the order of `order` (a unique key).

    Rows are range-partitioned and sorted, so a hot leading key is spread by the later ones.
    The sorted rows are checkpointed because range bounds come from sampling: the count
    per partition and the rows themselves must come from one and the same run.
    """
    sorted_rows = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    split = F.shiftright("_mid", _LOCAL_BITS)
    # One row per range partition, a bounded number however large the data is.
    sizes = sorted_rows.groupBy(split.alias("_pid")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = (
        sorted_rows.withColumn("_pid", split)
        .join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + local)
        .drop("_pid", "_mid", "_start")
    )
    numbered._written_to = sorted_rows._written_to  # for `dropped`
    return numbered


def _blocked(df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int, how) -> DataFrame:
    """Add `_carry`, the aggregate of the blocks before, and `_inside`, that of the own block
    up to the row. No window sees more than `width` rows or one row per block."""
    rows = df.withColumn("_block", F.floor(F.col(pos) / width))
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(how(value).alias("_total"))
    carries = totals.select(*keys, "_block", how("_total").over(by_block).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carries, [*keys, "_block"]).withColumn("_inside", how(value).over(inside))


def blocked_running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, width: int = 4096
) -> DataFrame:
    """Inclusive running sum of `value` along `pos` (unique per key), in blocks of `width`."""
    blocked = _blocked(df, keys, pos, value, width, F.sum)
    total = F.coalesce("_carry", F.lit(0)) + F.col("_inside")
    return blocked.withColumn(name, total).drop("_block", "_carry", "_inside")


def blocked_running_max(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, width: int = 4096
) -> DataFrame:
    """Inclusive running maximum of `value`, NULLs passed over, in the same way."""
    blocked = _blocked(df, keys, pos, value, width, F.max)
    return blocked.withColumn(name, F.greatest("_carry", "_inside")).drop("_block", "_carry", "_inside")


def blocked_running_min(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, width: int = 4096
) -> DataFrame:
    """Inclusive running minimum of `value`, NULLs passed over, in the same way."""
    blocked = _blocked(df, keys, pos, value, width, F.min)
    return blocked.withColumn(name, F.least("_carry", "_inside")).drop("_block", "_carry", "_inside")


def ordered_concat(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, width: int = 4096
) -> DataFrame:
    """Join the strings of each key in the order of the integer `pos` (unique per key).

    Done in two steps, so that no task collects more than `width` pieces plus one string per
    block; the joined string itself is one cell of the result.
    """

    def joined(order: str, text: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(pairs, lambda p: p[text]), "")

    blocks = (
        df.groupBy(*keys, F.floor(F.col(pos) / width).alias("_block"))
        .agg(joined(pos, value).alias("_text"))
    )
    return blocks.groupBy(*keys).agg(joined("_block", "_text").alias(name))
