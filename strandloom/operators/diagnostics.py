"""Distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.ordering import blocked_running_sum, dense_index
from strandloom.plans.session import checkpointed, dropped

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def distribution(df: DataFrame, value: str, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Mean, maximum and the five quantiles (values that occur, not interpolated) of every key.

    Rows are counted per value, the values put in order over all partitions and the counts summed up in
    blocks; a quantile is the least value with enough rows up to it. So a key's values may fill any number of tasks.
    """
    # Keys as one struct, which is never null, whatever its fields are.
    rows = df.select(F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key"), F.col(value).alias("_value"))
    counts = rows.where("_value IS NOT NULL").groupBy("_key", "_value").agg(F.count("*").alias("_rows"))
    placed = dense_index(counts, ["_key", "_value"], "_place")
    upto = checkpointed(blocked_running_sum(placed, ["_key"], "_place", "_rows", "_upto"))
    dropped(placed)
    sizes = upto.groupBy("_key").agg(F.sum("_rows").alias("_n"))
    enough = [F.min(F.when(F.col("_upto") * 100 >= round(q * 100) * F.col("_n"), F.col("_value"))).alias(f"{prefix}q{round(q * 100):02d}") for q in QUANTILES]
    quantiles = upto.join(sizes, "_key").groupBy("_key").agg(*enough)
    moments = rows.groupBy("_key").agg(F.avg("_value").alias(f"{prefix}mean"), F.max("_value").alias(f"{prefix}max"))
    both = moments.join(quantiles, "_key", "left")
    return both.select("_key.*", *both.columns[1:]) if keys else both.drop("_key")


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One summary row per key, or one in all. Quantiles are exact."""
    return distribution(df, value, keys)


def histogram_line(label: str, summary: str = "") -> Column:
    """The summary as one line of text."""
    parts = [F.lit(f"{label}: mean="), F.col(f"{summary}mean"), F.lit(" max="), F.col(f"{summary}max")]
    for q in QUANTILES:
        parts += [F.lit(f" q{q:.2f}="), F.col(f"{summary}q{round(q * 100):02d}")]
    return F.concat(*[p.cast("string") for p in parts])
