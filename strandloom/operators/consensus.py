"""Base profile and consensus of groups of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.constants import ALPHABETS
from strandloom.functions.alphabet import chars
from strandloom.plans.ordering import ordered_concat


def profile(df: DataFrame, keys: Sequence[str], index: str, seq: str) -> DataFrame:
    """Counts of A, C, G, T per position, as wide as the first record of the group.

    Shorter records count towards fewer positions, longer ones are cut.
    """
    widths = df.groupBy(*keys).agg(F.min_by(F.length(seq), F.col(index)).alias("_width"))
    cut = df.join(widths, list(keys)).select(*keys, F.left(F.col(seq), F.col("_width")).alias("_seq"))
    cells = cut.select(*keys, F.posexplode(chars(F.col("_seq"))).alias("pos0", "_base"))
    counts = [F.count_if(F.col("_base") == b).alias(f"n_{b.lower()}") for b in ALPHABETS["dna"]]
    return cells.groupBy(*keys, "pos0").agg(*counts)


def consensus(df: DataFrame, keys: Sequence[str], index: str, seq: str) -> DataFrame:
    """Most frequent base per position as one string per group; ties go to A, C, G, T in this order."""
    counts = {b: F.col(f"n_{b.lower()}") for b in ALPHABETS["dna"]}
    top = F.greatest(*counts.values())
    pick = None
    for base, count in counts.items():
        pick = F.when(count == top, base) if pick is None else pick.when(count == top, base)
    letters = profile(df, keys, index, seq).withColumn("_base", pick)
    return ordered_concat(letters, keys, "pos0", "_base", "consensus")
