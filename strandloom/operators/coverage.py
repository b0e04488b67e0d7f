"""Coverage depth, coverage statistics and islands of reads on contigs.

Every interval is cut at the borders of fixed blocks, so each block of a contig is summed
on its own: no running sum crosses a block, however many reads one contig holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sweep(reads: DataFrame, contig: str, start: Column, end: Column, block: int) -> DataFrame:
    """Depth change points per block: `(contig, pos0, next0, depth, before)`.

    `before` is the depth of the base to the left, known as zero or not zero.
    """
    spans = reads.select(contig, start.alias("s"), end.alias("e")).where("s < e")
    # The last block may only be touched at its border: that tells it its left neighbour is covered.
    cut = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor(F.col("e") / block))))
    lo = F.greatest(F.col("s"), F.col("b") * block)
    hi = F.least(F.col("e"), (F.col("b") + 1) * block)
    deltas = cut.select(
        contig,
        "b",
        (F.col("s") < F.col("b") * block).alias("from_left"),
        F.explode(
            F.array(
                F.struct(lo.alias("pos0"), F.lit(1).alias("delta")),
                F.struct(hi.alias("pos0"), F.lit(-1).alias("delta")),
            )
        ).alias("d"),
    ).select(contig, "b", "d.pos0", "d.delta", "from_left")
    # At most block + 1 rows per block are left after this, whatever the number of reads.
    points = deltas.groupBy(contig, "b", "pos0").agg(
        F.sum("delta").alias("delta"), F.max("from_left").alias("from_left")
    )
    order = Window.partitionBy(contig, "b").orderBy("pos0")
    depth = F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))
    border = F.col("pos0") == F.col("b") * block
    return (
        points.withColumn("depth", depth)
        .withColumn("next0", F.coalesce(F.lead("pos0").over(order), (F.col("b") + 1) * block))
        .withColumn(
            "before",
            F.when(border, F.when(F.col("from_left"), 1).otherwise(0)).otherwise(F.col("depth") - F.col("delta")),
        )
        .where("pos0 < next0")
        .select(contig, "pos0", "next0", "depth", "before")
    )


def coverage_runs(
    reads: DataFrame, contig: str = "contig", start: str = "start0", length: str = "len", block: int = 1 << 16
) -> DataFrame:
    """Covered stretches `(contig, pos0, next0, depth)` of equal depth, half-open, depth > 0."""
    end = F.col(start) + F.col(length)
    runs = _sweep(reads, contig, F.col(start).cast("bigint"), end.cast("bigint"), block)
    return runs.where("depth > 0").drop("before")


def coverage(
    reads: DataFrame, contig: str = "contig", start: str = "start0", length: str = "len", block: int = 1 << 16
) -> DataFrame:
    """Depth of every covered base `(contig, pos0, depth)`."""
    runs = coverage_runs(reads, contig, start, length, block)
    return runs.select(contig, F.explode(F.sequence(F.col("pos0"), F.col("next0") - 1)).alias("pos0"), "depth")


def islands(
    reads: DataFrame,
    contig: str = "contig",
    start: str = "start0",
    length: str = "len",
    theta: float = 0.0,
    block: int = 1 << 16,
) -> DataFrame:
    """Starts of the covered stretches when every read ends `ceil(len * theta)` bases earlier."""
    end = F.col(start) + F.col(length) - F.ceil(F.col(length) * theta)
    runs = _sweep(reads, contig, F.col(start).cast("bigint"), end.cast("bigint"), block)
    return runs.where("depth > 0 AND before = 0").select(contig, "pos0")


def coverage_stats(
    reads: DataFrame,
    contigs: DataFrame,
    contig: str = "contig",
    start: str = "start0",
    length: str = "len",
    size: str = "genome_length",
    theta: float = 0.1,
    block: int = 1 << 16,
) -> DataFrame:
    """Per contig: number of reads, bases covered, nominal mean depth, variance, islands.

    The mean is read bases over contig length, the variance is taken around it over all
    bases, uncovered ones included, and divided by length - 1.
    """
    sizes = contigs.select(contig, F.col(size).cast("bigint").alias("genome_length"))
    read_sums = reads.groupBy(contig).agg(F.count("*").alias("num_reads"), F.sum(length).alias("_bases"))
    width = F.col("next0") - F.col("pos0")
    sums = (
        coverage_runs(reads, contig, start, length, block)
        .groupBy(contig)
        .agg(
            F.sum(width).alias("bases_covered"),
            F.sum(width * F.col("depth")).alias("_d1"),
            F.sum(width * F.col("depth") * F.col("depth")).alias("_d2"),
        )
    )
    counts = islands(reads, contig, start, length, theta, block).groupBy(contig).agg(F.count("*").alias("num_islands"))
    joined = sizes.join(read_sums, contig, "left").join(sums, contig, "left").join(counts, contig, "left").na.fill(0)
    mean = F.col("_bases") / F.col("genome_length")
    squares = F.col("_d2") - 2 * mean * F.col("_d1") + mean * mean * F.col("genome_length")
    return joined.select(
        contig,
        "genome_length",
        "num_reads",
        "bases_covered",
        mean.alias("avg_depth"),
        F.try_divide(squares, F.col("genome_length") - 1).alias("var_depth"),
        "num_islands",
    )
