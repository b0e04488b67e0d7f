"""Random genomes and reads, seeded so that a lost task is redone with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.ordering import ordered_concat
from strandloom.plans.session import shuffled


def drawn(seed: int, *of: Column) -> Column:
    """A number from 0 to 2^60 - 1 from the digest of the seed and what it is drawn for, so that it
    neither depends on how rows are dealt to tasks nor on the engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in of))), 1, 15), 16, 10).cast("bigint")


def random_genomes(df: DataFrame, key: str, length: str, gc: float = 0.4, seed: int = 1, width: int = 1000) -> DataFrame:
    """A genome of `length` bases for every row, as blocks `(key, block, seq)` of `width` bases. A base
    is G or C with chance `gc`."""
    last = F.floor((F.col(length) - 1) / width)
    blocks = df.where(F.col(length) > 0).select(key, length, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    until = F.least((F.col("block") + 1) * width, F.col(length)) - 1
    bases = blocks.select(key, "block", F.explode(F.sequence(F.col("block") * width, until)).alias("pos"))
    n = drawn(seed, F.col(key), F.col("pos"))
    strong = F.shiftright(n, 30) < round(gc * (1 << 30))
    even = n.bitwiseAND(F.lit(1)) == 0
    base = F.when(strong, F.when(even, "C").otherwise("G")).otherwise(F.when(even, "A").otherwise("T"))
    return ordered_concat(bases.withColumn("base", base), [key, "block"], "pos", "base", "seq", width)


def random_genome(spark: SparkSession, length: int, gc: float = 0.4, seed: int = 1, width: int = 1000) -> DataFrame:
    """One genome as blocks `(block, seq)`."""
    one = spark.range(1).select("id", F.lit(length).cast("bigint").alias("length"))
    return random_genomes(one, "id", "length", gc, seed, width).select("block", "seq")


def genome_blocks(genomes: DataFrame, key: str, seq: str, width: int = 1000) -> DataFrame:
    """Cut sequences into blocks `(key, block, piece)`."""
    cut = F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))
    return genomes.select(key, F.posexplode(cut).alias("block", "piece"))


def read_positions(genomes: DataFrame, key: str, length: str, read_len: int, depth: float, seed: int = 1) -> DataFrame:
    """`ceil(depth * length / read_len)` reads per genome, starts uniform in `[0, length - read_len)`.

    A genome of the length of a read has all its reads at 0, a shorter one has none. Reads are numbered by
    blocks, so no task holds the numbers of a whole genome.
    """
    n = F.ceil(F.lit(depth) * F.col(length) / read_len)
    long = genomes.where((F.col(length) >= read_len) & (n > 0)).withColumn("_n", n)
    blocks = long.select(key, length, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / 4096))).alias("_b"))
    last = F.least((F.col("_b") + 1) * 4096, F.col("_n")) - 1
    numbered = blocks.select(key, length, F.explode(F.sequence(F.col("_b") * 4096, last)).alias("read"))
    room = F.greatest(F.col(length) - read_len, F.lit(1))
    return numbered.select(key, "read", (drawn(seed, F.col(key), F.col("read")) % room).alias("start0"), F.lit(read_len).cast("bigint").alias("len"))


def simulate_reads(
    genomes: DataFrame, key: str, seq: str, read_len: int, depth: float, seed: int = 1, width: int = 1000
) -> DataFrame:
    """Reads `(key, read, start0, len, description, seq)` with the header `read:start1:len`.

    Reads meet the genome through the one to few blocks they span, an equi-join, so neither
    side is broadcast and a read never carries its genome.
    """
    sizes = genomes.select(key, F.length(seq).cast("bigint").alias("_length"))
    reads = read_positions(sizes, key, "_length", read_len, depth, seed)
    first, last = F.floor(F.col("start0") / width), F.floor((F.col("start0") + read_len - 1) / width)
    spans = reads.withColumn("block", F.explode(F.sequence(first, last)))
    offset = F.col("block") * width
    lo = F.greatest(F.col("start0"), offset) - offset
    hi = F.least(F.col("start0") + read_len, offset + width) - offset
    pieces = spans.join(shuffled(genome_blocks(genomes, key, seq, width)), [key, "block"]).withColumn(
        "_cut", F.substring(F.col("piece"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    )
    cut = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "_cut"))), lambda p: p["_cut"]), ""
    )
    return (
        pieces.groupBy(key, "read", "start0", "len")
        .agg(cut.alias("seq"))
        .withColumn("description", F.concat_ws(":", "read", F.col("start0") + 1, "len"))
    )
