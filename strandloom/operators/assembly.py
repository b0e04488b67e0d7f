"""Greedy superstring assembly: always merge the pair with the longest overlap.

The pairs are never listed. Each overlap of n characters is a string that is both a suffix
and a prefix; these strings are hubs, a read being a tail at each of its suffixes and a head
at each of its prefixes. That is linear in the reads' length, also where many reads share
one end. All merges that the greedy order is bound to make are found in parallel per round:

* a path's best tail hub and best head hub are the longest with another path at the other
  side; a merge must be the best for both of its paths;
* it must not be the lighter closing edge of a later cycle: the best overlap into its first
  path or out of its second must not be longer than its own;
* of merges that touch the same path, a random one goes first.

Merges of the longest overlap always qualify, so the rounds end. Between equal overlaps the
greedy order is free; here it is the order of the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.strings import kmers
from strandloom.plans.ordering import ordered_concat
from strandloom.plans.session import checkpointed

_HUB_SHARE = 4096  # tails or heads of one hub that are matched within one group


@dataclass
class Assembly:
    """Where the reads ended up: `layout` has `(read, contig, offset, length, overlap)`."""

    layout: DataFrame
    reads: DataFrame

    def pieces(self) -> DataFrame:
        """What each read adds to its contig: `(contig, pos, piece)`, in order of `pos`."""
        new = F.substring(F.col("seq"), (F.col("overlap") + 1).cast("int"), F.length("seq"))
        return (
            self.layout.join(self.reads, "read")
            .select("contig", (F.col("offset") + F.col("overlap")).alias("pos"), new.alias("piece"))
            .where(F.length("piece") > 0)
        )

    def contigs(self) -> DataFrame:
        """Contigs as whole strings `(contig, seq)`."""
        return ordered_concat(self.pieces(), ["contig"], "pos", "piece", "seq")


def _hub(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _hubs(reads: DataFrame, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """Tail and head hubs `(read, n, hub)` that have someone at the other side.

    Long strings are not shuffled: positions are first reduced to those whose first
    `min_overlap` characters start some read, by a hash of 8 bytes.
    """
    long_enough = reads.where(F.length("seq") >= min_overlap)
    starts = long_enough.select("read", F.xxhash64(F.left("seq", F.lit(min_overlap))).alias("seed"))
    places = long_enough.select(
        "read", F.length("seq").alias("len"), F.posexplode(kmers(F.col("seq"), min_overlap)).alias("p", "kmer")
    ).select("read", (F.col("len") - F.col("p")).alias("n"), F.xxhash64("kmer").alias("seed"))
    ends = checkpointed(places.join(starts.select("seed").distinct(), "seed", "left_semi"))
    tails = ends.join(reads, "read").select("read", "n", _hub(F.right("seq", F.col("n"))).alias("hub"))
    # A read is a head only at lengths for which some tail has its seed.
    lengths = starts.join(ends.select("seed", "n").distinct(), "seed").select("read", "n")
    heads = (
        lengths.join(reads, "read")
        .where(F.col("n") <= F.length("seq"))
        .select("read", "n", _hub(F.left("seq", F.col("n"))).alias("hub"))
    )
    heads = checkpointed(heads)
    tails = checkpointed(tails.join(heads.select("hub").distinct(), "hub", "left_semi"))
    heads = checkpointed(heads.join(tails.select("hub").distinct(), "hub", "left_semi"))
    return tails, heads


def _reachable(side: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one side whose hub has a path other than their own at the other side, with the
    number of rows there and the path's best overlap."""
    facing = other.groupBy("hub").agg(
        F.min("path").alias("_lo"), F.max("path").alias("_hi"), F.count("*").alias("facing")
    )
    met = side.join(facing, "hub").where("_lo <> _hi OR _lo <> path").drop("_lo", "_hi")
    # A path has one row per suffix length, so this window is as small as one read.
    return met.withColumn("best", F.max("n").over(Window.partitionBy("path")))


def _matches(tails: DataFrame, heads: DataFrame, salt: int) -> DataFrame:
    """Merges `(src, dst, n)` that the greedy order must make and that touch no path twice."""
    into = heads.groupBy("path").agg(F.max("n").alias("into"))
    out_of = tails.groupBy("path").agg(F.max("n").alias("out_of"))
    top_tails = tails.where("n = best").join(into, "path", "left")
    top_heads = heads.where("n = best").join(out_of, "path", "left")
    # Large hubs are matched in random shares; both sides must split a hub alike.
    sizes = top_tails.groupBy("hub").agg(F.count("*").alias("_t")).join(
        top_heads.groupBy("hub").agg(F.count("*").alias("_h")), "hub"
    )
    shares = sizes.select("hub", F.ceil(F.greatest("_t", "_h") / _HUB_SHARE).alias("_shares"))

    def ranked(side: DataFrame) -> DataFrame:
        draw = F.xxhash64("path", F.lit(salt))
        split = side.join(shares, "hub").withColumn("_share", F.pmod(draw, F.col("_shares")))
        order = Window.partitionBy("hub", "_share").orderBy(F.xxhash64(draw), "path")
        return split.withColumn("_rank", F.row_number().over(order))

    pairs = (
        ranked(top_tails)
        .select("hub", "_share", "_rank", F.col("path").alias("src"), "n", "into")
        .join(ranked(top_heads).select("hub", "_share", "_rank", F.col("path").alias("dst"), "out_of"), ["hub", "_share", "_rank"])
        .where("src <> dst AND (coalesce(into, 0) <= n OR coalesce(out_of, 0) <= n)")
        .select("src", "dst", "n", F.xxhash64("src", "dst", F.lit(salt)).alias("turn"))
    )
    pairs = checkpointed(pairs)
    before = pairs.select(F.col("dst").alias("src"), F.col("turn").alias("_before"))
    after = pairs.select(F.col("src").alias("dst"), F.col("turn").alias("_after"))
    return (
        pairs.join(before, "src", "left")
        .join(after, "dst", "left")
        .where("(_before IS NULL OR turn < _before) AND (_after IS NULL OR turn < _after)")
        .select("src", "dst", "n")
    )


def assemble(df: DataFrame, read: str, seq: str, min_overlap: int) -> Assembly:
    """Assemble reads (unique `read`, string `seq`) into contigs named by their first read.

    Identical reads overlap entirely and would be merged first, so one of them stands for all.
    """
    # The longest possible overlaps come first; none is shorter than one character.
    min_overlap = max(1, min_overlap)
    named = df.select(F.col(read).alias("read"), F.col(seq).alias("seq"))
    unique = checkpointed(named.groupBy("seq").agg(F.min("read").alias("read")))
    tails, heads = _hubs(unique, min_overlap)
    paths = unique.select(
        F.col("read").alias("path"), F.col("read").alias("head"), F.col("read").alias("tail"),
        F.length("seq").cast("bigint").alias("length"),
    )
    layout = unique.select(
        "read", F.col("read").alias("contig"), F.lit(0).cast("bigint").alias("offset"),
        F.length("seq").cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("overlap"),
    )
    paths, layout = checkpointed(paths), checkpointed(layout)
    salt = 0
    while True:
        at_tail = tails.join(paths.select("path", F.col("tail").alias("read")), "read")
        at_head = heads.join(paths.select("path", F.col("head").alias("read")), "read")
        met_tails = checkpointed(_reachable(at_tail, at_head))
        met_heads = checkpointed(_reachable(at_head, at_tail))
        if met_tails.isEmpty() or met_heads.isEmpty():
            break
        # What is out of reach now stays so: paths only grow and ends only get used up.
        tails, heads = met_tails.select("read", "n", "hub"), met_heads.select("read", "n", "hub")
        chosen = _matches(met_tails, met_heads, salt)
        gone = paths.select(F.col("path").alias("dst"), F.col("tail").alias("_tail"), F.col("length").alias("_add"))
        merges = (
            chosen.join(gone, "dst")
            .join(paths.select(F.col("path").alias("src"), F.col("length").alias("_length")), "src")
            .select("src", "dst", "n", "_tail", "_add", (F.col("_length") - F.col("n")).alias("shift"))
        )
        merges = checkpointed(merges)
        grown = merges.select(F.col("src").alias("path"), "_tail", "_add", "n")
        paths = checkpointed(
            paths.join(merges.select(F.col("dst").alias("path")), "path", "left_anti")
            .join(grown, "path", "left")
            .select(
                "path",
                "head",
                F.coalesce("_tail", "tail").alias("tail"),
                (F.col("length") + F.coalesce(F.col("_add") - F.col("n"), F.lit(0))).alias("length"),
            )
        )
        moved = merges.select(F.col("dst").alias("contig"), F.col("src").alias("_to"), "shift", F.col("n").alias("_n"))
        layout = checkpointed(
            layout.join(moved, "contig", "left").select(
                "read",
                F.coalesce("_to", "contig").alias("contig"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
                "length",
                # A path is named after its first read: that one now overlaps the read before it.
                F.when(F.col("read") == F.col("contig"), F.coalesce(F.col("_n").cast("bigint"), F.col("overlap")))
                .otherwise(F.col("overlap"))
                .alias("overlap"),
            )
        )
        salt += 1
    return Assembly(layout, unique.select("read", "seq"))


def place_copies(assembly: Assembly, df: DataFrame, read: str, seq: str) -> DataFrame:
    """The layout of all reads, with every copy placed where its representative is."""
    hashed = df.select(F.col(read).alias("read"), _hub(F.col(seq)).alias("_h"))
    standing = assembly.reads.select(F.col("read").alias("_r"), _hub(F.col("seq")).alias("_h"))
    placed = assembly.layout.withColumnRenamed("read", "_r").drop("overlap")
    return hashed.join(standing, "_h").join(placed, "_r").drop("_h", "_r")
