"""Line and word readers, statistics and graph writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import alphabet as al


def with_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of each file from 0 in file order; needs `file`, `_block` and `_mid`.

    Only one row per file split is ordered; the rows themselves are not shuffled for it
    unless the table of splits is too large to broadcast.
    """
    blocks = df.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return df.join(starts, ["file", "_block"]).withColumn(name, F.col("_mid") + F.col("_shift")).drop("_shift")


def scan(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """Records of text files, split at `separator`, with where they came from.

    Files are split for reading as usual, however large; a record is read by the task whose
    split it starts in.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Raw lines `(file, line_idx, line)`."""
    lines = with_ordinal(scan(spark, path), "line_idx")
    return lines.select("file", "line_idx", F.col("value").alias("line"))


def split_lines(s: Column) -> Column:
    """Array of the trimmed, non-empty lines of a string."""
    trimmed = F.transform(F.split(s, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def words(s: Column) -> Column:
    """Array of whitespace-separated words."""
    return F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 0)


def symbols_of(s: Column, alphabet: str, strict: bool = True) -> Column:
    """Characters of a string with its ends trimmed; whitespace inside is invalid."""
    return al.chars(al.parse(F.regexp_replace(s, r"^\s+|\s+$", ""), alphabet, strict))


def read_sequence(spark: SparkSession, path, alphabet: str, strict: bool = True) -> DataFrame:
    """Lines of one sequence with all whitespace dropped: `(file, line_idx, seq)`.

    The sequence stays in lines, so a chromosome does not have to fit one cell.
    """
    lines = read_lines(spark, path)
    bare = al.parse(F.regexp_replace("line", r"\s+", ""), alphabet, strict)
    return lines.select("file", "line_idx", bare.alias("seq"))


def write_ordered(df: DataFrame, order: list[str], value: str, path: str) -> None:
    """Write one string column as text, globally ordered over the part files."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.mode("overwrite").text(path))


def stats_lines(stats: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of statistics as `key: value` lines, numbered in the order of `keys`."""
    entries = F.array(*[F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in keys])
    return stats.select(*(by or []), F.posexplode(entries).alias("n", "value"))


def write_stats(stats: DataFrame, keys: list[str], path: str) -> None:
    write_ordered(stats_lines(stats, keys), ["n"], "value", path)


def dot_lines(edges: DataFrame, src: str, dst: str, label: str, directed: bool = True) -> DataFrame:
    """An edge table as the lines of a GraphViz file `(part, src, dst, value)`."""
    style = "" if directed else " dir=none"
    body = edges.select(
        F.lit(1).alias("part"),
        F.col(src).cast("string").alias("src"),
        F.col(dst).cast("string").alias("dst"),
        F.format_string(f'    "%s" -> "%s" [label="%s"{style}];', src, dst, F.col(label).cast("string")).alias("value"),
    )
    frame = edges.sparkSession.createDataFrame(
        [(0, "", "", "digraph G {"), (2, "", "", "}")], "part int, src string, dst string, value string"
    )
    return frame.union(body)


def write_dot(edges: DataFrame, src: str, dst: str, label: str, path: str, directed: bool = True) -> None:
    write_ordered(dot_lines(edges, src, dst, label, directed), ["part", "src", "dst", "value"], "value", path)
