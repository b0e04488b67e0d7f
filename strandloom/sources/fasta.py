"""FASTA source and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alphabet as al
from strandloom.sources.text import scan, with_ordinal, write_ordered


def _header(record: Column) -> Column:
    return F.regexp_extract(record, r"\A([^\r\n]*)", 1)


def _body(record: Column, trim: bool) -> Column:
    rest = F.regexp_replace(record, r"\A[^\r\n]*\r?\n?", "")
    joined = F.regexp_replace(rest, r"[ \t]*\r?\n[ \t]*" if trim else r"\r?\n", "")
    return F.regexp_replace(joined, r"\A\s+|\s+\z" if trim else r"\r\z", "")


def _typed(seq: Column, alphabet: str | None, strict: bool) -> Column:
    return al.parse(seq, alphabet, strict) if alphabet else seq


def read_fasta(
    spark: SparkSession, path, alphabet: str | None = None, strict: bool = True, trim: bool = False
) -> DataFrame:
    """Records `(file, seq_idx, description, seq)` of FASTA files.

    Records are separated by a newline and `>`, so one large file is read by many tasks. The
    first line of a file must be a header.
    """
    records = with_ordinal(scan(spark, path, "\n>"), "seq_idx")
    first = F.col("seq_idx") == 0
    wrong = F.raise_error(F.concat(F.lit("no header on the first line of "), F.col("file"))).cast("string")
    text = (
        F.when(first & ~F.startswith("value", F.lit(">")), wrong)
        .when(first, F.substring(F.col("value"), F.lit(2), F.length("value")))
        .otherwise(F.col("value"))
    )
    records = records.withColumn("value", text)
    header = F.trim(_header(F.col("value"))) if trim else _header(F.col("value"))
    return records.select(
        "file",
        "seq_idx",
        header.alias("description"),
        _typed(_body(F.col("value"), trim), alphabet, strict).alias("seq"),
    )


def parse_fasta(df: DataFrame, text: str, alphabet: str | None = None, strict: bool = True) -> DataFrame:
    """FASTA held in a string column, lines trimmed and blank ones dropped.

    Adds `seq_idx`, `description` and `seq`; one row per record.
    """
    parts = F.split(F.col(text), r"(?:\A|\n)[ \t]*>")
    lead = F.element_at(parts, 1)
    wrong = F.raise_error(F.lit("text before the first header")).cast("array<string>")
    records = F.when(F.length(F.trim(F.regexp_replace(lead, r"\s", ""))) > 0, wrong).otherwise(
        F.slice(parts, F.lit(2), F.size(parts))
    )
    return (
        df.select("*", F.posexplode(records).alias("seq_idx", "_record"))
        .withColumn("seq_idx", F.col("seq_idx").cast("bigint"))
        .withColumn("description", F.trim(_header(F.col("_record"))))
        .withColumn("seq", _typed(_body(F.col("_record"), True), alphabet, strict))
        .drop("_record")
    )


def fasta_text(df: DataFrame, index: str, seq: str) -> Column:
    """A record as text: `>{index}:{length}` and the sequence."""
    head = F.concat(F.lit(">"), F.col(index).cast("string"), F.lit(":"), F.length(seq).cast("string"))
    return F.concat(head, F.lit("\n"), F.col(seq))


def write_fasta(df: DataFrame, index: str, seq: str, path: str) -> None:
    """Whole sequences, one record per row, ordered by index."""
    write_ordered(df.select(index, fasta_text(df, index, seq).alias("value")), [index], "value", path)


def write_fasta_pieces(pieces: DataFrame, index: str, pos: str, piece: str, path: str) -> None:
    """Sequences held as pieces `(index, pos, piece)`, one line per piece.

    Only lengths are grouped, so a sequence of any length passes through no single task.
    """
    heads = (
        pieces.groupBy(index)
        .agg(F.sum(F.length(piece)).alias("_length"))
        .select(
            index,
            F.lit(-1).cast("bigint").alias(pos),
            F.concat(
                F.lit(">"), F.col(index).cast("string"), F.lit(":"), F.col("_length").cast("string")
            ).alias("value"),
        )
    )
    lines = pieces.select(index, F.col(pos).cast("bigint").alias(pos), F.col(piece).alias("value"))
    write_ordered(heads.union(lines), [index, pos], "value", path)
