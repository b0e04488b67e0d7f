"""Sequences derived from the given tables, and the SQL that derives the same.

Nucleotides stand for the hexadecimal digits of a key's digest (`part`) or of the bytes of a
whole text (`documents`, `conversations`): copies of a text stay copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS = "ACGT" * 4


#: Number of partitions that tables of texts are dealt to, by key, when read. Unset by default: then they
#: come in the pieces that `spark.sql.files` settings cut them into, which are never less than a row
#: group. Set it for files of few row groups.
TEXT_PARTITIONS = "spark.strandloom.textPartitions"
_TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; see `TEXT_PARTITIONS`."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    dealt = spark.conf.get(TEXT_PARTITIONS, None)
    return rows.repartition(int(dealt), *_TEXT_KEYS[name]) if dealt and name in _TEXT_KEYS else rows


def part_keys(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Keys of `part` (and further columns), dealt to as many partitions as a shuffle has: what is
    derived from a key is heavy, and an explicit number is not coalesced."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "part").select("p_partkey", *columns).repartition(n, "p_partkey")


def key_dna(key: str, first: int = 0, blocks: int = 1) -> Column:
    """32 bases per block from the digest of `key:block`."""
    parts = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{i}"))) for i in range(first, first + blocks)]
    return F.translate(F.concat(*parts), "0123456789abcdef", _LETTERS)


def text_dna(text: str) -> Column:
    return F.translate(F.hex(text), "0123456789ABCDEF", _LETTERS)


def key_dna_sql(key: str, first: int = 0, blocks: int = 1) -> str:
    parts = " || ".join(f"md5(CAST({key} AS VARCHAR) || ':{i}')" for i in range(first, first + blocks))
    return f"translate({parts}, '0123456789abcdef', '{_LETTERS}')"


def text_dna_sql(text: str) -> str:
    return f"translate(hex({text}), '0123456789ABCDEF', '{_LETTERS}')"


def parts(spark: SparkSession, sf_dir: str, blocks: int = 1) -> DataFrame:
    """`(seq_id, seq)` with 32 bases per block for every part."""
    return part_keys(spark, sf_dir).select(F.col("p_partkey").alias("seq_id"), key_dna("p_partkey", 0, blocks).alias("seq"))


def parts_sql(blocks: int = 1) -> str:
    return f"(SELECT p_partkey AS seq_id, {key_dna_sql('p_partkey', 0, blocks)} AS seq FROM part)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(seq_id, seq)` with two bases per byte of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), text_dna("text").alias("seq"))


def documents_sql() -> str:
    return f"(SELECT doc_id AS seq_id, {text_dna_sql('text')} AS seq FROM documents)"
