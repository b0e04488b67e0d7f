"""A corpus pipeline over `documents`: each stage applies one operator to all that the stage before kept.

Rows that share a `doc_id` are one document; a row without one is judged by itself where rows are
judged, and is never dropped for being like another. Tables may be empty, and other columns than
those of `documents` may be there: they are not carried on.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import bpe, linededup, mixing, neardup, quality
from strandloom.plans.session import checkpointed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or their language's perplexity band reject."""
    # Whole rows go to Python and back when the result is written, after this function: some MB at a time.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, str(min(1000, int(spark.conf.get(batch)))))
    judged = quality.judge(docs.select(*COLUMNS), "text", "lang")
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier one, however short, and documents of which no line of words is left."""
    left = linededup.without_lines(docs.select(*COLUMNS), "doc_id", "text", least=1)
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of every group of near-duplicates, and each text of it once."""
    found = neardup.components(docs, "doc_id", "text")
    rows = found.groupBy(F.col("doc_id").alias("_kept")).agg(F.max("kept").alias("_any"), F.count("*").alias("_rows")).where("_any")
    rows = checkpointed(rows)
    repeated = (F.col("_rows") > 1) & F.col("_kept").isNotNull()
    same = F.col("doc_id").eqNullSafe(F.col("_kept"))
    once = docs.select(*COLUMNS).join(rows.where(~repeated), same, "left_semi")
    ids = checkpointed(rows.where(repeated))
    if ids.isEmpty():
        return once
    several = docs.select(*COLUMNS).join(ids, same, "left_semi")
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("_rest")
    folded = several.groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "_rest.*")
    return once.unionByName(folded)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that every source has its share of words.

    Rows of one id, source and text can stand for each other: they have the copies planned for all of
    them together, each its own."""
    rows = docs.select(*COLUMNS, F.struct("doc_id", "source", F.xxhash64("text").alias("hash")).alias("_id"))
    mixed = mixing.mix(rows, "_id", "text", "source").where("size > 0")
    each = (F.col("taken") / F.col("size")).cast("int")
    groups = mixed.groupBy("_id").agg(F.min(each).alias("_low"), F.max(each).alias("_high"), F.count("*").alias("_n"), F.sum(each).alias("_sum"))
    plan = groups.where("_sum > 0").select("_low", "_high", (F.col("_sum") - F.col("_low") * F.col("_n")).alias("_more"), F.col("_id").alias("_of"))
    plan = checkpointed(plan)
    same = F.col("_id").eqNullSafe(F.col("_of"))
    both = rows.join(plan.where("_low = _high"), same).withColumn("_times", F.col("_low"))
    uneven = checkpointed(plan.where("_low < _high"))
    if not uneven.isEmpty():
        place = F.row_number().over(Window.partitionBy("_id").orderBy("lang", "n_chars"))
        times = F.when(place <= F.col("_more"), F.col("_high")).otherwise(F.col("_low"))
        both = both.unionByName(rows.join(uneven, same).withColumn("_times", times)).where("_times > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left, and return digests of both."""
    return bpe.digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("bpe round trip", bpe_round_trip),
]

#: Perplexity, sketches and tokenization have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
