"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "strandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `master` only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only for local runs."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and, unlike a checkpointed RDD, gives the
    optimizer true sizes: in a loop, the estimates of joins on joins grow beyond any use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(table: DataFrame) -> None:
    """Delete what `checkpointed` wrote. For a loop, once the next round's table is written: from
    then on nothing is read from the old one, not even to make up for a lost executor."""
    path = getattr(table, "_written_to", None)
    if path:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffled(df: DataFrame) -> DataFrame:
    """Have `df` shuffled, not broadcast, where it is joined. For tables that grow with the input: what
    `explode` makes of a row counts as one row in the optimizer's sizes, and files count as compressed."""
    return df.hint("merge")


def released(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which Spark removes the shuffle files of finished jobs. Between
    large steps of one job flow, as by itself that happens rarely, and all files stay until then."""
    gc.collect()
    spark._jvm.System.gc()
