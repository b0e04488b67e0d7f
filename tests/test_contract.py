"""Queries against their SQL on DuckDB, and the shape of the driver's contract."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.plans import bridges
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# One quick query of every kind; tools/check.py runs all of them.
NAMES = [
    "validate", "fasta_roundtrip", "gc_argmax", "translate", "palindromes", "consensus", "overlap_positions", "motif_search",
    "passage_search", "maximal_prefix", "suffix_array", "longest_repeat", "lcs_pair", "trie_edges", "global_alignment_weighted",
    "fitting_alignment", "nearest_residue", "spectrum_edges", "binomial", "cross", "overlap_degrees", "coverage_stats", "histogram",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tables_come_in_as_many_partitions_as_asked_for(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bridges.parts(spark, SF).rdd.getNumPartitions() == n
    sizes = bridges.parts(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == n and bridges.documents(spark, SF).rdd.getNumPartitions() < 7
    spark.conf.set(bridges.TEXT_PARTITIONS, "7")
    try:
        assert bridges.documents(spark, SF).rdd.getNumPartitions() == 7
        assert bridges.table(spark, SF, "conversations").rdd.getNumPartitions() == 7
    finally:
        spark.conf.unset(bridges.TEXT_PARTITIONS)


def test_entry(spark):
    assert entry.entry(spark).columns == ["seq_id", "gc_e6"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    answer = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in answer.description], answer.fetchall())
