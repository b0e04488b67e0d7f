from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandloom.sources import fasta, simulate, text


@pytest.fixture()
def small_splits(spark):
    """Files read in splits of a few bytes, as a large file is in splits of many."""
    keys = {"spark.sql.files.maxPartitionBytes": "16b", "spark.sql.files.openCostInBytes": "0"}
    for key, v in keys.items():
        spark.conf.set(key, v)
    yield
    for key in keys:
        spark.conf.unset(key)


def test_fasta_records_across_splits(spark, small_splits, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one x>y\nACGT\nAC\n>two\nGG\n>>three\r\nTT\r\nA\r\n>four\n")
    (tmp_path / "b.fa").write_text(">only\nAAAA")
    rows = fasta.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa")], "dna").orderBy("file", "seq_idx").collect()
    assert [(r.seq_idx, r.description, r.seq) for r in rows] == [
        (0, "one x>y", "ACGTAC"), (1, "two", "GG"), (2, ">three", "TTA"), (3, "four", ""), (0, "only", "AAAA"),
    ]


def test_fasta_errors(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("AC\n>x\nAC\n")
    with pytest.raises(PySparkException):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa")).collect()
    (tmp_path / "odd.fa").write_text(">x\nAXC\n")
    with pytest.raises(PySparkException):
        fasta.read_fasta(spark, str(tmp_path / "odd.fa"), "dna").collect()
    assert fasta.read_fasta(spark, str(tmp_path / "odd.fa"), "dna", strict=False).first().seq is None


def test_parse_fasta_trims(spark):
    df = spark.createDataFrame([("\n >a b \n  AC \n\nGT\n> c\nTT ",)], "t string")
    rows = fasta.parse_fasta(df, "t", "dna").orderBy("seq_idx").collect()
    assert [(r.seq_idx, r.description, r.seq) for r in rows] == [(0, "a b", "ACGT"), (1, "c", "TT")]


def test_lines_words_symbols(spark, value, small_splits, tmp_path):
    (tmp_path / "l.txt").write_text(" a\n\nb b\nlast line here\n")
    rows = text.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_idx").collect()
    assert [(r.line_idx, r.line) for r in rows] == [(0, " a"), (1, ""), (2, "b b"), (3, "last line here")]
    assert value(text.split_lines(F.lit(" a \n\n b c\n"))) == ["a", "b c"]
    assert value(text.words(F.lit(" a  b\n"))) == ["a", "b"]
    assert value(text.symbols_of(F.lit(" AC\n"), "dna")) == ["A", "C"]
    (tmp_path / "s.txt").write_text("AC GT\n  TT\n")
    rows = text.read_sequence(spark, str(tmp_path / "s.txt"), "dna").orderBy("line_idx").collect()
    assert "".join(r.seq for r in rows) == "ACGTTT"


def test_writers(spark, tmp_path):
    whole = spark.createDataFrame([(1, "GG"), (0, "ACG")], "i bigint, s string")
    fasta.write_fasta(whole, "i", "s", str(tmp_path / "f"))
    back = fasta.read_fasta(spark, str(tmp_path / "f"), "dna").collect()
    assert sorted((r.description, r.seq) for r in back) == [("0:3", "ACG"), ("1:2", "GG")]
    pieces = spark.createDataFrame([(0, 0, "AC"), (0, 2, "GT"), (1, 0, "T")], "c int, p int, s string")
    fasta.write_fasta_pieces(pieces, "c", "p", "s", str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == [">0:4", "AC", "GT", ">1:1", "T"]
    edges = spark.createDataFrame([("a", "b", 3)], "s string, d string, w int")
    text.write_dot(edges, "s", "d", "w", str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ["digraph G {", '    "a" -> "b" [label="3"];', "}"]
    text.write_stats(spark.createDataFrame([(1, 2.5)], "n int, mean double"), ["n", "mean"], str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["n: 1", "mean: 2.5"]


def test_simulated_reads_are_of_the_genome(spark):
    blocks = simulate.random_genome(spark, 2500).orderBy("block").collect()
    genome = "".join(r.seq for r in blocks)
    assert len(genome) == 2500 and set(genome) == set("ACGT")
    df = spark.createDataFrame([(7, genome)], "g bigint, seq string")
    reads = simulate.simulate_reads(df, "g", "seq", 200, 2.5).collect()
    assert len(reads) == 32
    for r in reads:
        assert 0 <= r.start0 < 2300 and r.seq == genome[r.start0 : r.start0 + 200]
        assert r.description == f"{r.read}:{r.start0 + 1}:200"


def test_short_genomes_have_no_reads(spark):
    df = spark.createDataFrame([(1, ""), (2, "ACG"), (3, "ACGT")], "g bigint, seq string")
    reads = simulate.simulate_reads(df, "g", "seq", 4, 2.0).collect()
    assert {(r.g, r.start0, r.seq) for r in reads} == {(3, 0, "ACGT")}


def test_genomes_do_not_depend_on_partitions(spark):
    one = {r.block: r.seq for r in simulate.random_genome(spark, 3000).collect()}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert {r.block: r.seq for r in simulate.random_genome(spark, 3000).collect()} == one
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
