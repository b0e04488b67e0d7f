"""Ready-made analyses of input files: each gives the lines of its report.

A program takes a session and a path and returns rows `(n, value)`, to be read in the order of
`n`. Run one with `python -m strandloom <program> <input> [<output folder>]`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.constants import ALPHABETS, GLYCOSYLATION_MOTIF
from strandloom.functions import genetics, mass, polymer, strings
from strandloom.operators import assembly, components, consensus, coverage, overlap, repeats, spectrum, trie
from strandloom.plans.ordering import dense_index, ordered_concat
from strandloom.sources import fasta, simulate, text

PROGRAMS: dict[str, Callable[..., DataFrame]] = {}


def program(name: str):
    def add(run):
        PROGRAMS[name] = run
        return run

    return add


def _line(df: DataFrame, *values: Column) -> DataFrame:
    """One row per value, in the given order."""
    lines = F.array(*[v.cast("string") for v in values])
    return df.select(F.posexplode(lines).alias("n", "value")).select(F.col("n").cast("bigint").alias("n"), "value")


def _parameters(spark: SparkSession, path: str, cast: str = "double") -> tuple[DataFrame, Callable[[int], Column]]:
    """A file of a few numbers as one row."""
    df = spark.read.text(path, wholetext=True).select(text.words(F.col("value")).alias("w"))
    return df, lambda i: F.element_at("w", i + 1).cast(cast)


def _sequence(spark: SparkSession, path: str, alphabet: str) -> DataFrame:
    lines = text.read_sequence(spark, path, alphabet)
    return ordered_concat(lines, ["file"], "line_idx", "seq", "seq")


def _two_lines(spark: SparkSession, path: str) -> DataFrame:
    first = [F.max(F.when(F.col("line_idx") == i, F.col("line"))).alias(c) for i, c in enumerate("ab")]
    return text.read_lines(spark, path).where("line_idx < 2").agg(*first)


def _masses(spark: SparkSession, path: str) -> DataFrame:
    lines = text.read_lines(spark, path).where(F.trim("line") != "")
    return lines.select("file", "line_idx", mass.to_e5(F.col("line").cast("decimal(20,9)")).alias("mass"))


def _pair_of_words(i: int) -> Column:
    return F.get(text.words(F.col("line")), F.lit(i))


@program("hamming-distance")
def hamming_distance(spark, path):
    return _line(_two_lines(spark, path), strings.hamming(F.col("a"), F.col("b")))


@program("substring-positions")
def substring_positions(spark, path):
    at = F.transform(strings.positions(F.col("a"), F.col("b")), lambda p: (p + 1).cast("string"))
    return _line(_two_lines(spark, path), F.array_join(at, " "))


@program("random-genome")
def random_genome(spark, path=None, length: int = 10_000, gc: float = 0.4, seed: int = 1):
    blocks = simulate.random_genome(spark, length, gc, seed)
    head = spark.createDataFrame([(-1, ">generated dna")], "n bigint, value string")
    return head.union(blocks.select(F.col("block").alias("n"), F.col("seq").alias("value")))


def _first_genome(spark, path):
    return fasta.read_fasta(spark, path, "dna").where("seq_idx = 0").select("seq_idx", "seq")


@program("simulate-reads")
def simulate_reads(spark, path, read_len: int = 200, depth: float = 2.5, seed: int = 1):
    reads = simulate.simulate_reads(_first_genome(spark, path), "seq_idx", "seq", read_len, depth, seed)
    lines = F.array(F.concat(F.lit(">"), "description"), "seq")
    rows = reads.select("read", F.posexplode(lines).alias("i", "value"))
    return rows.select((F.col("read") * 2 + F.col("i")).alias("n"), "value")


@program("read-statistics")
def read_statistics(spark, path, genome_length: int = 10_000, theta: float = 0.1):
    """Coverage of reads whose headers say `read:start1:length`."""
    part = F.split("description", ":")
    reads = fasta.read_fasta(spark, path, "dna").select(
        F.lit(0).alias("contig"), (F.get(part, F.lit(1)).cast("bigint") - 1).alias("start0"), F.get(part, F.lit(2)).cast("bigint").alias("len")
    )
    contigs = spark.createDataFrame([(0, genome_length)], "contig int, genome_length bigint")
    keys = ["genome_length", "num_reads", "bases_covered", "avg_depth", "var_depth", "num_islands"]
    return text.stats_lines(coverage.coverage_stats(reads, contigs, theta=theta), keys)


@program("assemble")
def assemble(spark, path, min_overlap: int = 20):
    built = assembly.assemble(fasta.read_fasta(spark, path, "dna"), "seq_idx", "seq", min_overlap)
    numbered = dense_index(built.contigs(), ["contig"], "n")
    return numbered.select("n", fasta.fasta_text(numbered, "n", "seq").alias("value"))


@program("rabbits")
def rabbits(spark, path):
    df, number = _parameters(spark, path, "bigint")
    return _line(df, genetics.rabbits(number(0), number(1)))


@program("mortal-rabbits")
def mortal_rabbits(spark, path):
    df, number = _parameters(spark, path, "bigint")
    return _line(df, genetics.mortal_rabbits(number(0), number(1)))


@program("inner-nodes")
def inner_nodes(spark, path=None, leaves: int = 4):
    return _line(spark.range(1), genetics.inner_nodes(F.lit(leaves)))


@program("mrna-count")
def mrna_count(spark, path):
    return _line(_sequence(spark, path, "protein"), polymer.mrna_count(F.col("seq")))


@program("permutations")
def permutations(spark, path):
    df, number = _parameters(spark, path, "int")
    n = df.select(number(0)).first()[0]
    found = genetics.permutations(df, F.lit(n), n).select(F.array_join(F.col("permutation").cast("array<string>"), " ").alias("value"), "permutation")
    listed = dense_index(found, ["permutation"], "n").select((F.col("n") + 1).alias("n"), "value")
    return found.agg(F.lit(0).cast("bigint").alias("n"), F.count("*").cast("string").alias("value")).union(listed)


@program("words")
def words(spark, path):
    letters = F.split(F.trim("a"), r"\s+")
    df = _two_lines(spark, path).select(letters.alias("letters"), F.trim("b").cast("int").alias("k"))
    k, n_letters = df.select("k", F.size("letters")).first()
    digits = len(str(n_letters))
    # Letters sort as they are listed, so words are ordered by the ranks of their letters.
    ranked = df.withColumn("ranks", F.transform("letters", lambda x, i: F.lpad(i.cast("string"), digits, "0")))
    out = genetics.words(ranked, "ranks", F.col("k"), k, "code")
    spelled = F.transform(F.regexp_extract_all("code", F.lit(f"(.{{{digits}}})"), F.lit(1)), lambda c: F.element_at("letters", c.cast("int") + 1))
    return dense_index(out.select("code", F.array_join(spelled, "").alias("value")), ["code"], "n").select("n", "value")


@program("overlap-graph")
def overlap_graph(spark, path, k: int = 3):
    reads = fasta.read_fasta(spark, path, "dna")
    edges = overlap.overlap_edges(reads, "seq_idx", "seq", k)
    names = reads.select("seq_idx", "description")
    named = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return dense_index(named, ["src", "dst"], "n").select("n", F.concat_ws(" ", "a", "b").alias("value"))


@program("longest-repeat")
def longest_repeat(spark, path):
    df = _two_lines(spark, path).select(F.lit(0).alias("key"), F.regexp_replace("a", r"\$\s*$", "").alias("seq"), F.trim("b").cast("int").alias("k"))
    return _line(repeats.longest_repeat(df, "key", "seq", df.first().k), F.col("substring"))


@program("edges-to-tree")
def edges_to_tree(spark, path):
    lines = text.read_lines(spark, path)
    n = lines.where("line_idx = 0").first().line
    edges = lines.where("line_idx > 0").select(_pair_of_words(0).cast("bigint").alias("src"), _pair_of_words(1).cast("bigint").alias("dst"))
    nodes = spark.range(1, int(n) + 1).select(F.col("id").alias("node"))
    return _line(components.edges_to_tree(nodes, edges.where("dst IS NOT NULL"), "node", "src", "dst"), F.col("missing_edges"))


@program("trie")
def trie_of_lines(spark, path):
    edges = trie.trie_edges(text.read_lines(spark, path), "line")
    return edges.select(F.col("child").alias("n"), F.concat_ws(" ", "parent", "child", "symbol").alias("value"))


@program("expected-dominant")
def expected_dominant(spark, path):
    df, number = _parameters(spark, path)
    return _line(df, genetics.expected_dominant(*[number(i) for i in range(5)]))


@program("dominant-probability")
def dominant_probability(spark, path):
    df, number = _parameters(spark, path)
    return _line(df, genetics.dominant_phenotype_probability(*[number(i) for i in range(3)]))


@program("independent-alleles")
def independent_alleles(spark, path):
    df, number = _parameters(spark, path, "int")
    return _line(df, genetics.independent_alleles_tail(generation=number(0), at_least=number(1)))


@program("protein-mass")
def protein_mass(spark, path):
    lines = text.read_sequence(spark, path, "protein")
    return _line(lines.agg((F.sum(mass.protein_mass_e5(F.col("seq"))) / 100_000).alias("mass")), F.col("mass"))


@program("prefix-spectrum")
def prefix_spectrum(spark, path):
    return _line(spectrum.spectrum_protein(_masses(spark, path), "file", "line_idx", "mass"), F.col("protein"))


@program("spectrum-graph")
def spectrum_graph(spark, path):
    return _line(spectrum.spectrum_longest_path(_masses(spark, path), "file", "mass"), F.col("protein"))


@program("full-spectrum")
def full_spectrum(spark, path):
    rows = _masses(spark, path)
    parent = rows.where("line_idx = 0").select("file", F.col("mass").alias("parent"))
    peaks = rows.where("line_idx > 0").join(parent, "file")
    return _line(spectrum.full_spectrum_protein(peaks, "file", "line_idx", "mass", "parent"), F.col("protein"))


@program("log-probability")
def log_probability(spark, path):
    shares = F.transform(text.words(F.col("b")), lambda p: polymer.log10_probability(F.col("a"), p.cast("double")).cast("string"))
    return _line(_two_lines(spark, path), F.array_join(shares, " "))


@program("translate")
def translate(spark, path):
    return _line(_sequence(spark, path, "rna"), polymer.translate_rna(F.col("seq")))


@program("consensus")
def consensus_profile(spark, path):
    reads = fasta.read_fasta(spark, path, "dna")
    best = consensus.consensus(reads, ["file"], "seq_idx", "seq").select(F.lit(0).cast("bigint").alias("n"), F.col("consensus").alias("value"))
    profile = consensus.profile(reads, ["file"], "seq_idx", "seq")
    for n, base in enumerate(ALPHABETS["dna"]):
        cells = profile.select("file", "pos0", F.concat(F.lit(" "), F.col(f"n_{base.lower()}").cast("string")).alias("cell"))
        row = ordered_concat(cells, ["file"], "pos0", "cell", "value")
        best = best.union(row.select(F.lit(n + 1).cast("bigint"), F.concat(F.lit(f"{base}:"), "value")))
    return best


@program("nucleotide-counts")
def nucleotide_counts(spark, path):
    lines = text.read_sequence(spark, path, "dna")
    sums = lines.agg(*[F.sum(polymer.symbol_count(F.col("seq"), b)).alias(b) for b in ALPHABETS["dna"]])
    return _line(sums, F.concat_ws(" ", *[F.col(b) for b in ALPHABETS["dna"]]))


@program("highest-gc")
def highest_gc(spark, path):
    gc = fasta.read_fasta(spark, path, "dna").select("description", F.struct(polymer.gc_content(F.col("seq")).alias("gc"), "seq_idx").alias("o"))
    return _line(gc.agg(F.max_by("description", "o").alias("d"), F.max("o").alias("o")), F.col("d"), F.col("o.gc") * 100)


@program("failure-array")
def failure_array(spark, path):
    borders = F.transform(strings.border_array(F.col("seq")), lambda b: b.cast("string"))
    return _line(_first_genome(spark, path), F.array_join(borders, " "))


@program("shared-motif")
def shared_motif(spark, path):
    return _line(repeats.common_substring(fasta.read_fasta(spark, path, "dna"), "file", "seq"), F.col("substring"))


@program("protein-motif")
def protein_motif(spark, path, motif: str = GLYCOSYLATION_MOTIF):
    """Sites in a FASTA file of proteins: the name and the positions of each that has any."""
    found = fasta.read_fasta(spark, path, "protein").select("seq_idx", "description", strings.regex_positions1(F.col("seq"), motif).alias("at"))
    sites = F.array_join(F.transform("at", lambda p: p.cast("string")), " ")
    rows = found.where(F.size("at") > 0).select("seq_idx", F.posexplode(F.array("description", sites)).alias("i", "value"))
    return rows.select((F.col("seq_idx") * 2 + F.col("i")).alias("n"), "value")


@program("reverse-complement")
def reverse_complement(spark, path):
    return _line(_sequence(spark, path, "dna"), polymer.reverse_complement(F.col("seq")))


@program("transcribe")
def transcribe(spark, path):
    return _line(_sequence(spark, path, "dna"), polymer.transcribe(F.col("seq")))


@program("palindromes")
def palindromes(spark, path):
    sites = polymer.palindrome_sites(_first_genome(spark, path), "seq_idx", "seq")
    return sites.select((F.col("pos1") * 100 + F.col("length")).alias("n"), F.concat_ws(" ", "pos1", "length").alias("value"))


@program("splice-translate")
def splice_translate(spark, path):
    """The first record without the later ones, translated."""
    record = F.struct("seq_idx", "seq")
    ordered = fasta.read_fasta(spark, path, "dna").groupBy("file").agg(F.array_sort(F.collect_list(record)).alias("r"))
    seqs = F.transform("r", lambda r: r["seq"])
    introns = F.slice(seqs, F.lit(2), F.size(seqs))
    return _line(ordered, polymer.splice_translate(F.element_at(seqs, 1), introns))
