"""Queries over the given tables, each with SQL for the same result where SQL can tell it.

Every query runs over whole tables and whole texts. Fractions are compared as scaled integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.constants import CODON_BASES, CODON_RESIDUES, GLYCOSYLATION_MOTIF, RESIDUE_MASS_E5
from strandloom.functions import alignment, alphabet, genetics, mass, polymer, strings
from strandloom.operators import (
    assembly,
    borders,
    components,
    consensus,
    coverage,
    diagnostics,
    fm_index,
    overlap,
    repeats,
    search,
    spectrum,
    suffix,
    suffix_tree,
    traversal,
    trie,
)
from strandloom.plans.bridges import (
    documents,
    documents_sql,
    key_dna,
    key_dna_sql,
    part_keys,
    parts,
    parts_sql,
    table,
    text_dna,
    text_dna_sql,
)
from strandloom.plans.session import checkpointed, shared_folder
from strandloom.sources import fasta, simulate, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def scaled(value, factor: int = 1_000_000):
    return F.round(value * factor).cast("bigint")


# Pieces of SQL used more than once.
_PAIRS = f"(SELECT p_partkey AS seq_id, {key_dna_sql('p_partkey')} AS a, {key_dna_sql('p_partkey', 1)} AS b FROM part)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_keys(spark, sf_dir).select(
        F.col("p_partkey").alias("seq_id"), key_dna("p_partkey").alias("a"), key_dna("p_partkey", 1).alias("b")
    )


def _protein_sql(dna: str) -> str:
    """Translation of a DNA expression up to the first stop, a partial codon dropped."""
    rna = f"translate({dna}, 'T', 'U')"
    digit = [f"(instr('{CODON_BASES}', c[{i}]) - 1)" for i in (1, 2, 3)]
    residue = f"substr('{CODON_RESIDUES}', 16 * {digit[0]} + 4 * {digit[1]} + {digit[2]} + 1, 1)"
    codons = f"regexp_extract_all({rna}, '...')"
    return f"split_part(array_to_string(list_transform({codons}, lambda c: {residue}), ''), '*', 1)"


def _proteins(spark: SparkSession, sf_dir: str, blocks: int = 1) -> DataFrame:
    protein = polymer.translate_rna(polymer.transcribe(F.col("seq")), strict=False)
    return parts(spark, sf_dir, blocks).select("seq_id", protein.alias("protein"))


def _proteins_sql(blocks: int = 1) -> str:
    return f"(SELECT seq_id, {_protein_sql('seq')} AS protein FROM {parts_sql(blocks)})"


_MASSES_SQL = "(VALUES " + ", ".join(f"('{r}', {m})" for r, m in RESIDUE_MASS_E5.items()) + ") AS w(residue, mass_e5)"
_MASS_OF_PROTEIN_SQL = " + ".join(
    f"(length(protein) - length(replace(protein, '{r}', ''))) * {m}" for r, m in RESIDUE_MASS_E5.items()
)


# ---- alphabets and text ------------------------------------------------------------------


@query(
    "validate",
    f"""SELECT seq_id, regexp_full_match(text, '[\\x00-\\x7F]*') AS is_ascii,
    regexp_full_match(seq, '[ACGT]*') AS is_dna, regexp_full_match(text, '[ACGT]*') AS text_is_dna
    FROM (SELECT doc_id AS seq_id, text, {text_dna_sql('text')} AS seq FROM documents)""",
)
def validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text", text_dna("text").alias("seq"))
    return docs.select(
        "seq_id",
        alphabet.is_valid(F.col("text"), "ascii").alias("is_ascii"),
        alphabet.is_valid(F.col("seq"), "dna").alias("is_dna"),
        alphabet.is_valid(F.col("text"), "dna").alias("text_is_dna"),
    )


@query(
    "alphabet_ops",
    """SELECT p_partkey, array_to_string(list_sort(string_split(p_name, '')), '') AS sorted_chars,
    CAST(instr('ACGT', substr(seq, 3, 1)) - 1 AS INTEGER) AS symbol_ord, substr(seq, 6, 5) AS middle,
    substr(seq, 32, 1) AS last_char, CASE WHEN seq < other THEN -1 WHEN seq > other THEN 1 ELSE 0 END AS ordering
    FROM (SELECT p_partkey, p_name, """
    + f"{key_dna_sql('p_partkey')} AS seq, {key_dna_sql('p_partkey', 1)} AS other FROM part)",
)
def alphabet_ops(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", key_dna("p_partkey").alias("seq"), key_dna("p_partkey", 1).alias("other")
    )
    seq = F.col("seq")
    return df.select(
        "p_partkey",
        alphabet.sort_chars(F.col("p_name")).alias("sorted_chars"),
        alphabet.symbol_index(alphabet.char_at(seq, F.lit(2)), "dna").alias("symbol_ord"),
        alphabet.slice_(seq, 5, 10).alias("middle"),
        alphabet.char_at(seq, F.lit(31)).alias("last_char"),
        alphabet.compare(seq, F.col("other")).alias("ordering"),
    )


@query(
    "text_lines",
    """SELECT doc_id, n_lines, n_words FROM (SELECT doc_id,
    CAST(len(list_filter(list_transform(string_split_regex(text, '\\r?\\n'),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0)) AS INTEGER) AS n_lines,
    CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 0)) AS INTEGER) AS n_words FROM documents)""",
)
def text_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.size(text.split_lines(F.col("text"))).alias("n_lines"),
        F.size(text.words(F.col("text"))).alias("n_words"),
    )


@query(
    "fasta_roundtrip",
    f"""SELECT seq_id, CAST(i AS BIGINT) AS seq_idx, CAST(i AS VARCHAR) || ':' || length(seq) AS description, seq FROM (
    SELECT seq_id, 0 AS i, seq FROM {documents_sql()} UNION ALL SELECT seq_id, 1 AS i, reverse(seq) AS seq FROM {documents_sql()})""",
)
def fasta_roundtrip(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("first", F.lit(0)).withColumn("second", F.lit(1))
    docs = docs.withColumn("reversed", F.reverse("seq"))
    both = F.concat(fasta.fasta_text(docs, "first", "seq"), F.lit("\n\n "), fasta.fasta_text(docs, "second", "reversed"))
    parsed = fasta.parse_fasta(docs.select("seq_id", both.alias("fasta")), "fasta", "dna")
    return parsed.select("seq_id", "seq_idx", "description", "seq")


_LINE = 60
_FILES_SQL = f"(SELECT seq_id, seq, seq_id || ':' || length(seq) AS description FROM {documents_sql()})"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _pieces(docs: DataFrame) -> DataFrame:
    cut = F.regexp_extract_all("seq", F.lit(f"(.{{1,{_LINE}}})"), F.lit(1))
    return docs.select("seq_id", F.posexplode(cut).alias("pos", "piece"))


@query("fasta_files", f"SELECT description, seq FROM {_FILES_SQL}")
def fasta_files(spark, sf_dir):
    """Whole documents through the FASTA sink and source."""
    docs, path = documents(spark, sf_dir), _folder(spark)
    fasta.write_fasta(docs, "seq_id", "seq", path)
    return fasta.read_fasta(spark, path, "dna").select("description", "seq")


@query(
    "line_files",
    f"""SELECT line, count(*) AS n FROM (SELECT '>' || description AS line FROM {_FILES_SQL} WHERE seq <> '' UNION ALL
    SELECT substr(seq, CAST(i AS BIGINT), {_LINE}) FROM (SELECT seq, unnest(range(1, length(seq) + 1, {_LINE})) AS i FROM {_FILES_SQL})) GROUP BY line""",
)
def line_files(spark, sf_dir):
    """The lines of the files that the sink of pieces writes."""
    path = _folder(spark)
    fasta.write_fasta_pieces(_pieces(documents(spark, sf_dir)), "seq_id", "pos", "piece", path)
    return text.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("sequence_files", f"SELECT seq, count(*) AS n FROM {documents_sql()} GROUP BY seq")
def sequence_files(spark, sf_dir):
    """Sequences written with blanks in between and read without them."""
    docs, path = documents(spark, sf_dir), _folder(spark)
    spaced = docs.select("seq_id", F.concat(F.lit(" "), F.regexp_replace("seq", "(..........)", "$1 \t"), F.lit(" ")).alias("value"))
    text.write_ordered(spaced, ["seq_id"], "value", path)
    return text.read_sequence(spark, path, "dna").groupBy("seq").agg(F.count("*").alias("n"))


@query(
    "symbol_ops",
    f"""SELECT p_partkey, array_to_string(string_split(seq, ''), '-') AS symbols, substr('$ACGT', 1 + p_partkey % 5, 1) AS symbol,
    CAST(instr('$ACGT', substr(seq, 1, 1)) - 1 AS INTEGER) AS after_sentinel, CAST(instr('ACGT#', substr('ACGT#', 1 + p_partkey % 5, 1)) - 1 AS INTEGER) AS before_sentinel,
    array_to_string(list_transform(range(1, length(s) + 1), lambda i: coalesce(list_max(list_filter(range(1, i), lambda b: right(left(s, i), b) = left(s, b))), 0)), ' ') AS borders
    FROM (SELECT p_partkey, seq, left(seq, p_partkey % 20) AS s FROM (SELECT p_partkey, {key_dna_sql('p_partkey')} AS seq FROM part))""",
)
def symbol_ops(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", key_dna("p_partkey").alias("seq"))
    start = F.left("seq", (F.col("p_partkey") % 20).cast("int"))
    place = (F.col("p_partkey") % 5).cast("int")
    return df.select(
        "p_partkey",
        F.array_join(text.symbols_of(F.concat(F.lit(" "), "seq", F.lit("\n")), "dna"), "-").alias("symbols"),
        alphabet.symbol_at(place, "dna", "first").alias("symbol"),
        alphabet.symbol_index(F.left("seq", F.lit(1)), "dna", "first").alias("after_sentinel"),
        alphabet.symbol_index(alphabet.symbol_at(place, "dna", "last"), "dna", "last").alias("before_sentinel"),
        F.array_join(strings.border_array_simple(start).cast("array<string>"), " ").alias("borders"),
    )


# ---- composition and translation ----------------------------------------------------------


@query(
    "gc_content",
    f"""SELECT seq_id, CAST(length(seq) - length(translate(seq, 'CG', '')) AS BIGINT) AS gc_bases,
    CAST(round((length(seq) - length(translate(seq, 'CG', ''))) / length(seq) * 1000000) AS BIGINT) AS gc_e6 FROM {documents_sql()}""",
)
def gc_content(spark, sf_dir):
    seq = F.col("seq")
    return documents(spark, sf_dir).select(
        "seq_id", polymer.gc_count(seq).alias("gc_bases"), scaled(polymer.gc_content(seq)).alias("gc_e6")
    )


@query(
    "gc_argmax",
    f"""SELECT seq_id, CAST(round(gc * 1000000) AS BIGINT) AS gc_e6 FROM (SELECT seq_id,
    (length(seq) - length(translate(seq, 'CG', ''))) / length(seq) AS gc FROM {documents_sql()})
    ORDER BY gc DESC, seq_id DESC LIMIT 1""",
)
def gc_argmax(spark, sf_dir):
    gc = documents(spark, sf_dir).select("seq_id", polymer.gc_content(F.col("seq")).alias("gc"))
    best = gc.agg(F.max(F.struct("gc", "seq_id")).alias("b"))
    return best.select("b.seq_id", scaled(F.col("b.gc")).alias("gc_e6"))


@query(
    "nt_counts",
    "SELECT seq_id, "
    + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}" for b in "ACGT")
    + f" FROM {documents_sql()}",
)
def nt_counts(spark, sf_dir):
    counted = documents(spark, sf_dir).select("seq_id", polymer.nucleotide_counts(F.col("seq")).alias("n"))
    return counted.select("seq_id", *[F.col(f"n.{b}").alias(f"n_{b}") for b in "acgt"])


@query(
    "strand_views",
    f"""SELECT seq_id, md5(translate(seq, 'ACGT', 'TGCA')) AS complement, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp,
    md5(translate(seq, 'T', 'U')) AS rna FROM {documents_sql()}""",
)
def strand_views(spark, sf_dir):
    seq = F.col("seq")
    return documents(spark, sf_dir).select(
        "seq_id",
        F.md5(polymer.complement(seq)).alias("complement"),
        F.md5(polymer.reverse_complement(seq)).alias("revcomp"),
        F.md5(polymer.transcribe(seq)).alias("rna"),
    )


@query(
    "codon_usage",
    f"""SELECT c AS codon, substr('{CODON_RESIDUES}', CAST(16 * (instr('{CODON_BASES}', c[1]) - 1) + 4 * (instr('{CODON_BASES}', c[2]) - 1)
    + instr('{CODON_BASES}', c[3]) AS BIGINT), 1) AS residue, count(*) AS uses
    FROM (SELECT unnest(regexp_extract_all(translate(seq, 'T', 'U'), '...')) AS c FROM {documents_sql()}) GROUP BY c""",
)
def codon_usage(spark, sf_dir):
    rna = polymer.transcribe(F.col("seq"))
    codons = F.explode(F.regexp_extract_all(rna, F.lit("(...)"), F.lit(1))).alias("codon")
    counts = documents(spark, sf_dir).select(codons).groupBy("codon").agg(F.count("*").alias("uses"))
    return counts.join(polymer.codon_table(spark), "codon").select("codon", "residue", "uses")


@query("translate", f"SELECT seq_id, {_protein_sql('seq')} AS protein FROM {documents_sql()}")
def translate(spark, sf_dir):
    protein = polymer.translate_rna(polymer.transcribe(F.col("seq")), strict=False)
    return documents(spark, sf_dir).select("seq_id", protein.alias("protein"))


@query(
    "splice_translate",
    f"""SELECT seq_id, {_protein_sql("replace(replace(seq, substr(seq, 5, 4), ''), substr(seq, 40, 3), '')")} AS protein
    FROM {parts_sql(3)}""",
)
def splice_translate(spark, sf_dir):
    seq = F.col("seq")
    introns = F.array(F.substring(seq, 5, 4), F.substring(seq, 40, 3))
    return parts(spark, sf_dir, 3).select("seq_id", polymer.splice_translate(seq, introns, strict=False).alias("protein"))


@query(
    "mrna_count",
    "WITH RECURSIVE p AS (SELECT seq_id, protein FROM "
    + _proteins_sql(4)
    + """), w AS (SELECT r, count(*) AS ways FROM (SELECT unnest(string_split('"""
    + CODON_RESIDUES
    + """', '')) AS r) GROUP BY r), steps AS (
    SELECT seq_id, protein, 0 AS i, CAST(3 AS BIGINT) AS n FROM p
    UNION ALL SELECT seq_id, protein, i + 1, CAST(n * ways % 1000000 AS BIGINT) FROM steps JOIN w ON r = substr(protein, i + 1, 1) WHERE i < length(protein))
    SELECT seq_id, n AS mrna FROM steps WHERE i = length(protein)""",
)
def mrna_count(spark, sf_dir):
    return _proteins(spark, sf_dir, 4).select("seq_id", polymer.mrna_count(F.col("protein")).alias("mrna"))


@query(
    "palindromes",
    f"""SELECT seq_id, CAST(i AS BIGINT) AS pos1, CAST(n AS INTEGER) AS length FROM (
    SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM {parts_sql(4)}), (VALUES (4),(5),(6),(7),(8),(9),(10),(11),(12)) AS l(n)
    WHERE i + n - 1 <= length(seq) AND substr(seq, i, n) = reverse(translate(substr(seq, i, n), 'ACGT', 'TGCA'))""",
)
def palindromes(spark, sf_dir):
    return polymer.palindrome_sites(parts(spark, sf_dir, 4), "seq_id", "seq")


@query(
    "log_probability",
    f"""SELECT seq_id, CAST(round((gc * log10(p / 2) + (length(seq) - gc) * log10((1 - p) / 2)) * 1000) AS BIGINT) AS log10_e3 FROM (
    SELECT seq_id, seq, length(seq) - length(translate(seq, 'CG', '')) AS gc, (1 + seq_id % 9) / 10.0::DOUBLE AS p FROM {documents_sql()})""",
)
def log_probability(spark, sf_dir):
    p = (1 + F.col("seq_id") % 9) / F.lit(10.0)
    return documents(spark, sf_dir).select("seq_id", scaled(polymer.log10_probability(F.col("seq"), p), 1000).alias("log10_e3"))


_BRAND_SQL = f"(SELECT p_brand, p_partkey, left({key_dna_sql('p_partkey', 0, 3)}, CAST(60 + p_size % 20 AS BIGINT)) AS seq FROM part)"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sequences of different lengths, so that the width of the first record matters.
    seq = F.left(key_dna("p_partkey", 0, 3), 60 + F.col("p_size") % 20)
    return part_keys(spark, sf_dir, "p_brand", "p_size").select("p_brand", "p_partkey", seq.alias("seq"))


_PROFILE_SQL = f"""SELECT p_brand, CAST(i - 1 AS INTEGER) AS pos0, """ + ", ".join(
    f"count(*) FILTER (c = '{b}') AS n_{b.lower()}" for b in "ACGT"
) + f""" FROM (SELECT p_brand, i, substr(seq, i, 1) AS c FROM (
    SELECT b.p_brand, seq, unnest(range(1, least(length(seq), width) + 1)) AS i FROM {_BRAND_SQL} b
    JOIN (SELECT p_brand, arg_min(length(seq), p_partkey) AS width FROM {_BRAND_SQL} GROUP BY p_brand) w ON b.p_brand = w.p_brand))
    GROUP BY p_brand, i"""


@query("base_profile", _PROFILE_SQL)
def base_profile(spark, sf_dir):
    return consensus.profile(_brands(spark, sf_dir), ["p_brand"], "p_partkey", "seq")


@query(
    "consensus",
    f"""SELECT p_brand, string_agg(CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' ELSE 'T' END,
    '' ORDER BY pos0) AS consensus FROM ({_PROFILE_SQL}) GROUP BY p_brand""",
)
def consensus_string(spark, sf_dir):
    return consensus.consensus(_brands(spark, sf_dir), ["p_brand"], "p_partkey", "seq")


# ---- exact search --------------------------------------------------------------------------


@query("find_first", "SELECT doc_id, CAST(nullif(instr(text, 'tion'), 0) - 1 AS INTEGER) AS pos0 FROM documents")
def find_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.find(F.col("text"), F.lit("tion")).alias("pos0"))


@query(
    "overlap_positions",
    """SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS pos0 FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations)
    WHERE substr(text, i, 3) = 'ere'""",
)
def overlap_positions(spark, sf_dir):
    found = strings.positions(F.col("text"), F.lit("ere"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("pos0"))


@query(
    "count_occurrences",
    """SELECT seq_id, CAST(len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 3) = 'ACA')) AS BIGINT) AS hits FROM """
    + parts_sql(4),
)
def count_occurrences(spark, sf_dir):
    return parts(spark, sf_dir, 4).select("seq_id", strings.count_occurrences(F.col("seq"), F.lit("ACA")).alias("hits"))


@query("replace_all", "SELECT doc_id, md5(replace(text, 'ou', '<>')) AS replaced FROM documents")
def replace_all(spark, sf_dir):
    new = strings.replace_all(F.col("text"), F.lit("ou"), F.lit("<>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(new).alias("replaced"))


@query(
    "suffix_prefix_overlap",
    """SELECT p_partkey, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: right(a, n) = left(b, n))), 0) AS BIGINT) AS overlap
    FROM (SELECT p_partkey, p_name || ' ' || p_brand AS a, p_brand || ' ' || p_type AS b FROM part)""",
)
def suffix_prefix_overlap(spark, sf_dir):
    a, b = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", strings.overlap(a, b).alias("overlap"))


@query(
    "common_prefix",
    f"""SELECT seq_id, left(a, n) AS lcp FROM (SELECT seq_id, a, coalesce(list_max(list_filter(range(1, 33), lambda n: left(a, n) = left(b, n))), 0) AS n
    FROM {_PAIRS})""",
)
def common_prefix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seq_id", strings.lcp(F.col("a"), F.col("b")).alias("lcp"))


@query("hamming", f"SELECT seq_id, CAST(hamming(a, b) AS BIGINT) AS distance FROM {_PAIRS}")
def hamming(spark, sf_dir):
    longer = F.concat("b", "a")
    return _pairs(spark, sf_dir).select("seq_id", strings.hamming(F.col("a"), longer).alias("distance"))


@query(
    "regex_positions",
    """SELECT conv_id, turn, CAST(i AS BIGINT) AS pos1 FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations)
    WHERE regexp_full_match(substr(text, i, 4), '[aeiou]n[^aeiou][a-z]', 's')""",
)
def regex_positions(spark, sf_dir):
    found = strings.regex_positions1(F.col("text"), "[aeiou]n[^aeiou][a-z]")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("pos1"))


@query(
    "motif_search",
    f"""SELECT seq_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY i) AS positions FROM (
    SELECT seq_id, protein, unnest(range(1, length(protein) + 1)) AS i FROM (SELECT seq_id, {_protein_sql('seq')} AS protein FROM {parts_sql(8)}))
    WHERE regexp_full_match(substr(protein, i, 4), '{GLYCOSYLATION_MOTIF}') GROUP BY seq_id""",
)
def motif_search(spark, sf_dir):
    at = strings.regex_positions1(F.col("protein"), GLYCOSYLATION_MOTIF)
    # Written first, as a condition on what is derived from the keys would move to before they are dealt out.
    found = checkpointed(_proteins(spark, sf_dir, 8)).where(F.regexp_like("protein", F.lit(GLYCOSYLATION_MOTIF))).select("seq_id", at.alias("at"))
    return found.select("seq_id", F.array_join(F.transform("at", lambda p: p.cast("string")), " ").alias("positions"))


@query(
    "border_array",
    f"""SELECT seq_id, CAST(i - 1 AS INTEGER) AS pos0, CAST(coalesce(list_max(list_filter(range(1, i), lambda b: right(left(seq, i), b) = left(seq, b))), 0) AS INTEGER) AS border
    FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM {parts_sql()})""",
)
def border_array(spark, sf_dir):
    each = F.posexplode(strings.border_array(F.col("seq"))).alias("pos0", "border")
    return parts(spark, sf_dir).select("seq_id", each)


@query(
    "border_array_documents",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT seq_id, seq, length(seq) AS n FROM {documents_sql()}),
    w AS (SELECT seq_id, n, left(seq, 12) AS h, unnest(range(1, n)) AS p, unnest(list_transform(range(2, n + 1), lambda i: substr(seq, i, 12))) AS s FROM d),
    short AS MATERIALIZED (SELECT seq_id, n, p, CASE WHEN s = h THEN 12 WHEN left(s, 1) <> left(h, 1) THEN 0 ELSE
      list_max(list_filter(range(1, 12), lambda k: k <= length(s) AND left(s, k) = left(h, k))) END AS z FROM w),
    b(seq_id, p, lo, hi) AS (SELECT seq_id, p, CAST(12 AS BIGINT), n - p FROM short WHERE z = 12 UNION ALL
      SELECT seq_id, p, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid - 1 END FROM (
        SELECT b.seq_id, p, lo, hi, (lo + hi + 1) // 2 AS mid, left(seq, (lo + hi + 1) // 2) = substr(seq, p + 1, (lo + hi + 1) // 2) AS ok
        FROM b JOIN d ON d.seq_id = b.seq_id WHERE lo < hi)),
    z AS (SELECT seq_id, n, p, z FROM short WHERE z < 12 UNION ALL SELECT b.seq_id, n, p, lo FROM b JOIN d ON d.seq_id = b.seq_id WHERE lo = hi)
    SELECT d.seq_id, CAST(coalesce(max(z), 0) AS INTEGER) AS longest, CAST(coalesce(max(z) FILTER (p + z = d.n), 0) AS INTEGER) AS last
    FROM d LEFT JOIN z ON z.seq_id = d.seq_id GROUP BY d.seq_id""",
)
def border_array_documents(spark, sf_dir):
    each = strings.border_array(F.col("seq"))
    # An empty document has an empty array.
    both = [F.when(each.isNotNull(), F.coalesce(value, F.lit(0))) for value in (F.array_max(each), F.try_element_at(each, F.lit(-1)))]
    return documents(spark, sf_dir).select("seq_id", both[0].alias("longest"), both[1].alias("last"))


_WORDS_SQL = """(SELECT DISTINCT w AS pattern FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark) WHERE length(w) > 0)"""


def _word_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("pattern")).distinct()


_HITS_SQL = f"""(SELECT h.conv_id, h.turn, p.pattern, h.i - 1 AS pos0 FROM (
    SELECT conv_id, turn, i, n, substr(text, i, n) AS s FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations),
    (SELECT DISTINCT length(pattern) AS n FROM {_WORDS_SQL}) WHERE i + n - 1 <= length(text)) h
    JOIN {_WORDS_SQL} p ON p.pattern = h.s)"""


@query("pattern_search", f"SELECT conv_id, turn, pattern, CAST(pos0 AS BIGINT) AS pos0 FROM {_HITS_SQL}")
def pattern_search(spark, sf_dir):
    hits = search.find_patterns(_turns(spark, sf_dir), "key", "text", _word_patterns(spark, sf_dir), "pattern")
    return hits.select("key.conv_id", "key.turn", "pattern", "pos0")


@query(
    "first_occurrence",
    f"SELECT conv_id, turn, pattern, CAST(min(pos0) AS BIGINT) AS pos0, count(*) AS hits FROM {_HITS_SQL} GROUP BY conv_id, turn, pattern",
)
def first_occurrence(spark, sf_dir):
    first = search.first_occurrence(_turns(spark, sf_dir), "key", "text", _word_patterns(spark, sf_dir), "pattern")
    return first.select("key.conv_id", "key.turn", "pattern", "pos0", "hits")


@query(
    "passage_search",
    """SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS pos0 FROM documents d, benchmark b WHERE contains(d.text, b.text)""",
)
def passage_search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    first = search.first_occurrence(table(spark, sf_dir, "documents"), "doc_id", "text", items, "pattern")
    return first.join(items, "pattern").select("doc_id", "item_id", "pos0")


@query(
    "maximal_prefix",
    f"""SELECT seq_id, CAST(n AS BIGINT) AS length, n = 32 AS full_match, CAST(len(hits) AS INTEGER) AS n_positions,
    CAST(list_min(list_transform(hits, lambda p: {{'s': substr(s, p), 'p': p}})).p - 1 AS BIGINT) AS pos0
    FROM (SELECT seq_id, s, n, list_filter(range(1, length(s) + 1), lambda p: substr(s, p, n) = left(t, n)) AS hits FROM (
    SELECT seq_id, s, t, list_max(list_filter(range(0, 33), lambda n: contains(s, left(t, n)))) AS n FROM (
    SELECT p_partkey AS seq_id, {key_dna_sql('p_partkey', 1, 3)} AS s, {key_dna_sql('p_partkey')} AS t FROM part)))""",
)
def maximal_prefix(spark, sf_dir):
    pairs = part_keys(spark, sf_dir).select(
        F.col("p_partkey").alias("seq_id"), key_dna("p_partkey", 1, 3).alias("s"), key_dna("p_partkey").alias("t")
    )
    found = pairs.select("seq_id", strings.maximal_prefix_matches(F.col("s"), F.col("t")).alias("m"))
    return found.select(
        "seq_id", "m.length", F.col("m.full").alias("full_match"), F.size("m.positions").alias("n_positions"), "m.pos0"
    )


# ---- suffix indexes ------------------------------------------------------------------------

_SUFFIXES_SQL = f"(SELECT seq_id, seq, unnest(range(0, length(seq))) AS p FROM {parts_sql()})"
_ARRAY_SQL = f"(SELECT seq_id, seq, row_number() OVER (PARTITION BY seq_id ORDER BY substr(seq, p + 1)) - 1 AS rank, p AS pos0 FROM {_SUFFIXES_SQL})"


@query("suffix_array", f"SELECT seq_id, CAST(rank AS BIGINT) AS rank, CAST(pos0 AS BIGINT) AS pos0 FROM {_ARRAY_SQL}")
def suffix_array(spark, sf_dir):
    return suffix.suffix_array(parts(spark, sf_dir), "seq_id", "seq")


@query(
    "suffix_array_documents",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, unnest(range(0, length(text))) AS p, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 128))) AS s FROM documents),
    d AS MATERIALIZED (SELECT doc_id, p, dense_rank() OVER (PARTITION BY doc_id ORDER BY s) AS r FROM s),
    t(k, doc_id, p, r) AS (SELECT CAST(128 AS BIGINT), doc_id, p, r FROM d UNION ALL
      SELECT k * 4, doc_id, p, dense_rank() OVER (PARTITION BY doc_id ORDER BY r, r2, r3, r4) FROM (
        SELECT k, doc_id, p, r, coalesce(lead(r, 1) OVER w, 0) AS r2, coalesce(lead(r, 2) OVER w, 0) AS r3, coalesce(lead(r, 3) OVER w, 0) AS r4 FROM t
        WINDOW w AS (PARTITION BY doc_id, p % k ORDER BY p))
      WHERE k < (SELECT max(length(text)) FROM documents))
    SELECT doc_id, CAST(r - 1 AS BIGINT) AS rank, CAST(p AS BIGINT) AS pos0 FROM t WHERE k = (SELECT max(k) FROM t)""",
)
def suffix_array_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.suffix_array(docs, "doc_id", "text")


@query(
    "lcp_array",
    f"""SELECT seq_id, CAST(rank AS BIGINT) AS rank, CAST(coalesce(list_max(list_filter(range(1, 33), lambda n: n <= length(b) AND left(a, n) = left(b, n))), 0) AS BIGINT) AS lcp
    FROM (SELECT seq_id, rank, substr(seq, pos0 + 1) AS a, lag(substr(seq, pos0 + 1)) OVER (PARTITION BY seq_id ORDER BY rank) AS b FROM {_ARRAY_SQL}) WHERE rank > 0""",
)
def lcp_array(spark, sf_dir):
    return suffix.build_suffix_index(parts(spark, sf_dir), "seq_id", "seq").neighbours().select("seq_id", "rank", "lcp")


@query(
    "bwt",
    f"""SELECT seq_id, string_agg(CASE WHEN p = 0 THEN '$' ELSE substr(seq, p, 1) END, '' ORDER BY substr(seq, p + 1)) AS bwt
    FROM (SELECT seq_id, seq, unnest(range(0, length(seq) + 1)) AS p FROM {parts_sql()}) GROUP BY seq_id""",
)
def bwt(spark, sf_dir):
    return fm_index.transform(parts(spark, sf_dir), "seq_id", "seq").shown()


@query("bwt_inverse", f"SELECT seq_id, seq FROM {parts_sql()}")
def bwt_inverse(spark, sf_dir):
    return fm_index.transform(parts(spark, sf_dir), "seq_id", "seq").inverse()


@query(
    "fm_search",
    f"""SELECT seq_id, pattern, CAST(i - 1 AS BIGINT) AS pos0 FROM (SELECT p_partkey AS seq_id, {key_dna_sql('p_partkey', 0, 2)} AS seq,
    substr({key_dna_sql('p_partkey', 2)}, 1, CAST(1 + p_partkey % 4 AS BIGINT)) AS pattern, unnest(range(1, 65)) AS i FROM part) WHERE substr(seq, i, length(pattern)) = pattern""",
)
def fm_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pattern = F.substring(key_dna("p_partkey", 2), F.lit(1), (1 + F.col("p_partkey") % 4).cast("int"))
    index = fm_index.build_fm_index(parts(spark, sf_dir, 2), "seq_id", "seq")
    queries = part.select(F.col("p_partkey").alias("seq_id"), pattern.alias("pattern"))
    return fm_index.locate(index, fm_index.backward_search(index, queries, "pattern"))


@query(
    "suffix_offsets",
    f"""WITH r AS MATERIALIZED (SELECT seq_id, p, row_number() OVER (PARTITION BY seq_id ORDER BY substr(seq, p + 1)) - 1 AS rank, substr(seq, p + 1) AS suffix
      FROM (SELECT seq_id, seq, unnest(range(0, length(seq) + 1)) AS p FROM {parts_sql()}))
    SELECT h.seq_id, h.pattern, CAST(h.rank AS BIGINT) AS rank, CAST(min((h.p - s.p + 33) % 33) AS INTEGER) AS steps FROM (
      SELECT r.*, pattern FROM r JOIN (SELECT p_partkey, left({key_dna_sql('p_partkey', 2)}, 2) AS pattern FROM part) q ON q.p_partkey = r.seq_id AND starts_with(r.suffix, pattern)) h
    JOIN r s ON s.seq_id = h.seq_id AND s.rank % 10 = 0 GROUP BY h.seq_id, h.pattern, h.rank""",
)
def suffix_offsets(spark, sf_dir):
    index = fm_index.build_fm_index(parts(spark, sf_dir), "seq_id", "seq")
    pattern = F.left(key_dna("p_partkey", 2), F.lit(2))
    queries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), pattern.alias("pattern"))
    found = fm_index.backward_search(index, queries, "pattern")
    return fm_index.suffix_offsets(index, found, 10).select("seq_id", "pattern", "rank", F.col("offset").alias("steps"))


_TURNS_SQL = "(SELECT conv_id, turn, text, substr(text, 1 + length(text) // 2, 1 + turn % 4) AS pattern FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with spaces and line ends, and a piece from the middle of each."""
    piece = F.substring("text", F.lit(1) + F.floor(F.length("text") / 2).cast("int"), (1 + F.col("turn") % 4).cast("int"))
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.struct("conv_id", "turn").alias("key"), "text", piece.alias("pattern"))


@query(
    "bwt_turns",
    """SELECT conv_id, turn, string_agg(CASE WHEN p = 0 THEN '$' ELSE substr(text, p, 1) END, '' ORDER BY substr(text, p + 1)) AS bwt
    FROM (SELECT conv_id, turn, text, unnest(range(0, length(text) + 1)) AS p FROM conversations) GROUP BY conv_id, turn""",
)
def bwt_turns(spark, sf_dir):
    found = fm_index.transform(_turns(spark, sf_dir), "key", "text").shown()
    return found.select("key.conv_id", "key.turn", "bwt")


@query("bwt_inverse_turns", "SELECT conv_id, turn, text FROM conversations")
def bwt_inverse_turns(spark, sf_dir):
    back = fm_index.transform(_turns(spark, sf_dir), "key", "text").inverse()
    return back.select("key.conv_id", "key.turn", F.col("seq").alias("text"))


@query(
    "fm_search_turns",
    f"""SELECT conv_id, turn, pattern, CAST(i - 1 AS BIGINT) AS pos0 FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM {_TURNS_SQL})
    WHERE substr(text, i, length(pattern)) = pattern""",
)
def fm_search_turns(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    index = fm_index.build_fm_index(turns, "key", "text")
    found = fm_index.locate(index, fm_index.backward_search(index, turns.where("text <> ''"), "pattern"))
    return found.select("key.conv_id", "key.turn", "pattern", "pos0")


@query(
    "suffix_offsets_turns",
    f"""WITH r AS MATERIALIZED (SELECT conv_id, turn, p, length(text) + 1 AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY substr(text, p + 1)) - 1 AS rank, substr(text, p + 1) AS suffix, pattern
      FROM (SELECT *, unnest(range(0, length(text) + 1)) AS p FROM {_TURNS_SQL}))
    SELECT h.conv_id, h.turn, h.pattern, CAST(h.rank AS BIGINT) AS rank, CAST(min((h.p - s.p + h.n) % h.n) AS INTEGER) AS steps
    FROM r h JOIN r s ON s.conv_id = h.conv_id AND s.turn = h.turn AND s.rank % 10 = 0
    WHERE starts_with(h.suffix, h.pattern) AND h.suffix <> '' GROUP BY h.conv_id, h.turn, h.pattern, h.rank""",
)
def suffix_offsets_turns(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    index = fm_index.build_fm_index(turns, "key", "text")
    found = fm_index.backward_search(index, turns.where("text <> ''"), "pattern")
    steps = fm_index.suffix_offsets(index, found, 10)
    return steps.select("key.conv_id", "key.turn", "pattern", "rank", F.col("offset").alias("steps"))


@query(
    "border_array_turns",
    """SELECT conv_id, turn, CAST(max(z) AS INTEGER) AS longest, CAST(max(CASE WHEN p + z = length(text) THEN z ELSE 0 END) AS INTEGER) AS last FROM (
    SELECT *, CASE WHEN substr(text, p + 1, 1) = left(text, 1) AND p < length(text)
      THEN list_max(list_filter(range(1, length(text) - p + 1), lambda l: left(text, l) = substr(text, p + 1, l))) ELSE 0 END AS z
    FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS p FROM conversations)) GROUP BY conv_id, turn""",
)
def border_array_turns(spark, sf_dir):
    found = borders.border_arrays(_turns(spark, sf_dir).select("key", "text"), "key", "text")
    both = found.groupBy("key").agg(F.max("border").cast("int").alias("longest"), F.max_by("border", "pos0").cast("int").alias("last"))
    return both.select("key.conv_id", "key.turn", "longest", "last")


_PIECES_SQL = """(SELECT DISTINCT conv_id, turn, substr(text, 1 + (k * 53) % length(text), 1 + k * k * 3) AS pattern
    FROM (SELECT conv_id, turn, text, unnest(range(1, 13)) AS k FROM conversations WHERE text <> ''))"""


@query(
    "pattern_intervals_turns",
    f"""SELECT p.conv_id, p.turn, pattern, CAST(1 + count(*) FILTER (a < pattern) AS BIGINT) AS lo, CAST(1 + count(*) FILTER (a < pattern OR starts_with(a, pattern)) AS BIGINT) AS hi
    FROM {_PIECES_SQL} p JOIN (SELECT conv_id, turn, substr(text, i) AS a FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations)) s
    ON s.conv_id = p.conv_id AND s.turn = p.turn GROUP BY p.conv_id, p.turn, pattern""",
)
def pattern_intervals_turns(spark, sf_dir):
    """Up to twelve patterns per text, of 1 to 433 characters."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''").select(F.struct("conv_id", "turn").alias("key"), "text")
    k = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k")
    cut = F.substring("text", (1 + F.col("k") * 53 % F.length("text")).cast("int"), 1 + F.col("k") * F.col("k") * 3)
    pieces = turns.select("key", "text", k).select("key", cut.alias("pattern"))
    found = fm_index.pattern_intervals(turns, "key", "text", pieces, "pattern")
    return found.select("key.conv_id", "key.turn", "pattern", "lo", "hi")


@query(
    "suffix_array_turns",
    """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY substr(text, p + 1)) - 1 AS BIGINT) AS rank, CAST(p AS BIGINT) AS pos0
    FROM (SELECT conv_id, turn, text, unnest(range(0, length(text))) AS p FROM conversations)""",
)
def suffix_array_turns(spark, sf_dir):
    return suffix.suffix_array(_turns(spark, sf_dir), "key", "text").select("key.conv_id", "key.turn", "rank", "pos0")


@query(
    "longest_repeat_turns",
    """WITH s AS (SELECT conv_id, turn, substr(text, p + 1) AS a FROM (SELECT conv_id, turn, text, unnest(range(0, length(text))) AS p FROM conversations)),
    n AS (SELECT *, lag(a) OVER (PARTITION BY conv_id, turn ORDER BY a) AS b FROM s),
    l AS (SELECT conv_id, turn, a, coalesce(list_max(list_filter(range(1, 1 + CASE WHEN left(a, 20) = left(b, 20) THEN least(length(a), length(b)) ELSE least(20, length(b)) END),
      lambda i: left(a, i) = left(b, i))), 0) AS lcp FROM n WHERE b IS NOT NULL),
    t AS (SELECT conv_id, turn, left(a, lcp) AS substring, row_number() OVER (PARTITION BY conv_id, turn ORDER BY lcp DESC, a) AS r FROM l)
    SELECT c.conv_id, c.turn, coalesce(substring, '') AS substring FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn AND r = 1""",
)
def longest_repeat_turns(spark, sf_dir):
    return repeats.longest_repeat(_turns(spark, sf_dir), "key", "text", 2).select("key.conv_id", "key.turn", "substring")


_NODES_SQL = f"""WITH subs AS (SELECT DISTINCT seq_id, substr(seq, p + 1, n) AS w, substr(seq, p + 1 + n, 1) AS nxt FROM (
    SELECT seq_id, seq, p, unnest(range(1, length(seq) - p + 1)) AS n FROM {_SUFFIXES_SQL})),
    nodes AS (SELECT seq_id, w, CAST(length(w) AS BIGINT) AS depth, max(CASE WHEN nxt = '' THEN 32 - length(w) END) AS terminal FROM subs GROUP BY seq_id, w
      HAVING count(*) FILTER (nxt <> '') > 1 OR bool_or(nxt = '')),
    tree AS (SELECT n.seq_id, n.w, n.depth, n.terminal, coalesce(max(a.depth), 0) AS parent_depth, count(a.depth) AS branch_depth FROM nodes n
      LEFT JOIN nodes a ON a.seq_id = n.seq_id AND a.depth < n.depth AND starts_with(n.w, a.w) GROUP BY n.seq_id, n.w, n.depth, n.terminal)"""


@query(
    "suffix_tree",
    _NODES_SQL
    + """ SELECT seq_id, depth, CAST(parent_depth AS BIGINT) AS parent_depth, CAST(branch_depth AS BIGINT) AS branch_depth,
    CAST(terminal AS BIGINT) AS terminal, substr(w, parent_depth + 1) AS label FROM tree""",
)
def tree_of_suffixes(spark, sf_dir):
    df = parts(spark, sf_dir)
    labelled = suffix_tree.edge_labels(suffix_tree.suffix_tree(df, "seq_id", "seq"), df, "seq_id", "seq")
    return labelled.select("seq_id", "depth", "parent_depth", "branch_depth", "terminal", "label")


@query(
    "tree_stats",
    _NODES_SQL
    + """ SELECT seq_id, count(*) AS nodes, CAST(max(depth - parent_depth) AS BIGINT) AS edge_max, CAST(quantile_disc(depth - parent_depth, 0.5) AS BIGINT) AS edge_q50,
    CAST(quantile_disc(depth - parent_depth, 0.95) AS BIGINT) AS edge_q95, CAST(max(branch_depth) AS BIGINT) AS branch_max,
    CAST(quantile_disc(branch_depth, 0.25) AS BIGINT) AS branch_q25 FROM tree GROUP BY seq_id""",
)
def tree_statistics(spark, sf_dir):
    stats = suffix_tree.tree_stats(suffix_tree.suffix_tree(parts(spark, sf_dir), "seq_id", "seq"), "seq_id")
    whole = ["edge_max", "edge_q50", "edge_q95", "branch_max", "branch_q25"]
    return stats.select("seq_id", "nodes", *[F.col(c).cast("bigint").alias(c) for c in whole])


_TURN_LCPS_SQL = """WITH s AS (SELECT conv_id, turn, p, substr(text, p + 1) AS a FROM (SELECT conv_id, turn, text, unnest(range(0, length(text))) AS p FROM conversations)),
    n AS (SELECT *, row_number() OVER w - 1 AS r, lag(a) OVER w AS b FROM s WINDOW w AS (PARTITION BY conv_id, turn ORDER BY a)),
    l AS MATERIALIZED (SELECT conv_id, turn, p, r, length(a) AS size, CASE WHEN b IS NULL THEN -1 ELSE coalesce(list_max(list_filter(range(1, 1 + CASE WHEN left(a, 20) = left(b, 20)
      THEN least(length(a), length(b)) ELSE least(20, length(b)) END), lambda i: left(a, i) = left(b, i))), 0) END AS lcp FROM n)"""


@query(
    "suffix_tree_turns",
    _TURN_LCPS_SQL
    + """, runs AS (SELECT x.conv_id, x.turn, x.r, any_value(x.lcp) AS d, max(y.r) FILTER (y.r < x.r) AS lo, coalesce(min(y.r) FILTER (y.r > x.r), 1000000) AS hi
      FROM l x JOIN l y ON y.conv_id = x.conv_id AND y.turn = x.turn AND y.lcp < x.lcp WHERE x.lcp > 0 GROUP BY x.conv_id, x.turn, x.r),
    nodes AS MATERIALIZED (SELECT conv_id, turn, lo, hi, d FROM runs GROUP BY ALL),
    inner_nodes AS (SELECT n.conv_id, n.turn, n.d AS depth, coalesce(max(u.d), 0) AS parent_depth, count(u.d) AS branch_depth, n.lo FROM nodes n
      LEFT JOIN nodes u ON u.conv_id = n.conv_id AND u.turn = n.turn AND u.lo <= n.lo AND u.hi >= n.hi AND u.d < n.d GROUP BY n.conv_id, n.turn, n.lo, n.hi, n.d),
    leaves AS (SELECT x.conv_id, x.turn, x.size AS depth, coalesce(max(u.d), 0) AS parent_depth, count(u.d) AS branch_depth, x.r FROM l x
      LEFT JOIN nodes u ON u.conv_id = x.conv_id AND u.turn = x.turn AND u.lo <= x.r AND x.r < u.hi GROUP BY x.conv_id, x.turn, x.size, x.r
      HAVING coalesce(max(u.d), 0) < x.size),
    tree AS (SELECT i.conv_id, i.turn, depth, parent_depth, branch_depth, CASE WHEN x.size = depth THEN x.p END AS terminal, x.p FROM inner_nodes i
      JOIN l x ON x.conv_id = i.conv_id AND x.turn = i.turn AND x.r = i.lo
      UNION ALL SELECT v.conv_id, v.turn, depth, parent_depth, branch_depth, x.p, x.p FROM leaves v JOIN l x ON x.conv_id = v.conv_id AND x.turn = v.turn AND x.r = v.r)
    SELECT t.conv_id, t.turn, CAST(depth AS BIGINT) AS depth, CAST(parent_depth AS BIGINT) AS parent_depth, CAST(branch_depth AS BIGINT) AS branch_depth,
    CAST(terminal AS BIGINT) AS terminal, substr(text, p + parent_depth + 1, 1) AS first_char FROM tree t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn""",
)
def suffix_tree_turns(spark, sf_dir):
    """Trees of whole texts, with the first character of every edge."""
    turns = _turns(spark, sf_dir).select("key", "text")
    tree = suffix_tree.suffix_tree(turns, "key", "text", first_char=True)
    return tree.select("key.conv_id", "key.turn", "depth", "parent_depth", "branch_depth", "terminal", "first_char")


@query(
    "common_substring_turns",
    """WITH shortest AS (SELECT conv_id, arg_min(turn, {'n': length(text), 't': turn}) AS turn FROM conversations GROUP BY conv_id),
    p AS (SELECT c.conv_id, c.turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations c JOIN shortest USING (conv_id, turn)),
    o AS (SELECT conv_id, list(text) AS others FROM conversations GROUP BY conv_id),
    n AS (SELECT p.conv_id, substr(text, i) AS a, list_filter(others, lambda t: NOT contains(t, substr(text, i, 6))) = [] AS deep, others FROM p JOIN o ON o.conv_id = p.conv_id),
    m AS (SELECT conv_id, a, coalesce(list_max(list_filter(range(1, 1 + CASE WHEN deep THEN length(a) ELSE least(5, length(a)) END),
      lambda k: list_filter(others, lambda t: NOT contains(t, left(a, k))) = [])), 0) AS k FROM n)
    SELECT g.conv_id, coalesce(substring, '') AS substring FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN
    (SELECT conv_id, arg_min(left(a, k), {'k': -k, 'a': left(a, k)}) AS substring FROM m GROUP BY conv_id) f USING (conv_id)""",
)
def common_substring_turns(spark, sf_dir):
    """What all turns of a conversation share."""
    return repeats.common_substring(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn")


_NEXT_TURNS_SQL = "(SELECT c.conv_id, c.turn, c.text AS a, d.text AS b FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1)"


@query(
    "lcs_turns",
    f"""WITH p AS (SELECT conv_id, turn, a, b, unnest(range(1, length(a) + 1)) AS i FROM {_NEXT_TURNS_SQL}),
    m AS (SELECT conv_id, turn, i, substr(a, i) AS s, coalesce(list_max(list_filter(range(1, 1 + CASE WHEN contains(b, substr(a, i, 8)) THEN length(a) - i + 1 ELSE least(7, length(a) - i + 1) END),
      lambda k: contains(b, substr(a, i, k)))), 0) AS k FROM p)
    SELECT x.conv_id, x.turn, coalesce(lcs, '') AS lcs FROM {_NEXT_TURNS_SQL} x LEFT JOIN
    (SELECT conv_id, turn, arg_min(left(s, k), {{'k': -k, 'i': i}}) AS lcs FROM m GROUP BY conv_id, turn) f USING (conv_id, turn)""",
)
def lcs_turns(spark, sf_dir):
    """What each turn shares with the next one."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    pairs = turns.join(after, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("a"), "b")
    return repeats.common_substring_pair(pairs, "key", "a", "b").select("key.conv_id", "key.turn", F.col("substring").alias("lcs"))


@query(
    "longest_repeat",
    f"""SELECT seq_id, arg_min(w, {{'l': -length(w), 'w': w}}) AS substring FROM (SELECT seq_id, w FROM (
    SELECT seq_id, substr(seq, p + 1, n) AS w FROM (SELECT seq_id, seq, p, unnest(range(1, 33 - p)) AS n FROM {_SUFFIXES_SQL})) GROUP BY seq_id, w HAVING count(*) >= 2) GROUP BY seq_id""",
)
def longest_repeat(spark, sf_dir):
    return repeats.longest_repeat(parts(spark, sf_dir), "seq_id", "seq", 2)


@query(
    "common_substring",
    f"""SELECT p_brand, coalesce(arg_min(w, {{'l': -length(w), 'w': w}}) FILTER (c = n), '') AS substring FROM (
    SELECT s.p_brand, w, count(*) AS c, any_value(n) AS n FROM (SELECT DISTINCT p_brand, p_partkey, substr(seq, p + 1, m) AS w FROM (
      SELECT p_brand, p_partkey, seq, p, unnest(range(1, 65 - p)) AS m FROM (SELECT p_brand, p_partkey, {key_dna_sql('p_partkey', 0, 2)} AS seq, unnest(range(0, 64)) AS p FROM part))
    ) s JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) t ON s.p_brand = t.p_brand GROUP BY s.p_brand, w) GROUP BY p_brand""",
)
def common_substring(spark, sf_dir):
    df = part_keys(spark, sf_dir, "p_brand").select("p_brand", "p_partkey", key_dna("p_partkey", 0, 2).alias("seq"))
    return repeats.common_substring(df, "p_brand", "seq", "p_partkey")


@query(
    "lcs_pair",
    f"""SELECT seq_id, arg_min(w, {{'l': -length(w), 'p': p}}) AS lcs FROM (SELECT seq_id, b, p, substr(a, p + 1, n) AS w FROM (
    SELECT seq_id, a, b, p, unnest(range(1, 33 - p)) AS n FROM (SELECT seq_id, a, b, unnest(range(0, 32)) AS p FROM {_PAIRS}))) WHERE contains(b, w) GROUP BY seq_id""",
)
def lcs_pair(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seq_id", strings.longest_common_substring(F.col("a"), F.col("b")).alias("lcs"))


@query(
    "common_substring_fold",
    f"""WITH RECURSIVE w(seq_id, i, acc, x) AS (SELECT seq_id, 0, a, [b, reverse(a)] FROM {_PAIRS} UNION ALL
    SELECT seq_id, i + 1, coalesce((SELECT arg_min(s, {{'l': -length(s), 'p': p}}) FROM (SELECT p, substr(acc, p, n) AS s FROM
      (SELECT p, unnest(range(1, 34 - p)) AS n FROM (SELECT unnest(range(1, 33)) AS p)) WHERE p + n - 1 <= length(acc)) WHERE contains(x[i + 1], s)), ''), x FROM w WHERE i < 2)
    SELECT seq_id, acc AS lcs FROM w WHERE i = 2""",
)
def common_substring_fold(spark, sf_dir):
    texts = F.array("a", "b", F.reverse("a"))
    return _pairs(spark, sf_dir).select("seq_id", repeats.common_substring_fold(texts).alias("lcs"))


# ---- tries ---------------------------------------------------------------------------------

_TRIE_SQL = f"""(SELECT prefix, 1 + row_number() OVER (ORDER BY length(prefix), prefix) AS id FROM (
    SELECT DISTINCT left(seq, n) AS prefix FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS n FROM {parts_sql()})))"""


@query(
    "trie_edges",
    f"""SELECT CAST(coalesce(u.id, 1) AS BIGINT) AS parent, CAST(t.id AS BIGINT) AS child, right(t.prefix, 1) AS symbol FROM {_TRIE_SQL} t
    LEFT JOIN {_TRIE_SQL} u ON u.prefix = left(t.prefix, length(t.prefix) - 1)""",
)
def trie_edges(spark, sf_dir):
    return trie.trie_edges(parts(spark, sf_dir), "seq")


@query(
    "trie_descendants",
    f"SELECT prefix AS spelled, CAST(id AS BIGINT) AS node FROM {_TRIE_SQL} WHERE length(prefix) <= 4 AND NOT starts_with(prefix, 'G')",
)
def trie_descendants(spark, sf_dir):
    edges = checkpointed(trie.trie_edges(parts(spark, sf_dir), "seq"))
    root = spark.createDataFrame([(1, "")], "node bigint, context string")

    def spell(context):
        spelled = F.concat(context, F.col("symbol"))
        return F.when((F.length(spelled) <= 4) & ~F.startswith(spelled, F.lit("G")), spelled)

    found = traversal.descendants(edges, root, "parent", "child", spell)
    return found.select(F.col("context").alias("spelled"), "node")


@query(
    "trie_ancestors",
    f"""SELECT CAST(t.id AS BIGINT) AS origin, CAST(coalesce(u.id, 1) AS BIGINT) AS node, CAST(length(t.prefix) - n AS INTEGER) AS steps FROM (
    SELECT prefix, id, unnest(range(0, length(prefix))) AS n FROM {_TRIE_SQL}) t LEFT JOIN {_TRIE_SQL} u ON u.prefix = left(t.prefix, n)""",
)
def trie_ancestors(spark, sf_dir):
    """From every node up to the root."""
    return trie.trie_ancestors(parts(spark, sf_dir), "seq")


_NAMES_SQL = "(SELECT p_partkey AS i, p_name AS s FROM part)"


@query(
    "compact_trie",
    f"""WITH pre AS (SELECT DISTINCT left(s, n) AS w FROM (SELECT s, unnest(range(1, length(s) + 1)) AS n FROM {_NAMES_SQL})),
    nodes AS (SELECT w FROM pre WHERE w IN (SELECT s FROM {_NAMES_SQL}) OR (SELECT count(*) FROM pre q WHERE length(q.w) = length(pre.w) + 1 AND starts_with(q.w, pre.w)) > 1),
    up AS (SELECT n.w, coalesce(arg_max(a.w, length(a.w)), '') AS parent FROM nodes n LEFT JOIN nodes a ON length(a.w) < length(n.w) AND starts_with(n.w, a.w) GROUP BY n.w)
    SELECT w AS string, parent, substr(w, length(parent) + 1) AS label, (SELECT max(i) FROM {_NAMES_SQL} t WHERE t.s = w) AS str_index FROM up""",
)
def compact_trie(spark, sf_dir):
    return trie.compact_trie(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    "dictionary_lookup",
    f"""SELECT q AS lookup, (SELECT max(i) FROM {_NAMES_SQL} t WHERE t.s = q) AS str_index FROM (
    SELECT DISTINCT p_name AS q FROM part UNION SELECT left(p_name, 6) FROM part UNION SELECT p_type FROM part)""",
)
def dictionary_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.select(F.explode(F.array("p_name", F.left("p_name", F.lit(6)), "p_type")).alias("lookup")).distinct()
    return trie.dictionary_lookup(part, "p_partkey", "p_name", queries, "lookup")


# ---- alignment -----------------------------------------------------------------------------


@query("edit_distance", f"SELECT seq_id, CAST(levenshtein(a, b) AS BIGINT) AS distance FROM {_PAIRS}")
def edit_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select("seq_id", alignment.edit_distance(F.col("a"), F.col("b")).alias("distance"))


def _align_sql(gap: int, miss: int, score: int, fit: bool) -> str:
    """Row after row of the alignment matrix; a run of inserts is a prefix minimum."""
    head = "0" if fit else f"(i + 1) * {gap}"
    best = "min(row[33])" if fit else "min(row[33]) FILTER (i = 32)"
    return f"""WITH RECURSIVE m(seq_id, a, b, i, row) AS (
    SELECT seq_id, a, b, 0, list_transform(range(0, 33), lambda j: j * {gap}) FROM {_PAIRS} UNION ALL
    SELECT seq_id, a, b, i + 1, list_transform(range(0, 33), lambda j: j * {gap} + list_min(list_slice(t, 1, j + 1))) FROM (
      SELECT seq_id, a, b, i, list_transform(range(0, 33), lambda j: CASE WHEN j = 0 THEN {head} ELSE
        least(row[j] + CASE WHEN a[i + 1] = b[j] THEN {-score} ELSE {miss} END, row[j + 1] + {gap}) END - j * {gap}) AS t FROM m WHERE i < 32))
    SELECT seq_id, CAST({best} AS BIGINT) AS penalty, TRUE AS valid FROM m GROUP BY seq_id"""


def _aligned(spark, sf_dir, gap, miss):
    a, b = F.col("a"), F.col("b")
    found = _pairs(spark, sf_dir).withColumn("r", alignment.global_alignment(a, b, gap, miss))
    honest = alignment.penalty_of_edits(F.col("r.edits"), gap, miss) == F.col("r.penalty")
    return found.select("seq_id", "r.penalty", (honest & alignment.is_edit(a, b, F.col("r.edits"))).alias("valid"))


@query("global_alignment", f"SELECT seq_id, CAST(levenshtein(a, b) AS BIGINT) AS penalty, TRUE AS valid FROM {_PAIRS}")
def global_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir, 1, 1)


@query("global_alignment_weighted", _align_sql(2, 3, 0, fit=False))
def global_alignment_weighted(spark, sf_dir):
    return _aligned(spark, sf_dir, 2, 3)


@query("fitting_alignment", _align_sql(2, 2, 1, fit=True))
def fitting_alignment(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    found = _pairs(spark, sf_dir).withColumn("r", alignment.fitting_alignment(a, b, 2, 2, 1))
    edits = F.col("r.edits")
    inside = alphabet.slice_(a, F.col("r.start0"), F.col("r.end0"))
    honest = alignment.penalty_of_edits(edits, 2, 2, 1) == F.col("r.penalty")
    return found.select("seq_id", "r.penalty", (honest & alignment.is_edit(inside, b, edits)).alias("valid"))


# ---- masses --------------------------------------------------------------------------------


@query("protein_mass", f"SELECT seq_id, CAST({_MASS_OF_PROTEIN_SQL} AS BIGINT) AS mass_e5 FROM (SELECT seq_id, {_protein_sql('seq')} AS protein FROM {documents_sql()})")
def protein_mass(spark, sf_dir):
    protein = polymer.translate_rna(polymer.transcribe(F.col("seq")), strict=False)
    return documents(spark, sf_dir).select("seq_id", mass.protein_mass_e5(protein).alias("mass_e5"))


_PRICE_MASS_SQL = "(SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) % 20000000 AS d FROM orders)"


def _price_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(F.col("o_totalprice") * 100).cast("bigint") % 20_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))


_NEAREST_SQL = f"""(SELECT o_orderkey, d, arg_min(residue, {{'x': abs(d - mass_e5), 'm': -mass_e5, 'i': -ord}}) AS residue, min(abs(d - mass_e5)) AS off
    FROM {_PRICE_MASS_SQL}, (SELECT residue, mass_e5, ascii(residue) AS ord FROM {_MASSES_SQL}) GROUP BY o_orderkey, d)"""


@query("nearest_residue", f"SELECT o_orderkey, residue FROM {_NEAREST_SQL}")
def nearest_residue(spark, sf_dir):
    near = mass.nearest_residue(F.col("d"))
    return _price_masses(spark, sf_dir).select("o_orderkey", near["residue"].alias("residue"))


@query("residue_within", f"SELECT o_orderkey, CASE WHEN off <= 1000 THEN residue END AS residue FROM {_NEAREST_SQL}")
def residue_within(spark, sf_dir):
    return _price_masses(spark, sf_dir).select("o_orderkey", mass.residue_within(F.col("d")).alias("residue"))


def _prefix_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(seq_id, idx, mass)`: masses of all prefixes of each part's protein, the empty one first."""
    cut = _proteins(spark, sf_dir, 2).select(
        "seq_id", "protein", F.explode(F.sequence(F.lit(0), F.length("protein"))).alias("idx")
    )
    return cut.select("seq_id", F.col("idx").cast("bigint").alias("idx"), mass.protein_mass_e5(F.left("protein", F.col("idx"))).alias("mass"))


@query("prefix_spectrum", f"SELECT seq_id, replace(protein, 'I', 'L') AS protein FROM {_proteins_sql(2)} WHERE length(protein) > 0")
def prefix_spectrum(spark, sf_dir):
    return spectrum.spectrum_protein(_prefix_masses(spark, sf_dir), "seq_id", "idx", "mass")


_ENDS_SQL = f"""(SELECT DISTINCT seq_id, total, unnest([1000 + pre, 2000 + total - pre]) AS m FROM (
    SELECT seq_id, i, {_MASS_OF_PROTEIN_SQL} AS pre, total FROM (
    SELECT seq_id, i, left(whole, i) AS protein, total FROM (SELECT seq_id, protein AS whole, {_MASS_OF_PROTEIN_SQL} AS total, unnest(range(0, length(protein) + 1)) AS i FROM {_proteins_sql(1)}))))"""


def _end_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(seq_id, idx, mass, parent)`: masses of all prefixes and suffixes, each with a fixed
    offset of its own, ascending."""
    protein = F.col("protein")
    pre = mass.protein_mass_e5(F.left(protein, F.col("i")))
    cut = _proteins(spark, sf_dir).select("seq_id", "protein", F.explode(F.sequence(F.lit(0), F.length(protein))).alias("i"))
    cut = cut.select("seq_id", mass.protein_mass_e5(protein).alias("total"), pre.alias("pre"))
    both = F.array(F.col("pre") + 1000, F.col("total") - F.col("pre") + 2000)
    ends = cut.select("seq_id", "total", F.explode(both).alias("mass")).distinct()
    return ends.select("seq_id", F.col("mass").alias("idx"), "mass", (F.col("total") + 3000).alias("parent"))


_EDGES_SQL = f"""(SELECT x.seq_id, x.m AS m1, y.m AS m2, max(residue) AS residue FROM {_ENDS_SQL} x JOIN {_ENDS_SQL} y ON x.seq_id = y.seq_id AND y.m > x.m
    JOIN {_MASSES_SQL} ON abs(y.m - x.m - mass_e5) <= 1000 GROUP BY x.seq_id, x.m, y.m)"""


@query("spectrum_edges", f"SELECT seq_id, CAST(m1 AS BIGINT) AS m1, CAST(m2 AS BIGINT) AS m2, residue FROM {_EDGES_SQL}")
def spectrum_edges(spark, sf_dir):
    return spectrum.spectrum_edges(_end_masses(spark, sf_dir), "seq_id", "mass")


@query(
    "spectrum_longest_path",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES_SQL}), w(seq_id, m, path) AS (SELECT DISTINCT seq_id, m, '' FROM {_ENDS_SQL}
    UNION SELECT w.seq_id, e.m2, w.path || e.residue FROM w JOIN e ON e.seq_id = w.seq_id AND e.m1 = w.m)
    SELECT seq_id, arg_min(path, {{'l': -length(path), 'p': path}}) AS protein FROM w GROUP BY seq_id""",
)
def spectrum_longest_path(spark, sf_dir):
    return spectrum.spectrum_longest_path(_end_masses(spark, sf_dir), "seq_id", "mass")


@query(
    "full_spectrum",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT seq_id, list(m ORDER BY m) AS ms, any_value(total) + 3000 AS parent FROM {_ENDS_SQL} GROUP BY seq_id),
    w(seq_id, ms, parent, i, base, taken, protein) AS (SELECT seq_id, ms, parent, 1, ms[1], [ms[1]], '' FROM s UNION ALL
    SELECT seq_id, ms, parent, i + 1, CASE WHEN ok THEN m ELSE base END, CASE WHEN ok THEN list_append(taken, m) ELSE taken END, CASE WHEN ok THEN protein || residue ELSE protein END FROM (
      SELECT *, residue IS NOT NULL AND len(list_filter(taken, lambda t: abs(m - (parent - t)) <= 1000)) = 0 AS ok FROM (
        SELECT w.*, ms[i + 1] AS m, (SELECT max(residue) FROM {_MASSES_SQL} WHERE abs(ms[i + 1] - base - mass_e5) <= 1000) AS residue FROM w WHERE i < len(ms))))
    SELECT seq_id, protein FROM w WHERE i = len(ms)""",
)
def full_spectrum(spark, sf_dir):
    return spectrum.full_spectrum_protein(_end_masses(spark, sf_dir), "seq_id", "idx", "mass", "parent")


# ---- genetics and counting -------------------------------------------------------------------


@query(
    "rabbits",
    """WITH RECURSIVE r(k, n, last, now) AS (SELECT k, 2, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM range(0, 4) t(k)
    UNION ALL SELECT k, n + 1, now, now + k * last FROM r WHERE n < 50)
    SELECT p_partkey, CAST(CASE WHEN p_size <= 2 THEN 1 ELSE now END AS BIGINT) AS pairs FROM part JOIN r ON r.k = p_partkey % 4 AND r.n = greatest(p_size, 2)""",
)
def rabbits(spark, sf_dir):
    n, k = F.col("p_size").cast("bigint"), F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", genetics.rabbits(n, k).alias("pairs"))


@query(
    "mortal_rabbits",
    """WITH RECURSIVE r(m, n, ages) AS (SELECT m, 1, list_concat([CAST(1 AS BIGINT)], list_transform(range(1, m), lambda x: CAST(0 AS BIGINT))) FROM range(2, 7) t(m)
    UNION ALL SELECT m, n + 1, list_concat([CAST(list_sum(ages) - ages[1] AS BIGINT)], ages[1:m - 1]) FROM r WHERE n < 50)
    SELECT p_partkey, CAST(list_sum(ages) AS BIGINT) AS pairs FROM part JOIN r ON r.m = 2 + p_partkey % 5 AND r.n = p_size""",
)
def mortal_rabbits(spark, sf_dir):
    n, m = F.col("p_size").cast("bigint"), 2 + F.col("p_partkey") % 5
    return table(spark, sf_dir, "part").select("p_partkey", genetics.mortal_rabbits(n, m).alias("pairs"))


_LETTERS_SQL = "(SELECT p_partkey, p_size % 3 AS k, list_sort(list_distinct(string_split(p_type, ''))) AS letters FROM part)"


@query(
    "words",
    f"""WITH RECURSIVE w(p_partkey, letters, k, n, word) AS (SELECT p_partkey, letters, k, 0, '' FROM {_LETTERS_SQL}
    UNION ALL SELECT p_partkey, letters, k, n + 1, word || unnest(letters) FROM w WHERE n < k) SELECT p_partkey, word FROM w WHERE n = k""",
)
def words(spark, sf_dir):
    letters = F.array_sort(F.array_distinct(alphabet.chars(F.col("p_type"))))
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("k"), letters.alias("letters"))
    return genetics.words(df, "letters", F.col("k")).select("p_partkey", "word")


@query(
    "permutations",
    """WITH RECURSIVE w(p_partkey, k, p) AS (SELECT p_partkey, 1 + p_size % 4, CAST([] AS INTEGER[]) FROM part
    UNION ALL SELECT p_partkey, k, list_append(p, x) FROM (SELECT p_partkey, k, p, unnest(range(1, k + 1)) AS x FROM w WHERE len(p) < k) WHERE NOT list_contains(p, x))
    SELECT p_partkey, array_to_string(p, ' ') AS permutation FROM w WHERE len(p) = k""",
)
def permutations(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") % 4).alias("k"))
    out = genetics.permutations(df, F.col("k"))
    return out.select("p_partkey", F.array_join(F.col("permutation").cast("array<string>"), " ").alias("permutation"))


#: Genotypes are whole numbers in base three, a locus per digit.
_GENOTYPES_SQL = "(SELECT p_partkey AS seq_id, translate(to_base({}, 3), '012', 'DHR') AS geno FROM part)"


def _gametes_sql(number: str) -> str:
    """One locus after the other; the last one varies fastest."""
    return f"""(WITH RECURSIVE g(seq_id, i, geno, gamete, n) AS (SELECT seq_id, 0, geno, '', CAST(0 AS BIGINT) FROM {_GENOTYPES_SQL.format(number)} UNION ALL
    SELECT seq_id, i + 1, geno, gamete || a, n * len(l) + o FROM (SELECT *, unnest(l) AS a, unnest(range(0, len(l))) AS o FROM (
      SELECT *, CASE WHEN geno[i + 1] = 'H' THEN ['D', 'R'] ELSE [geno[i + 1]] END AS l FROM g WHERE i < length(geno))))
    SELECT seq_id, n, gamete FROM g WHERE i = length(geno))"""


def _genotype(number: str):
    return F.translate(F.conv(F.col(number).cast("string"), 10, 3), "012", "DHR")


@query("gametes", f"SELECT seq_id, CAST(n AS INTEGER) AS n, gamete FROM {_gametes_sql('p_partkey')}")
def gametes(spark, sf_dir):
    rows = part_keys(spark, sf_dir).select(F.col("p_partkey").alias("seq_id"), _genotype("p_partkey").alias("geno"))
    return genetics.gamete_rows(rows, "geno").select("seq_id", "n", "gamete")


@query(
    "cross",
    f"""SELECT x.seq_id, CAST(x.n * c + y.n AS INTEGER) AS n, array_to_string(list_transform(range(1, least(length(x.gamete), length(y.gamete)) + 1),
      lambda i: CASE WHEN x.gamete[i] = y.gamete[i] THEN x.gamete[i] ELSE 'H' END), '') AS offspring
    FROM {_gametes_sql('p_partkey')} x JOIN (SELECT *, count(*) OVER (PARTITION BY seq_id) AS c FROM {_gametes_sql('p_size')}) y ON x.seq_id = y.seq_id""",
)
def cross(spark, sf_dir):
    """Over the loci that both genotypes have."""
    rows = part_keys(spark, sf_dir, "p_size").select(F.col("p_partkey").alias("seq_id"), _genotype("p_partkey").alias("a"), _genotype("p_size").alias("b"))
    return genetics.offspring_rows(rows, "a", "b").select("seq_id", "n", "offspring")


_NATION_COUNTS_SQL = """(SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_mktsegment = 'MACHINERY') AS b,
    count(*) FILTER (c_mktsegment = 'FURNITURE') AS c, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS d, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS e FROM customer GROUP BY c_nationkey)"""


def _nation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"a": "BUILDING", "b": "MACHINERY", "c": "FURNITURE", "d": "HOUSEHOLD", "e": "AUTOMOBILE"}
    counts = [F.count_if(F.col("c_mktsegment") == v).alias(k) for k, v in names.items()]
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(*counts)


@query(
    "dominant_probability",
    f"""SELECT c_nationkey, CAST(round(CASE WHEN t > 1 THEN (a / t * (a - 1) / (t - 1) + 2 * a / t * (b + c) / (t - 1) + b / t * (b - 1) / (t - 1) * 0.75 + b / t * c / (t - 1)) END * 1000000) AS BIGINT) AS p_e6,
    CAST(round(2 * (a + b + c + d * 0.75 + e * 0.5) * 1000) AS BIGINT) AS expected_e3 FROM (SELECT *, CAST(a + b + c AS DOUBLE) AS t FROM {_NATION_COUNTS_SQL})""",
)
def dominant_probability(spark, sf_dir):
    a, b, c, d, e = (F.col(x) for x in "abcde")
    return _nation_counts(spark, sf_dir).select(
        "c_nationkey",
        scaled(genetics.dominant_phenotype_probability(a, b, c)).alias("p_e6"),
        scaled(genetics.expected_dominant(a, b, c, d, e), 1000).alias("expected_e3"),
    )


@query(
    "binomial",
    """WITH RECURSIVE pascal(n, row) AS (SELECT 0, [CAST(1 AS DOUBLE)] UNION ALL
    SELECT n + 1, list_transform(range(0, n + 2), lambda k: CASE WHEN k = 0 OR k = n + 1 THEN 1 ELSE row[k] + row[k + 1] END) FROM pascal WHERE n < 64)
    SELECT p_partkey, CAST(CASE WHEN k > p_size THEN 0 ELSE x.row[k + 1] END AS BIGINT) AS choose,
    CAST(round(CASE WHEN k > p_size THEN 0 ELSE x.row[k + 1] * pow(0.25, k) * pow(0.75, p_size - k) END * 1000000) AS BIGINT) AS pmf_e6,
    CAST(round(list_sum(list_transform(range(tail, CAST(pow(2, g) AS BIGINT) + 1), lambda i: exp(lgamma(pow(2, g) + 1) - lgamma(i + 1) - lgamma(pow(2, g) - i + 1)
      + i * ln(0.25) + (pow(2, g) - i) * ln(0.75)))) * 1000000) AS BIGINT) AS tail_e6
    FROM (SELECT p_partkey, p_size, p_partkey % 12 AS k, p_partkey % 15 AS g, p_partkey % CAST(1 + pow(2, p_partkey % 15) AS BIGINT) AS tail FROM part) JOIN pascal x ON x.n = p_size""",
)
def binomial(spark, sf_dir):
    n, k, g = F.col("p_size").cast("bigint"), F.col("p_partkey") % 12, F.col("p_partkey") % 15
    tail = F.col("p_partkey") % (1 + F.pow(F.lit(2), g).cast("bigint"))
    return part_keys(spark, sf_dir, "p_size").select(
        "p_partkey",
        F.round(genetics.choose(k=k, n=n)).cast("bigint").alias("choose"),
        scaled(genetics.binomial(p=F.lit(0.25), k=k, n=n)).alias("pmf_e6"),
        scaled(genetics.independent_alleles_tail(generation=g, at_least=tail)).alias("tail_e6"),
    )


@query("inner_nodes", "SELECT l_orderkey, count(*) - 2 AS inner_nodes FROM lineitem GROUP BY l_orderkey")
def inner_nodes(spark, sf_dir):
    leaves = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("leaves"))
    return leaves.select("l_orderkey", genetics.inner_nodes(F.col("leaves")).alias("inner_nodes"))


# ---- graphs, coverage, assembly ---------------------------------------------------------------

_ENDS6_SQL = f"(SELECT s.seq_id AS src, t.seq_id AS dst FROM {parts_sql()} s JOIN {parts_sql()} t ON right(s.seq, 6) = left(t.seq, 6) AND s.seq_id <> t.seq_id)"


@query("overlap_edges", f"SELECT src, dst FROM {_ENDS6_SQL}")
def overlap_edges(spark, sf_dir):
    return overlap.overlap_edges(parts(spark, sf_dir), "seq_id", "seq", 6)


@query(
    "overlap_degrees",
    f"""WITH s AS (SELECT seq_id, seq FROM {parts_sql()}), t AS (SELECT right(seq, 3) AS k, count(*) AS n FROM s GROUP BY 1), h AS (SELECT left(seq, 3) AS k, count(*) AS n FROM s GROUP BY 1)
    SELECT seq_id, CAST(coalesce(h.n, 0) - CASE WHEN left(seq, 3) = right(seq, 3) THEN 1 ELSE 0 END AS BIGINT) AS out_degree,
    CAST(coalesce(t.n, 0) - CASE WHEN left(seq, 3) = right(seq, 3) THEN 1 ELSE 0 END AS BIGINT) AS in_degree FROM s LEFT JOIN h ON h.k = right(seq, 3) LEFT JOIN t ON t.k = left(seq, 3)""",
)
def overlap_degrees(spark, sf_dir):
    return overlap.overlap_degrees(parts(spark, sf_dir), "seq_id", "seq", 3)


@query(
    "overlap_dot",
    f"""SELECT 1 AS part, '    "' || src || '" -> "' || dst || '" [label="6"];' AS value FROM {_ENDS6_SQL} UNION ALL SELECT 0, 'digraph G {{' UNION ALL SELECT 2, '}}'""",
)
def overlap_dot(spark, sf_dir):
    edges = overlap.overlap_edges(parts(spark, sf_dir), "seq_id", "seq", 6)
    edges = edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(6).alias("overlap"))
    return text.dot_lines(edges, "src", "dst", "overlap").select("part", "value")


_REACH_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS u, dst AS v FROM {_ENDS6_SQL} UNION SELECT dst, src FROM {_ENDS6_SQL}),
    r(node, other) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.other),
    c AS (SELECT node, min(other) AS component FROM r GROUP BY node)"""


def _overlap_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = parts(spark, sf_dir)
    return df.select(F.col("seq_id").alias("node")), overlap.overlap_stars(df, "seq_id", "seq", 6)


@query("connected_components", _REACH_SQL + " SELECT node, component FROM c")
def connected_components(spark, sf_dir):
    nodes, edges = _overlap_graph(spark, sf_dir)
    return components.connected_components(nodes, edges, "node", "src", "dst")


@query("edges_to_tree", "SELECT count(*) - 1 AS missing_edges FROM (SELECT DISTINCT n_nationkey FROM nation UNION ALL SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))")
def edges_to_tree(spark, sf_dir):
    """Customers and nations as one forest: each nation with its customers is a component."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    nodes = nations.union(customers.select("src"))
    return components.edges_to_tree(nodes, customers, "node", "src", "dst")


_READS_SQL = "(SELECT l_linenumber AS contig, l_partkey AS s, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads: few contigs, so that each one holds a large share of all rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("contig"), F.col("l_partkey").alias("start0"), F.col("l_quantity").cast("bigint").alias("len")
    )


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs that reach 100 bases beyond their last read."""
    end = F.max(F.col("start0") + F.col("len")) + 100
    return _reads(spark, sf_dir).groupBy("contig").agg(end.alias("genome_length"))


_DEPTH_SQL = f"(SELECT contig, p AS pos0, count(*) AS depth FROM (SELECT contig, unnest(range(s, s + n)) AS p FROM {_READS_SQL}) GROUP BY contig, p)"


@query("coverage", f"SELECT contig, CAST(pos0 AS BIGINT) AS pos0, CAST(depth AS BIGINT) AS depth FROM {_DEPTH_SQL}")
def coverage_depth(spark, sf_dir):
    return coverage.coverage(_reads(spark, sf_dir), block=256)


_SHORT_SQL = f"(SELECT DISTINCT contig, unnest(range(s, s + n - CAST(ceil(n * 0.1) AS BIGINT))) AS p FROM {_READS_SQL})"


@query("islands", f"SELECT contig, CAST(p AS BIGINT) AS pos0 FROM {_SHORT_SQL} x WHERE NOT EXISTS (SELECT 1 FROM {_SHORT_SQL} y WHERE y.contig = x.contig AND y.p = x.p - 1)")
def islands(spark, sf_dir):
    return coverage.islands(_reads(spark, sf_dir), theta=0.1, block=256)


@query(
    "coverage_stats",
    f"""WITH d AS (SELECT contig, count(*) AS covered, sum(depth) AS d1, sum(depth * depth) AS d2 FROM {_DEPTH_SQL} GROUP BY contig),
    r AS (SELECT contig, count(*) AS reads, sum(n) AS bases, max(s + n) + 100 AS g FROM {_READS_SQL} GROUP BY contig),
    i AS (SELECT contig, count(*) AS islands FROM {_SHORT_SQL} x WHERE NOT EXISTS (SELECT 1 FROM {_SHORT_SQL} y WHERE y.contig = x.contig AND y.p = x.p - 1) GROUP BY contig)
    SELECT r.contig, CAST(g AS BIGINT) AS genome_length, reads AS num_reads, covered AS bases_covered, CAST(round(bases / g * 1000) AS BIGINT) AS depth_e3,
    CAST(round((d2 - 2 * (bases / g) * d1 + (bases / g) * (bases / g) * g) / (g - 1) * 1000) AS BIGINT) AS var_e3, islands AS num_islands FROM r JOIN d ON d.contig = r.contig JOIN i ON i.contig = r.contig""",
)
def coverage_stats(spark, sf_dir):
    stats = coverage.coverage_stats(_reads(spark, sf_dir), _contigs(spark, sf_dir), theta=0.1, block=256)
    return stats.select(
        "contig", "genome_length", "num_reads", "bases_covered",
        scaled(F.col("avg_depth"), 1000).alias("depth_e3"), scaled(F.col("var_depth"), 1000).alias("var_e3"), "num_islands",
    )


@query(
    "stats_lines",
    f"""SELECT contig, unnest([{{'n': 0, 'v': 'num_reads: ' || reads}}, {{'n': 1, 'v': 'bases_covered: ' || covered}}], recursive := true) FROM (
    SELECT contig, count(*) AS reads FROM {_READS_SQL} GROUP BY contig) JOIN (SELECT contig AS c, count(*) AS covered FROM {_DEPTH_SQL} GROUP BY contig) ON c = contig""".replace("'v':", "'value':"),
)
def stats_lines(spark, sf_dir):
    stats = coverage.coverage_stats(_reads(spark, sf_dir), _contigs(spark, sf_dir), block=256)
    lines = text.stats_lines(stats, ["num_reads", "bases_covered"], ["contig"])
    return lines.select("contig", "n", "value")


def _shotgun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 48 bases at every 24th base of each part's 96 bases."""
    cut = F.array(*[F.substring("seq", i + 1, 48) for i in (0, 24, 48)])
    pieces = parts(spark, sf_dir, 3).select("seq_id", F.posexplode(cut).alias("i", "seq"))
    return pieces.select((F.col("seq_id") * 3 + F.col("i")).alias("read"), "seq")


@query("assemble", f"SELECT seq FROM {parts_sql(3)}")
def assemble(spark, sf_dir):
    return assembly.assemble(_shotgun(spark, sf_dir), "read", "seq", 20).contigs().select("seq")


@query("assembly_layout", "SELECT p_partkey * 3 + i AS read, p_partkey * 3 AS contig, CAST(24 * i AS BIGINT) AS \"offset\" FROM part, range(0, 3) t(i)")
def assembly_layout(spark, sf_dir):
    reads = _shotgun(spark, sf_dir)
    built = assembly.assemble(reads, "read", "seq", 20)
    return assembly.place_copies(built, reads, "read", "seq").select("read", "contig", "offset")


def _drawn_sql(*of: str) -> str:
    return f"CAST('0x' || substr(md5('1:' || {" || ':' || ".join(of)}), 1, 15) AS BIGINT)"


@query(
    "random_genomes",
    f"""SELECT p_partkey, CAST(pos // 40 AS BIGINT) AS block, string_agg(CASE WHEN (n >> 30) < 429496730 THEN CASE WHEN n % 2 = 0 THEN 'C' ELSE 'G' END
      WHEN n % 2 = 0 THEN 'A' ELSE 'T' END, '' ORDER BY pos) AS seq
    FROM (SELECT p_partkey, pos, {_drawn_sql('p_partkey', 'pos')} AS n FROM (SELECT p_partkey, unnest(range(0, 50 + p_size)) AS pos FROM part)) GROUP BY p_partkey, pos // 40""",
)
def random_genomes(spark, sf_dir):
    sizes = part_keys(spark, sf_dir, "p_size").select("p_partkey", (50 + F.col("p_size")).cast("bigint").alias("length"))
    return simulate.random_genomes(sizes, "p_partkey", "length", 0.4, 1, 40)


@query(
    "simulate_reads",
    f"""SELECT seq_id, read, start0, CAST(30 AS BIGINT) AS len, substr(seq, CAST(start0 + 1 AS BIGINT), 30) AS seq, read || ':' || (start0 + 1) || ':30' AS description
    FROM (SELECT seq_id, seq, CAST(read AS BIGINT) AS read, {_drawn_sql('seq_id', 'read')} % 66 AS start0 FROM (SELECT seq_id, seq, unnest(range(0, 8)) AS read FROM {parts_sql(3)}))""",
)
def simulate_reads(spark, sf_dir):
    return simulate.simulate_reads(parts(spark, sf_dir, 3), "seq_id", "seq", 30, 2.5, width=32)


@query(
    "histogram",
    """SELECT lang, CAST(round(avg(n) * 1000) AS BIGINT) AS mean_e3, CAST(max(n) AS BIGINT) AS "max", """
    + ", ".join(f"CAST(quantile_disc(n, {q}) AS BIGINT) AS q{round(q * 100):02d}" for q in diagnostics.QUANTILES)
    + " FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang",
)
def histogram(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    out = diagnostics.histogram(sizes, "n", ["lang"])
    whole = ["max"] + [f"q{round(q * 100):02d}" for q in diagnostics.QUANTILES]
    return out.select("lang", scaled(F.col("mean"), 1000).alias("mean_e3"), *[F.col(c).cast("bigint").alias(c) for c in whole])
