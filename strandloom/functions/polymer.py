"""Nucleotide and protein strings: transcription, translation, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.constants import ALPHABETS, CODON_BASES, CODON_RESIDUES, STOP
from strandloom.functions.alphabet import chars, let


def complement(dna: Column) -> Column:
    return F.translate(dna, "ACGT", "TGCA")


def transcribe(dna: Column) -> Column:
    return F.translate(dna, "T", "U")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(complement(dna))


def symbol_count(s: Column, symbol: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(symbol), F.lit("")))).cast("bigint")


def nucleotide_counts(dna: Column) -> Column:
    """Struct of the counts of A, C, G and T."""
    return F.struct(*[symbol_count(dna, b).alias(b.lower()) for b in ALPHABETS["dna"]])


def gc_count(dna: Column) -> Column:
    return symbol_count(dna, "G") + symbol_count(dna, "C")


def gc_content(dna: Column) -> Column:
    """Share of G and C, NULL for the empty string."""
    return F.try_divide(gc_count(dna), F.length(dna))


def codon_table(spark: SparkSession) -> DataFrame:
    """The 64 codons with the residue each one codes for, `*` for stop."""
    rows = [
        (a + b + c, CODON_RESIDUES[16 * i + 4 * j + k])
        for i, a in enumerate(CODON_BASES)
        for j, b in enumerate(CODON_BASES)
        for k, c in enumerate(CODON_BASES)
    ]
    return spark.createDataFrame(rows, "codon string, residue string")


def _coded(codon: Column) -> Column:
    """Residue of three RNA bases, `*` for stop, `?` for anything else.

    The places of the bases (0 for none) are the digits of an index to base five: a few short
    searches, which cost less per codon than a map lookup or one long search.
    """
    bases = range(len(CODON_BASES) + 1)
    table = "".join(
        CODON_RESIDUES[16 * (i - 1) + 4 * (j - 1) + k - 1] if i and j and k else "?"
        for i in bases for j in bases for k in bases
    )
    digit = [F.instr(F.lit(CODON_BASES), F.substring(codon, n, 1)) for n in (1, 2, 3)]
    return F.substring(F.lit(table), digit[0] * 25 + digit[1] * 5 + digit[2] + 1, F.lit(1))


def codon_residue(codon: Column) -> Column:
    """Residue of an RNA codon or `*`; NULL if it is no codon."""
    return F.when(codon.rlike(rf"\A[{CODON_BASES}]{{3}}\z"), _coded(codon))


def translate_rna(rna: Column, strict: bool = True) -> Column:
    """Protein read from frame 0 up to the first stop; no search for a start codon.

    A partial codon is an error only if it is reached, that is, if no stop comes before it;
    with `strict=False` it is dropped.
    """
    codons = F.regexp_extract_all(rna, F.lit("(?s)(...)"), F.lit(1))
    residues = F.array_join(F.transform(codons, _coded), "")
    if not strict:
        return F.substring_index(residues, STOP, 1)

    def checked(all_residues: Column) -> Column:
        protein = F.substring_index(all_residues, STOP, 1)
        partial = (F.length(rna) % 3 != 0) & ~F.contains(all_residues, F.lit(STOP))
        wrong = F.raise_error(F.concat(F.lit("not whole codons: "), rna)).cast("string")
        return F.when(partial | F.contains(protein, F.lit("?")), wrong).otherwise(protein)

    return let(residues, checked)


def splice(dna: Column, introns: Column) -> Column:
    """Remove every occurrence of each intron of the array, one intron after the other."""
    return F.aggregate(introns, dna, lambda acc, intron: F.replace(acc, intron, F.lit("")))


def splice_translate(dna: Column, introns: Column, strict: bool = True) -> Column:
    return translate_rna(transcribe(splice(dna, introns)), strict)


def palindrome_sites(df: DataFrame, key: str, seq: str, shortest: int = 4, longest: int = 12) -> DataFrame:
    """Substrings equal to their reverse complement: `(key, pos1, length)`.

    Only even lengths can be: the middle base of an odd one would be its own complement.
    """
    window = F.regexp_extract_all(
        F.col(seq), F.lit(f"(?=(.{{{shortest},{longest}}}))"), F.lit(1)
    )
    lengths = F.lit([n for n in range(shortest, longest + 1) if n % 2 == 0])
    # The window is as long as `longest` allows, shorter only at the end of the sequence.
    spans = F.filter(
        lengths,
        lambda n: (n <= F.length("window")) & (F.left("window", n) == reverse_complement(F.left("window", n))),
    )
    return (
        df.select(key, F.posexplode(window).alias("pos0", "window"))
        .select(key, (F.col("pos0") + 1).cast("bigint").alias("pos1"), F.explode(spans).alias("length"))
    )


def mrna_count(protein: Column, modulus: int = 1_000_000) -> Column:
    """Number of RNA strings that translate to `protein` and a stop, reduced at each step."""
    ways = F.create_map(
        *[F.lit(x) for r in ALPHABETS["protein"] for x in (r, CODON_RESIDUES.count(r))]
    )
    return F.aggregate(
        chars(protein),
        F.lit(CODON_RESIDUES.count(STOP)).cast("bigint"),
        lambda acc, r: acc * F.element_at(ways, r) % modulus,
    )


def log10_probability(dna: Column, gc: Column) -> Column:
    """log10 of the chance that a random string of the given GC share equals `dna`.

    A sum of logarithms, so that long strings do not underflow.
    """
    at_count = F.length(dna) - gc_count(dna)

    def term(n: Column, p: Column) -> Column:
        return F.when(n > 0, n * F.coalesce(F.log10(p / 2), F.lit(float("-inf")))).otherwise(F.lit(0.0))

    return term(gc_count(dna), gc) + term(at_count, 1 - gc)

