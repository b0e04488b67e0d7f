"""Registration of the scalar functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandloom.constants import CODON_BASES, CODON_RESIDUES, RESIDUE_MASS_E5
from strandloom.functions.strings import border_array

# Bodies are SQL expressions, so Catalyst inlines them like any other expression.
_FUNCTIONS = {
    "dna_complement(s STRING)": ("STRING", "translate(s, 'ACGT', 'TGCA')"),
    "transcribe(s STRING)": ("STRING", "translate(s, 'T', 'U')"),
    "reverse_complement(s STRING)": ("STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
    "gc_count(s STRING)": ("BIGINT", "length(s) - length(translate(s, 'CG', ''))"),
    "gc_content(s STRING)": ("DOUBLE", "try_divide(length(s) - length(translate(s, 'CG', '')), length(s))"),
    "find0(s STRING, t STRING)": ("INT", "CASE WHEN length(s) > 0 THEN nullif(instr(s, t), 0) - 1 END"),
    "seq_overlap(a STRING, b STRING)": (
        "INT",
        "CASE WHEN least(length(a), length(b)) = 0 THEN 0 ELSE coalesce(array_max("
        "filter(sequence(1, greatest(least(length(a), length(b)), 1)), n -> right(a, n) = left(b, n))), 0) END",
    ),
    "hamming_distance(a STRING, b STRING)": (
        "INT",
        "aggregate(zip_with(split(left(a, least(length(a), length(b))), ''), "
        "split(left(b, least(length(a), length(b))), ''), (x, y) -> CAST(x <> y AS INT)), 0, (acc, d) -> acc + d)",
    ),
    "translate_rna(s STRING)": (
        "STRING",
        "transform(array(array_join(transform(regexp_extract_all(s, '(?s)(...)', 1), c -> "
        f"CASE WHEN regexp_like(c, '^[{CODON_BASES}]{{3}}$') THEN substring('{CODON_RESIDUES}', 16 * (instr('{CODON_BASES}', left(c, 1)) - 1) "
        f"+ 4 * (instr('{CODON_BASES}', substring(c, 2, 1)) - 1) "
        f"+ instr('{CODON_BASES}', right(c, 1)), 1) ELSE '?' END), '')), r -> "
        "CASE WHEN contains(substring_index(r, '*', 1), '?') OR (length(s) % 3 <> 0 AND NOT contains(r, '*')) "
        "THEN CAST(raise_error(concat('not whole codons: ', s)) AS STRING) ELSE substring_index(r, '*', 1) END)[0]",
    ),
    "inner_nodes(leaves BIGINT)": ("BIGINT", "leaves - 2"),
    # By bisection: prefixes are equal up to some length and not beyond.
    "common_prefix_length(a STRING, b STRING)": (
        "INT",
        "aggregate(sequence(1, length(bin(least(length(a), length(b))))), named_struct('lo', 0, 'hi', least(length(a), length(b))), (s, i) -> "
        "CASE WHEN s.lo >= s.hi THEN s WHEN left(a, shiftright(s.lo + s.hi + 1, 1)) = left(b, shiftright(s.lo + s.hi + 1, 1)) "
        "THEN named_struct('lo', shiftright(s.lo + s.hi + 1, 1), 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', shiftright(s.lo + s.hi + 1, 1) - 1) END).lo",
    ),
    "kmers(s STRING, k INT)": ("ARRAY<STRING>", "regexp_extract_all(s, concat('(?s)(?=(.{', k, '}))'), 1)"),
    "splice(dna STRING, introns ARRAY<STRING>)": ("STRING", "aggregate(introns, dna, (s, i) -> replace(s, i, ''))"),
    "protein_mass_e5(protein STRING)": (
        "BIGINT", " + ".join(f"{m}L * (length(protein) - length(replace(protein, '{r}', '')))" for r, m in RESIDUE_MASS_E5.items())
    ),
    "dominant_probability(dominant BIGINT, het BIGINT, recessive BIGINT)": (
        "DOUBLE",
        "1 - try_divide(CAST(recessive * (recessive - 1) + recessive * het + het * (het - 1) / 4 AS DOUBLE), "
        "CAST((dominant + het + recessive) * (dominant + het + recessive - 1) AS DOUBLE))",
    ),
    "expected_dominant(dom_dom BIGINT, dom_het BIGINT, dom_rec BIGINT, het_het BIGINT, het_rec BIGINT)": (
        "DOUBLE", "2 * (dom_dom + dom_het + dom_rec + het_het * 0.75D + het_rec * 0.5D)"
    ),
    "rabbit_pairs(n BIGINT, k BIGINT)": (
        "BIGINT",
        "CASE WHEN n <= 2 THEN 1L ELSE aggregate(sequence(3L, greatest(n, 3L)), named_struct('last', 1L, 'now', 1L), "
        "(s, i) -> named_struct('last', s.now, 'now', s.now + k * s.last)).now END",
    ),
    "n_choose_k(n BIGINT, k BIGINT)": (
        "DOUBLE",
        "CASE WHEN k < 0 OR k > n THEN 0D WHEN least(k, n - k) = 0 THEN 1D ELSE aggregate(sequence(1L, greatest(least(k, n - k), 1L)), 1D, "
        "(acc, i) -> acc * (n - least(k, n - k) + i) / i) END",
    ),
    "binomial_pmf(n BIGINT, k BIGINT, p DOUBLE)": (
        "DOUBLE",
        "CASE WHEN k < 0 OR k > n THEN 0D WHEN least(k, n - k) = 0 THEN pow(p, k) * pow(1 - p, n - k) ELSE "
        "aggregate(sequence(1L, greatest(least(k, n - k), 1L)), 1D, (acc, i) -> acc * (n - least(k, n - k) + i) / i) * pow(p, k) * pow(1 - p, n - k) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for signature, (returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    spark.udf.register("border_array", border_array)
    return [s.split("(")[0] for s in _FUNCTIONS] + ["border_array"]
