"""Alphabets, genetic code, residue masses, edit codes.

All of these are published facts that results depend on; nothing here is derived.
"""

# Fixed values. Symbols of each alphabet, in sort order.
ALPHABETS = {
    "dna": "ACGT",
    "rna": "ACGU",
    "protein": "ACDEFGHIKLMNPQRSTVWY",
    "ab": "AB",
    "edit": "=XID",
}

# Fixed values. Sentinels: the first sorts before every letter, the second is
# declared to sort after every letter of the alphabet it extends.
SENTINEL_FIRST = "$"
SENTINEL_LAST = "#"

# Fixed value. The standard genetic code with bases in the order U, C, A, G
# (first base slowest); "*" marks a stop codon.
CODON_BASES = "UCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOP = "*"

# Fixed values. Monoisotopic residue masses in units of 1e-5 dalton.
MASS_SCALE = 100_000
RESIDUE_MASS_E5 = {
    "A": 7103711,
    "C": 10300919,
    "D": 11502694,
    "E": 12904259,
    "F": 14706841,
    "G": 5702146,
    "H": 13705891,
    "I": 11308406,
    "K": 12809496,
    "L": 11308406,
    "M": 13104049,
    "N": 11404293,
    "P": 9705276,
    "Q": 12805858,
    "R": 15610111,
    "S": 8703203,
    "T": 10104768,
    "V": 9906841,
    "W": 18607931,
    "Y": 16306333,
}
MASS_TOLERANCE_E5 = 1000

# Fixed value. N-glycosylation motif.
GLYCOSYLATION_MOTIF = "N[^P][ST][^P]"

# Fixed values. Genotype codes and the alleles each one passes on.
DOMINANT, RECESSIVE, HETEROZYGOUS = "D", "R", "H"
