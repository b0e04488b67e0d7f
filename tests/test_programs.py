"""Ready-made programs on small files."""

from __future__ import annotations

import pytest

from strandloom.plans.programs import PROGRAMS

CASES = [
    ("hamming-distance", "GAGCCTACTAACGGGAT\nCATCGTAATGACGGCCT\n", ["7"]),
    ("substring-positions", "GATATATGCATATACTT\nATAT\n", ["2 4 10"]),
    ("rabbits", "5 3\n", ["19"]),
    ("mortal-rabbits", "6 3\n", ["4"]),
    ("mrna-count", "MA\n", ["12"]),
    ("permutations", "2", ["2", "1 2", "2 1"]),
    ("words", "T A G C\n1\n", ["T", "A", "G", "C"]),
    ("overlap-graph", ">a\nAAATAAA\n>b\nAAATTTT\n>c\nTTTTCCC\n>d\nAAATCCC\n>e\nGGGTGGG\n", ["a b", "a d", "b c"]),
    ("longest-repeat", "ACACGTACACGT$\n2\n", ["ACACGT"]),
    ("edges-to-tree", "10\n1 2\n2 8\n4 10\n5 9\n6 10\n7 9\n", ["3"]),
    ("trie", "ATAGA\nATC\nGAT\n", ["1 2 A", "1 3 G", "2 4 T", "3 5 A", "4 6 A", "4 7 C", "5 8 T", "6 9 G", "9 10 A"]),
    ("expected-dominant", "1 0 0 1 0 1\n", ["3.5"]),
    ("dominant-probability", "2 2 2\n", ["0.7833333333333333"]),
    ("independent-alleles", "2 1\n", ["0.68359375"]),
    ("protein-mass", "SKADYEK\n", ["821.39192"]),
    ("prefix-spectrum", "3524.8542\n3710.9335\n3841.974\n3970.0326\n4057.0646\n", ["WMQS"]),
    ("full-spectrum", "1988.21104821\n610.391039105\n738.485999105\n766.492149105\n863.544909105\n867.528589105\n992.587499105\n995.623549105\n1120.6824591\n1124.6661391\n1221.7188991\n1249.7250491\n1377.8200091\n", ["KEKEP"]),
    ("nucleotide-counts", "AGCT TTTC\nA\n", ["2 2 1 4"]),
    ("highest-gc", ">x\nACGT\n>y\nGG\nCA\n>z\nGGCA\n", ["z", "75.0"]),
    ("failure-array", ">x\nCAGCATGGTATCACAGCAGAG\n", ["0 0 0 1 2 0 0 0 0 0 0 1 2 1 2 3 4 5 3 0 0"]),
    ("shared-motif", ">a\nGATTACA\n>b\nTAGACCA\n>c\nATACA\n", ["AC"]),
    ("protein-motif", ">p\nNASTNNSTNPSA\n>q\nAAAA\n", ["p", "1 5 6"]),
    ("reverse-complement", "AAAACC\nCGGT\n", ["ACCGGGTTTT"]),
    ("transcribe", "GATGGAACTT\n", ["GAUGGAACUU"]),
    ("translate", "AUGGCCAUGUGA\n", ["MAM"]),
    ("palindromes", ">x\nTCAATGCATGCGGGTCTATATGCAT\n", ["4 6", "5 4", "6 6", "7 4", "17 4", "18 4", "20 6", "21 4"]),
    ("splice-translate", ">d\nATGTTAATGA\n>i\nTTAA\n>j\nCC\n", ["M"]),
    ("read-statistics", ">0:1:3\nACG\n>1:9998:3\nACG\n", ["genome_length: 10000", "num_reads: 2", "bases_covered: 6"]),
]


@pytest.mark.parametrize("name,content,expected", CASES, ids=[c[0] for c in CASES])
def test_program(spark, tmp_path, name, content, expected):
    path = tmp_path / "input.txt"
    path.write_text(content)
    lines = [r.value for r in PROGRAMS[name](spark, str(path)).orderBy("n").collect()]
    assert lines[: len(expected)] == expected


def test_every_analysis_has_a_program():
    assert len(PROGRAMS) == 35
