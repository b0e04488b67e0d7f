"""Example vectors and random checks of the column functions.

The example strings and their published answers are fixed values.
"""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.functions import lit as L

from strandloom.functions import alignment as A
from strandloom.functions import alphabet as AL
from strandloom.functions import genetics as G
from strandloom.functions import mass as M
from strandloom.functions import polymer as P
from strandloom.functions import strings as S
from strandloom.functions.sql import register


def random_pairs(n, longest, seed=1):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("AB") for _ in range(k))
    return [(i, word(rng.randrange(longest)), word(rng.choice([0, 1, 3, 3, 5, 9]))) for i in range(n)]


def starts(s, t):
    return [i for i in range(len(s)) if s.startswith(t, i)]


def test_find(value):
    cases = [("abcd", "ijk", None), ("abcdijk", "ijk", 4), ("abcdijk", "abc", 0), ("abcdijk", "cdi", 2), ("", "", None), ("a", "", 0)]
    for s, t, expected in cases:
        assert value(S.find(L(s), L(t))) == expected


def test_positions_and_replace(value):
    assert value(S.positions(L("ijkabcdijk"), L("ijk"))) == [0, 7]
    assert value(S.positions(L("AAA"), L("AA"))) == [0, 1]
    assert value(S.positions(L("AAA"), L(""))) == [0, 1, 2]
    assert value(S.positions(L(""), L(""))) == []
    assert value(S.positions(L("a.b."), L("."))) == [1, 3]
    assert value(S.positions(L("x\\Ey\\E"), L("\\E"))) == [1, 4]
    assert value(S.replace_all(L("abcdabcd"), L("bc"), L("lmn"))) == "almndalmnd"
    assert value(S.replace_all(L("abcd"), L(""), L("x"))) == "abcd"
    assert value(S.regex_positions1(L("NASTNNSTNPSA"), "N[^P][ST][^P]")) == [1, 5, 6]


def test_overlap_lcp_lcs(value):
    for a, b, n in [("uioefgh", "ijk", 0), ("uioefghabcd", "abcdefghijk", 4), ("abcd", "abcd", 4), ("", "a", 0)]:
        assert value(S.overlap(L(a), L(b))) == n
    for a, b, p in [("abcdefghijk", "abcd", "abcd"), ("abcd", "abcdefghijk", "abcd"), ("abcd", "defghijk", "")]:
        assert value(S.lcp(L(a), L(b))) == p
    assert value(S.longest_common_substring(L("abcdefghijk"), L("uioefghijlm"))) == "efghij"
    assert value(S.longest_common_substring(L("BABAABABAA"), L("BBAABAAAAB"))) == "BAABA"


def test_border_array(value):
    text, expected = "aababbabbbabbaabaaa", [0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 2, 3, 4, 2, 2]
    assert value(S.border_array(L(text))) == expected
    assert value(S.border_array_simple(L(text))) == expected


def test_maximal_prefix(value):
    cases = [("ABA", 3, True, [0, 3, 5], 5), ("BAA", 3, True, [1, 6], 6), ("AAA", 2, False, [2, 7], 7)]
    for t, length, full, positions, pos0 in cases:
        r = value(S.maximal_prefix_matches(L("ABAABABAA"), L(t)))
        assert (r.length, r.full, r.positions, r.pos0) == (length, full, positions, pos0)


def test_windows_count_code_points(value):
    assert value(S.kmers(L("a\U0001f600b\nc"), 3)) == ["a\U0001f600b", "\U0001f600b\n", "b\nc"]
    assert value(S.windows(L("abcd"), 3)) == ["abc", "bcd", "cd", "d"]


def test_random_strings_agree_with_definition(spark):
    rows = random_pairs(2000, 20)
    df = spark.createDataFrame(rows, "i int, s string, t string")
    s, t = F.col("s"), F.col("t")
    got = df.select(
        "s", "t", S.positions(s, t).alias("p"), S.count_occurrences(s, t).alias("n"), S.lcp(s, t).alias("lcp"),
        S.overlap(s, t).alias("o"), S.longest_common_substring(s, t).alias("lcs"), S.hamming(s, t).alias("h"),
        S.border_array(s).alias("b"),
    ).collect()
    for r in got:
        a, b = r.s, r.t
        assert r.p == starts(a, b) and r.n == len(r.p)
        m = min(len(a), len(b))
        assert r.lcp == a[: max(k for k in range(m + 1) if a[:k] == b[:k])]
        assert r.o == max(k for k in range(m + 1) if k == 0 or a[-k:] == b[:k])
        assert r.h == sum(x != y for x, y in zip(a, b))
        shared = [a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
        assert r.lcs == max(shared, key=len, default="")
        assert r.b == [max(k for k in range(i) if a[:k] == a[i - k : i]) for i in range(1, len(a) + 1)]


def test_alphabet(value, spark):
    table = AL.alphabet_table(spark).where("alphabet = 'rna'").orderBy("ord").collect()
    assert [r.symbol for r in table] == list("ACGU")
    codons = {r.codon: r.residue for r in P.codon_table(spark).collect()}
    assert len(codons) == 64 and (codons["AUG"], codons["UGA"], codons["GGG"]) == ("M", "*", "G")
    got = P.codon_table(spark).select("residue", P.codon_residue(F.col("codon")).alias("r")).collect()
    assert all(r.residue == r.r for r in got) and value(P.codon_residue(L("AU"))) is None
    assert value(AL.parse(L("ACGT"), "dna")) == "ACGT"
    assert value(AL.parse(L("ACGU"), "dna", strict=False)) is None
    with pytest.raises(PySparkException):
        value(AL.parse(L("ACG\n"), "dna"))
    assert value(AL.symbol_index(L("G"), "dna")) == 2 and value(AL.symbol_index(L("U"), "dna")) is None
    assert value(AL.symbol_index(L("$"), "dna", "first")) == 0 and value(AL.symbol_index(L("#"), "dna", "last")) == 4
    assert value(AL.symbol_at(L(3), "rna")) == "U"
    assert value(AL.sort_chars(L("IDX="), "edit")) == "=XID"
    assert value(AL.slice_(L("abcdef"), 1, 3)) == "bc" and value(AL.slice_(L("abc"), 1)) == "bc"
    assert value(AL.slice_inclusive(L("abcdef"), 1, 3)) == "bcd" and value(AL.slice_(L("abc"), None, 2)) == "ab"
    assert value(AL.char_at(L("abc"), L(0))) == "a" and value(AL.char_at(L("abc"), L(3))) is None


def test_translation(value):
    assert value(P.translate_rna(L("AUGGCCAUGGCGCCCAGAACUGAGAUCAAUAGUACCCGUAUUAACGGGUGA"))) == "MAMAPRTEINSTRING"
    assert value(P.translate_rna(L("UGAA"))) == ""
    assert value(P.translate_rna(L("AUGA"), strict=False)) == "M"
    with pytest.raises(PySparkException):
        value(P.translate_rna(L("AUGA")))
    assert value(P.reverse_complement(L("AAAACCCGGT"))) == "ACCGGGTTTT"
    assert value(P.splice(L("ATGCATG"), L(["TG", "AC"]))) == "A"
    assert value(P.mrna_count(L("MA"))) == 12
    assert value(P.gc_content(L(""))) is None
    assert math.isclose(value(P.log10_probability(L("ACGATACAA"), L(0.129))), -5.7373919, rel_tol=1e-6)


def test_masses(value):
    assert math.isclose(value(M.protein_mass(L("SKADYEK"))), 821.39192)
    assert value(M.nearest_residue(L(11308406)))["residue"] == "L"
    middle = (5702146 + 7103711 + 1) // 2
    assert value(M.nearest_residue(L(middle)))["residue"] == "A"
    assert value(M.residue_within(L(11308406 + 1000))) == "L" and value(M.residue_within(L(11308406 + 1001))) is None


def test_genetics(value, spark):
    assert value(G.gametes(L(["D", "H"]))) == [["D", "D"], ["D", "R"]]
    assert value(G.gametes(L(["H", "H"]))) == [["D", "D"], ["D", "R"], ["R", "D"], ["R", "R"]]
    assert value(G.cross(G.gametes(L(["H"])), G.gametes(L(["H"])))) == [["D"], ["H"], ["H"], ["R"]]
    assert value(G.cross(L([["D", "R"]]), L([["D", "D"], ["R", "D"]]))) == [["D", "H"], ["H", "H"]]
    assert value(G.mix_gametes(L(["D", "R", "R"]), L(["D"]))) == ["D"]
    assert math.isclose(value(G.dominant_phenotype_probability(L(30), L(18), L(19))), 0.8280189959294437)
    assert value(G.expected_dominant(*map(L, [17433, 19239, 17282, 17006, 16887]))) == 150304.0
    assert math.isclose(value(G.independent_alleles_tail(generation=L(6), at_least=L(19))), 0.23176258105462277)
    assert value(G.rabbits(L(31), L(3))) == 47079164257 and value(G.mortal_rabbits(L(82), L(16))) == 60467010349760561
    assert value(G.choose(k=L(3), n=L(7))) == 35.0 and value(G.choose(k=L(8), n=L(7))) == 0.0
    assert value(G.inner_nodes(L(4))) == 2
    df = spark.createDataFrame([(list("ABC"),)], "letters array<string>")
    got = [r.word for r in G.words(df, "letters", L(3), 3).collect()]
    assert got == ["".join(w) for w in itertools.product("ABC", repeat=3)]
    got = [tuple(r.permutation) for r in G.permutations(df, L(4), 4).collect()]
    assert got == list(itertools.permutations([1, 2, 3, 4]))
    with pytest.raises(Exception, match="more than 2"):
        G.permutations(df, L(11), 2).count()
    ragged = spark.createDataFrame([(list("AB"), 1), (list("AB"), 5)], "letters array<string>, k int")
    assert G.words(ragged, "letters", F.col("k")).count() == 2 + 32
    assert G.permutations(ragged, F.col("k")).count() == 1 + 120


def test_tail_of_late_generations(value):
    for g, least in [(12, 1), (13, 1), (12, 1024), (14, 4096), (0, 1), (2, 0)]:
        n = 2**g
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.25) + (n - i) * math.log(0.75) for i in range(least, n + 1)]
        want = math.fsum(math.exp(t) for t in terms)
        assert math.isclose(value(G.independent_alleles_tail(generation=L(g), at_least=L(least))), want, rel_tol=1e-7)


def exact_tail(g, least):
    """Whole numbers only: the sum of the binomial terms times 4^n."""
    n = 2**g
    term, tail, total = 3**n, 0, 4**n
    for i in range(n + 1):
        tail += term if i >= least else 0
        term = term * (n - i) // (i + 1) // 3
    return tail / total if total.bit_length() < 1000 else (tail >> (2 * n - 300)) / 2**300


def expanded_tail(g, least):
    """Normal approximation with the correction for skewness, right to about 1 / n."""
    n = 2**g
    deviation = math.sqrt(3 * n / 16)
    z = (least - 0.5 - n / 4) / deviation
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return 0.5 * math.erfc(z / math.sqrt(2)) + 0.5 / deviation * (z * z - 1) / 6 * density


def test_tail_of_any_generation(spark):
    rows = [(g, k, exact_tail(g, k)) for g in (1, 6, 11, 13, 14) for n in [2**g] for k in (0, 1, 2, n // 4 - 3, n // 4, n // 4 + 1, n // 4 + 60, n // 2, n, n + 1)]
    for g in range(20, 61, 5):
        n, deviation = 2**g, math.isqrt(3 * 2**g // 16)
        rows += [(g, k, expanded_tail(g, k)) for k in (n // 4 - 5 * deviation, n // 4 - deviation, n // 4, n // 4 + deviation // 3, n // 4 + 3 * deviation)]
        rows += [(g, k, 1.0) for k in (-1, 0, 1, 2, n // 8)] + [(g, k, 0.0) for k in (n // 2, n, n + 1)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, want double")
    got = df.select("*", G.independent_alleles_tail(generation=F.col("g"), at_least=F.col("k")).alias("got")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.got - r.want) <= 1e-6 and (r.g > 14 or r.want < 1e-100 or math.isclose(r.got, r.want, rel_tol=1e-8)), r


def test_positions_outside_the_basic_plane(value):
    assert value(S.regex_positions1(L("a😀b"), ".")) == [1, 2, 3]
    assert value(S.regex_positions1(L("😀ab😀ab"), "ab")) == [2, 5]
    assert value(S.border_array_simple(L(""))) == []


def test_sql_translation_checks_its_codons(spark):
    register(spark)
    assert spark.sql("SELECT translate_rna('AUGGCCUGA'), translate_rna('UGAA')").first() == ("MA", "")
    for wrong in ("NNN", "NAU", "AUGA"):
        with pytest.raises(Exception, match="not whole codons"):
            spark.sql(f"SELECT translate_rna('{wrong}')").collect()


def test_alignment_vectors(value):
    for x, y, penalty, edits in [("abcdabcd", "abcaadcd", 2, "===X=X=="), ("abcdbc", "acdabcd", 3, "=D==I==I"), ("bcdabcd", "abcdbbcd", 2, "I===X===")]:
        r = value(A.global_alignment(L(x), L(y)))
        assert (r.penalty, r.edits) == (penalty, edits)
        assert value(A.is_edit(L(x), L(y), L(edits))) and not value(A.is_edit(L(x), L(y), L(edits + "D")))
    cases = [
        ("abcdabcd", "cdab", 1, -4, 2, 6, "===="), ("abcd", "abcd", 1, -4, 0, 4, "===="), ("abcdabcd", "cdcbc", 1, -3, 2, 7, "==X=="),
        ("abcdabcd", "dcdaba", 2, -2, 2, 6, "I====I"), ("abcdabcd", "cdbc", 2, -3, 2, 7, "==D=="),
    ]
    for x, y, mismatch, *expected in cases:
        r = value(A.fitting_alignment(L(x), L(y), mismatch=mismatch))
        assert [r.penalty, r.start0, r.end0, r.edits] == expected


def full_matrix(x, y, gap, miss, score, fit):
    c = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            options = []
            if i and j:
                options.append(c[i - 1][j - 1] + (-score if x[i - 1] == y[j - 1] else miss))
            if i and (j or not fit):
                options.append(c[i - 1][j] + gap)
            if j:
                options.append(c[i][j - 1] + gap)
            c[i][j] = min(options, default=0)
    return min(row[-1] for row in c) if fit else c[-1][-1]


def test_random_alignments(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AB") for _ in range(rng.randrange(20)))
    rows = [(i, word(), word()) for i in range(300)] + [(300, "AB" * 60, "BA" * 45), (301, "A" * 7, "A" * 90)]
    df = spark.createDataFrame(rows, "i int, x string, y string")
    x, y = F.col("x"), F.col("y")
    for gap, miss in [(1, 1), (2, 3), (5, 1)]:
        both = df.withColumn("g", A.global_alignment(x, y, gap, miss)).withColumn("f", A.fitting_alignment(x, y, gap, miss, 2))
        part = AL.slice_(x, F.col("f.start0"), F.col("f.end0"))
        got = both.select(
            "*", A.is_edit(x, y, F.col("g.edits")).alias("g_ok"), A.is_edit(part, y, F.col("f.edits")).alias("f_ok"),
            A.penalty_of_edits(F.col("g.edits"), gap, miss).alias("g_sum"), A.penalty_of_edits(F.col("f.edits"), gap, miss, 2).alias("f_sum"),
        ).collect()
        for r in got:
            assert r.g_ok and r.f_ok and r.g_sum == r.g.penalty and r.f_sum == r.f.penalty
            assert r.g.penalty == full_matrix(r.x, r.y, gap, miss, 0, False)
            assert r.f.penalty == full_matrix(r.x, r.y, gap, miss, 2, True)


def test_sql_functions(spark):
    assert "reverse_complement" in register(spark)
    row = spark.sql(
        "SELECT translate_rna('AUGGCCUGA'), reverse_complement('AAC'), hamming_distance('abc', 'abd'), seq_overlap('xab', 'abz'), "
        "border_array('aab'), gc_content('GGCA'), find0('abc', 'c'), find0('', '')"
    ).first()
    assert tuple(row) == ("MA", "GTT", 1, 2, [0, 1, 0], 0.75, 2, None)


def test_sql_functions_equal_the_columns(spark):
    register(spark)
    rng = random.Random(16)
    texts = [("".join(rng.choice("AB") for _ in range(rng.randint(0, 30))), "".join(rng.choice("AB") for _ in range(rng.randint(0, 30)))) for _ in range(40)]
    rows = [(*pair, i % 7, i % 13 + 3) for i, pair in enumerate([*texts, ("", ""), ("abc", ""), ("same", "same"), ("x\ny", "x\nz")])]
    df = spark.createDataFrame(rows, "a string, b string, k bigint, n bigint")
    a, b, k, n = (F.col(c) for c in "abkn")
    pairs = {
        "common_prefix_length(a, b)": S.lcp_length(a, b),
        "kmers(a, 3)": S.kmers(a, 3),
        "splice(a, array('AB', 'B'))": P.splice(a, F.lit(["AB", "B"])),
        "protein_mass_e5(a)": M.protein_mass_e5(a),
        "dominant_probability(k, n, k + 1)": G.dominant_phenotype_probability(k, n, k + 1),
        "expected_dominant(k, n, k, n, k)": G.expected_dominant(k, n, k, n, k),
        "rabbit_pairs(n, k)": G.rabbits(n, k),
        "n_choose_k(n, k)": G.choose(k=k, n=n),
        "binomial_pmf(n, k, 0.3D)": G.binomial(p=F.lit(0.3), k=k, n=n),
        "hamming_distance(a, b)": S.hamming(a, b),
    }
    got = df.select(*(F.expr(x).alias(f"x{i}") for i, x in enumerate(pairs)), *(y.alias(f"y{i}") for i, y in enumerate(pairs.values()))).collect()
    for row in got:
        for i, name in enumerate(pairs):
            x, y = row[f"x{i}"], row[f"y{i}"]
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12)), (name, row)
