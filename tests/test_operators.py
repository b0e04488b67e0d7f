"""Operators against brute force on small fixtures."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.operators import (
    assembly, components, consensus, coverage, diagnostics, fm_index, overlap, repeats, search, spectrum, suffix, suffix_tree, traversal, trie,
)
from strandloom.plans.ordering import blocked_running_sum, dense_index, ordered_concat
from strandloom.constants import RESIDUE_MASS_E5

RNG = random.Random(1)
TEXTS = ["ABAABABAA", "AAA", "A", "ABAABA", "A" * 40, "AB" * 50, ""]
TEXTS += ["".join(RNG.choice("AB") for _ in range(RNG.randint(1, 19))) for _ in range(50)]
TEXTS += ["".join(RNG.choice("AB") for _ in range(300))]


def starts(s, t):
    return {i for i in range(len(s)) if s.startswith(t, i)}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, s string")


def test_ordering_helpers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    assert all(r.place == r.v for r in dense_index(df, ["v"], "place").collect())
    sums = blocked_running_sum(df, ["g"], "v", "v", "total", width=16).collect()
    for g in range(3):
        seen = 0
        for r in sorted((r for r in sums if r.g == g), key=lambda r: r.v):
            seen += r.v
            assert r.total == seen
    joined = ordered_concat(df.select("g", "v", F.concat("v", F.lit(",")).alias("t")), ["g"], "v", "t", "all", width=16)
    for r in joined.collect():
        assert r["all"].split(",")[:-1] == [str(x.v) for x in sorted((x for x in sums if x.g == r.g), key=lambda x: x.v)]


def test_suffix_array_and_lcp(texts):
    index = suffix.build_suffix_index(texts, "k", "s")
    got = defaultdict(dict)
    for r in index.array.collect():
        got[r.k][r["rank"]] = r.pos0
    for k, t in enumerate(TEXTS):
        assert [got[k][i] for i in range(len(t))] == sorted(range(len(t)), key=lambda p: t[p:])
    for r in index.neighbours().collect():
        a, b = TEXTS[r.k][r.pos0 :], TEXTS[r.k][r.prev0 :]
        assert r.lcp == max(n for n in range(min(len(a), len(b)) + 1) if a[:n] == b[:n])


def tree_of(t):
    nodes = {t[i:] for i in range(len(t))}
    for w in {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}:
        if len({t[i + len(w)] for i in starts(t, w) if i + len(w) < len(t)}) > 1:
            nodes.add(w)
    out = []
    for w in nodes:
        above = [d for d in range(1, len(w)) if w[:d] in nodes]
        out.append((w, max(above, default=0), len(above), len(t) - len(w) if t.endswith(w) else None))
    return sorted(out, key=str)


def test_suffix_tree(texts):
    tree = suffix_tree.suffix_tree(texts, "k", "s")
    got = defaultdict(list)
    for r in suffix_tree.edge_labels(tree, texts, "k", "s").collect():
        word = TEXTS[r.k][r.pos0 : r.pos0 + r.depth]
        assert r.label == word[r.parent_depth :]
        got[r.k].append((word, r.parent_depth, r.branch_depth, r.terminal))
    for k, t in enumerate(TEXTS[:-1]):
        assert sorted(got[k], key=str) == tree_of(t)
    stats = suffix_tree.tree_stats(tree, "k").where("k = 0").first()
    assert stats.nodes == stats.edges == len(tree_of(TEXTS[0])) and stats.edge_max == 5


def test_fm_index(spark, texts):
    table = fm_index.bwt(texts, "k", "s")
    assert {r.k: r.bwt for r in fm_index.bwt_string(table, "k").where("k = 3").collect()} == {3: "ABBA$AA"}
    assert {r.k: r.seq for r in fm_index.bwt_inverse(table, "k").collect()} == dict(enumerate(TEXTS))
    index = fm_index.build_fm_index(texts, "k", "s", width=8)
    wanted = [(k, p) for k in range(len(TEXTS)) for p in ["", "A", "BAA", "ABA", "BBB", "ABAABA", "C"]]
    found = fm_index.backward_search(index, spark.createDataFrame(wanted, "k bigint, p string"), "p")
    hits = defaultdict(set)
    for r in fm_index.locate(index, found).collect():
        hits[r.k, r.pattern].add(r.pos0)
    assert all(hits[k, p] == starts(TEXTS[k], p) for k, p in wanted)
    found = found.where("k < 4")
    offsets = fm_index.suffix_offsets(index, found, 4)
    size = found.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]
    assert offsets.count() == size and offsets.where("rank % 4 = 0 AND offset <> 0").isEmpty()


def test_pattern_search(spark, texts, monkeypatch):
    monkeypatch.setattr("strandloom.operators.windows.BLOCK", 32)
    patterns = ["", "A", "AB", "ABABABABABABABABABA", "A" * 16, "A" * 17, "BBBB", "AB" * 20]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    hits = defaultdict(set)
    for r in search.find_patterns(texts, "k", "s", df, "p").collect():
        assert r.pos0 not in hits[r.k, r.pattern]
        hits[r.k, r.pattern].add(r.pos0)
    assert all(hits[k, p] == starts(t, p) for k, t in enumerate(TEXTS) for p in patterns)
    first = {(r.k, r.pattern): (r.pos0, r.hits) for r in search.first_occurrence(texts, "k", "s", df, "p").collect()}
    assert first == {key: (min(v), len(v)) for key, v in hits.items() if v}


@pytest.mark.parametrize("seed", [2, 16])
def test_patterns_of_any_length(spark, seed):
    """Nested patterns, shared beginnings, patterns longer than texts, wide characters; steps over windows of
    many lengths with the small seed."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 5, 60, 200)] + ["a" * 90, "😀a😀ab" * 9, None]
    patterns = ["a" * n for n in range(1, 40)] + [texts[4][i : i + n] for i in range(0, 150, 7) for n in (1, 2, 3, 16, 17, 31, 32, 50, 64)]
    patterns += ["b" * 33, "a" * 500, "😀", "a😀", "zz", "", None, "a", "ab😀a😀ab😀a😀ab😀a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    found = search.find_patterns(df, "k", "s", spark.createDataFrame([(p,) for p in patterns], "p string"), "p", seed).collect()
    want = [(k, p, i) for k, t in enumerate(texts) for p in {*patterns} - {None} for i in starts(t or "", p)]
    assert sorted(map(tuple, found)) == sorted(want)
    none = spark.createDataFrame([], "p string")
    assert search.find_patterns(df, "k", "s", none, "p", seed).collect() == search.first_occurrence(df, "k", "s", none, "p").collect() == []


def test_three_thousand_patterns_share_their_beginning(spark):
    """A place that has the shared letters is one row, not one per pattern."""
    rng = random.Random(12)
    head = "sixteen letters."
    tails = ["".join(rng.choice("acgt") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    text = "".join(head + t + rng.choice(["", "!", "acg"]) for t in tails[::3]) + head * 500
    df = spark.createDataFrame([(0, text), (1, head * 2000)], "k int, s string")
    patterns = spark.createDataFrame([(head + t,) for t in tails], "p string")
    known = search.build_patterns(patterns, "p")
    letters = sum(len(head + t) for t in {*tails})
    assert known.shorter.count() <= letters and known.ends.count() <= letters
    got = {(r.k, r.pattern): (r.pos0, r.hits) for r in search.first_occurrence(df, "k", "s", patterns, "p").collect()}
    want = {(0, head + t): (text.find(head + t), len(starts(text, head + t))) for t in {*tails} if head + t in text}
    assert got == want and len(want) >= 1000


def test_repeats(spark, texts):
    def longest(t, k):
        for n in range(len(t), 0, -1):
            often = [w for w, c in Counter(t[i : i + n] for i in range(len(t) - n + 1)).items() if c >= k]
            if often:
                return min(often)
        return ""

    for k in (2, 3):
        got = {r.k: r.substring for r in repeats.longest_repeat(texts, "k", "s", k).collect()}
        assert got == {i: longest(t, k) for i, t in enumerate(TEXTS)}
    rows = [(0, "abcXde"), (0, "abcYde"), (0, "deZ"), (1, "q"), (2, "GATTACA"), (2, "TAGACCA"), (2, "ATACA"), (3, "x"), (3, "y")]
    got = repeats.common_substring(spark.createDataFrame(rows, "g int, s string"), "g", "s").collect()
    assert {r.g: r.substring for r in got} == {0: "de", 1: "q", 2: "AC", 3: ""}
    fold = spark.range(1).select(repeats.common_substring_fold(F.lit(["abcXde", "abcYde", "deZ"]))).first()[0]
    assert fold == ""


def test_tries(spark):
    df = spark.createDataFrame([(0, "ABAA"), (1, "BABBA"), (2, "ABAA"), (3, "AB"), (4, "")], "i int, s string")
    edges = trie.trie_edges(df, "s")
    assert sorted(map(tuple, edges.collect())) == [
        (1, 2, "A"), (1, 3, "B"), (2, 4, "B"), (3, 5, "A"), (4, 6, "A"), (5, 7, "B"), (6, 8, "A"), (7, 9, "B"), (9, 10, "A"),
    ]
    assert sorted(map(tuple, trie.compact_trie(df, "i", "s").collect())) == [
        ("AB", "", "AB", 3), ("ABAA", "AB", "AA", 2), ("BABBA", "", "BABBA", 1),
    ]
    queries = spark.createDataFrame([("ABAA",), ("ABA",), ("BABBA",), ("BABBAA",)], "q string")
    found = trie.dictionary_lookup(df, "i", "s", queries, "q").collect()
    assert {r.q: r.str_index for r in found} == {"ABAA": 2, "ABA": None, "BABBA": 1, "BABBAA": None}
    root = spark.createDataFrame([(1, "")], "node bigint, context string")
    down = traversal.descendants(edges, root, "parent", "child", lambda c: F.when(F.length(c) < 3, F.concat(c, F.col("symbol"))))
    assert {r.context for r in down.collect()} == {"A", "B", "AB", "BA", "ABA", "BAB"}
    leaf = spark.createDataFrame([(8, "")], "node bigint, context string")
    up = traversal.ancestors(edges, leaf, "parent", "child", lambda c: F.concat(F.col("symbol"), c))
    assert {(r.node, r.context) for r in up.collect()} == {(6, "A"), (4, "AA"), (2, "BAA"), (1, "ABAA")}


def test_tries_of_long_strings(spark):
    """Many copies of a long string and one that leaves it late: a node per letter, not per copy and prefix."""
    rng = random.Random(13)
    long = "".join(rng.choice("ab") for _ in range(100_000))
    strings = [long] * 5 + [long[:99_990] + "c" * 5, long[:7], "b", "ba", "", None]
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    edges = trie.trie_edges(df, "s", block=1 << 12).collect()
    assert len(edges) == len({r.child for r in edges}) == 100_000 + 5 + (1 if long[0] == "a" else 0) + (0 if long[:2] == "ba" else 1)
    into = {r.child: r for r in edges}
    deepest = max(edges, key=lambda r: r.child)  # levels are numbered one after the other
    spelled, at = [], deepest.child
    while at != 1:
        spelled.append(into[at].symbol)
        at = into[at].parent
    assert "".join(reversed(spelled)) == long
    compact = {r.string: r for r in trie.compact_trie(df, "i", "s", block=4).collect()}
    assert compact[long].parent == long[:99_990] and compact[long].str_index == 4 and compact[long[:99_990]].str_index is None
    assert compact[long[:99_990]].parent == long[:7] and compact[long[:7]].str_index == 6 and compact["ba"].label in ("a", "ba")


def test_coverage(spark):
    rng = random.Random(3)
    reads = [(c, rng.randrange(300), rng.randrange(0, 40)) for c in (1, 2) for _ in range(30)] + [(1, 64, 64), (1, 127, 1), (2, 0, 500)]
    df = spark.createDataFrame(reads, "contig int, start0 bigint, len bigint")
    sizes = spark.createDataFrame([(1, 600), (2, 700), (3, 10)], "contig int, genome_length bigint")
    depth, short = defaultdict(Counter), defaultdict(set)
    for c, s, n in reads:
        depth[c].update(range(s, s + n))
        short[c].update(range(s, s + n - -(-n // 10)))
    for block in (8, 64, 1 << 16):
        got = defaultdict(dict)
        for r in coverage.coverage(df, block=block).collect():
            got[r.contig][r.pos0] = r.depth
        assert got == {c: dict(d) for c, d in depth.items() if d}
        found = {(r.contig, r.pos0) for r in coverage.islands(df, theta=0.1, block=block).collect()}
        assert found == {(c, p) for c in (1, 2) for p in short[c] if p - 1 not in short[c]}
        for r in coverage.coverage_stats(df, sizes, block=block).collect():
            d, g = depth[r.contig], r.genome_length
            mean = sum(d.values()) / g
            assert r.bases_covered == len(d) and abs(r.avg_depth - mean) < 1e-12
            assert abs(r.var_depth - sum((d[p] - mean) ** 2 for p in range(g)) / (g - 1)) < 1e-9
            assert r.num_islands == sum(c == r.contig for c, _ in found)


def test_consensus(spark):
    rows = [(0, 0, "ACGT"), (0, 1, "ACG"), (0, 2, "TCGTA"), (0, 3, "TTTT"), (1, 0, "G")]
    df = spark.createDataFrame(rows, "g int, i int, s string")
    assert {r.g: r.consensus for r in consensus.consensus(df, ["g"], "i", "s").collect()} == {0: "ACGT", 1: "G"}
    p = {r.pos0: (r.n_a, r.n_c, r.n_g, r.n_t) for r in consensus.profile(df, ["g"], "i", "s").where("g = 0").collect()}
    assert p == {0: (2, 0, 0, 2), 1: (0, 3, 0, 1), 2: (0, 0, 3, 1), 3: (0, 0, 0, 3)}


def test_overlap_graph(spark):
    rows = [(i, "".join(RNG.choice("AB") for _ in range(RNG.randint(2, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s string")
    want = {(a, b) for a, x in rows for b, y in rows if a != b and min(len(x), len(y)) >= 3 and x[-3:] == y[:3]}
    assert {tuple(r) for r in overlap.overlap_edges(df, "i", "s", 3).collect()} == want
    for r in overlap.overlap_degrees(df, "i", "s", 3).collect():
        assert r.out_degree == sum(a == r.i for a, _ in want) and r.in_degree == sum(b == r.i for _, b in want)


def test_components_over_hubs(spark):
    """A third of the records meet at one k-mer; edges stay linear and components are those of all pairs."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("ABCD") for _ in range(n))
    rows = [(i, "HUB" + word(4)) for i in range(80)] + [(i, word(4) + "HUB") for i in range(80, 160)] + [(i, word(rng.randint(2, 5))) for i in range(160, 400)]
    rows += [(400, "XYZXYZ"), (401, "QQQxYYY"), (402, "ZZZxYYY")]  # a loop, and two ends without a beginning
    df = spark.createDataFrame(rows, "i int, s string")
    stars = overlap.overlap_stars(df, "i", "s", 3)
    assert stars.count() <= 2 * len(rows)
    nodes = df.select("i")
    want = components.connected_components(nodes, overlap.overlap_edges(df, "i", "s", 3), "i", "src", "dst")
    got = components.connected_components(nodes, stars, "i", "src", "dst")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distributions(spark):
    rng = random.Random(15)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 300)) for _ in range(1000)] + [("one", 7), ("none", None)] + [("same", 3)] * 50
    df = spark.createDataFrame(rows, "g string, v int")
    for keys in (["g"], []):
        got = {r.g if keys else 0: r for r in diagnostics.histogram(df, "v", keys).collect()}
        for key in {g if keys else 0 for g, _ in rows}:
            values = sorted(v for g, v in rows if v is not None and (not keys or g == key))
            want = [values[-(-round(q * 100) * len(values) // 100) - 1] if values else None for q in diagnostics.QUANTILES]
            assert [got[key][f"q{round(q * 100):02d}"] for q in diagnostics.QUANTILES] == want
            assert got[key]["max"] == max(values, default=None) and (not values or abs(got[key]["mean"] - sum(values) / len(values)) < 1e-9)
    assert diagnostics.histogram(df.limit(0), "v", ["g"]).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    root = {i: i for i in range(350)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    nodes = spark.range(350).select(F.col("id").alias("n"))
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.n: r.component for r in components.connected_components(nodes, df, "n", "a", "b").collect()}
    assert got == {i: top(i) for i in range(350)}
    assert components.edges_to_tree(nodes, df, "n", "a", "b").first()[0] == len(set(got.values())) - 1


def scs(spark, strings, least):
    df = spark.createDataFrame(list(enumerate(strings)), "read bigint, seq string")
    built = assembly.assemble(df, "read", "seq", least)
    return built, df, sorted(r.seq for r in built.contigs().collect())


def test_assembly_vectors(spark):
    a, b, c = "uioefghabcd", "abcdefghijk", "ijklm"
    assert scs(spark, [a, b, c], 3)[2] == ["uioefghabcdefghijklm"]
    assert scs(spark, [a, b, b], 3)[2] == ["uioefghabcdefghijk"]
    assert scs(spark, [a, b], 5)[2] == sorted([a, b])


def best_overlap(x, y):
    return max(n for n in range(min(len(x), len(y)) + 1) if n == 0 or x[-n:] == y[:n])


def test_assembly_is_greedy(spark, monkeypatch):
    """Every rejected overlap is blocked by accepted ones at least as long."""
    monkeypatch.setattr(assembly, "_HUB_SHARE", 2)
    rng = random.Random(4)
    for size, letters in ((14, "AB"), (20, "ABCD")):
        reads = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(size)})
        built, _, contigs = scs(spark, reads, 2)
        layout = built.layout.collect()
        chains = defaultdict(list)
        for r in layout:
            chains[r.contig].append((r.offset, r.offset + r.length, r.read, r.overlap))
        after, joined, where = {}, {}, {}
        for contig, members in chains.items():
            members.sort()
            text = reads[members[0][2]]
            where.update({m[2]: (contig, i) for i, m in enumerate(members)})
            for (_, _, p, _), (_, _, q, n) in zip(members, members[1:]):
                assert n == best_overlap(reads[p], reads[q]) >= 2
                after[p], joined[q] = n, n
                text += reads[q][n:]
            assert text in contigs
        for p in range(len(reads)):
            for q in range(len(reads)):
                n = best_overlap(reads[p], reads[q])
                if p == q or n < 2 or (where[p][0] == where[q][0] and where[q][1] == where[p][1] + 1):
                    continue
                blocked = after.get(p, 0) >= n or joined.get(q, 0) >= n
                if not blocked and where[p][0] == where[q][0] and where[q][1] < where[p][1]:
                    inner = [m[3] for m in sorted(chains[where[p][0]])][where[q][1] + 1 : where[p][1] + 1]
                    blocked = min(inner) >= n
                assert blocked, (reads[p], reads[q], n)


def test_spectra(spark):
    masses = RESIDUE_MASS_E5
    proteins = ["WMQS", "GASPVTC", "KEKEP"]
    rows, mixed = [], []
    for k, p in enumerate(proteins):
        pre = [sum(masses[c] for c in p[:i]) for i in range(len(p) + 1)]
        rows += [(k, i, m) for i, m in enumerate(pre)]
        ends = sorted({1000 + m for m in pre} | {2000 + pre[-1] - m for m in pre})
        mixed += [(k, i, m, pre[-1] + 3000) for i, m in enumerate(ends)]
    df = spark.createDataFrame(rows, "k int, i bigint, m bigint")
    assert {r.k: r.protein for r in spectrum.spectrum_protein(df, "k", "i", "m").collect()} == dict(enumerate(proteins))
    df = spark.createDataFrame(mixed, "k int, i bigint, m bigint, full bigint")

    def residue(d):
        return next((c for c in sorted(masses, reverse=True) if abs(masses[c] - d) <= 1000), None)

    def greedy(k):
        full = next(r[3] for r in mixed if r[0] == k)
        ms = [r[2] for r in mixed if r[0] == k]
        base, taken, out = ms[0], [ms[0]], ""
        for m in ms[1:]:
            if not any(abs(m - (full - t)) <= 1000 for t in taken) and residue(m - base):
                out, base = out + residue(m - base), m
                taken.append(m)
        return out

    def longest(k):
        ms = sorted(r[2] for r in mixed if r[0] == k)
        best = {}
        for m in reversed(ms):
            options = [residue(n - m) + best[n] for n in ms if n > m and residue(n - m)]
            best[m] = min(options, key=lambda s: (-len(s), s), default="")
        return min(best.values(), key=lambda s: (-len(s), s))

    got = spectrum.full_spectrum_protein(df, "k", "i", "m", "full").collect()
    assert {r.k: r.protein for r in got} == {k: greedy(k) for k in range(len(proteins))}
    got = spectrum.spectrum_longest_path(df, "k", "m").collect()
    assert {r.k: r.protein for r in got} == {k: longest(k) for k in range(len(proteins))}


def test_fm_index_of_any_text(spark):
    """The sentinel is before every character, also those below `$` and `$` itself."""
    texts = ["to be or not to be", "cost $5 or $6", "a\nb\n\na", "!\"# $", "😀 $😀", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, s string")
    table = fm_index.bwt(df, "k", "s")
    assert {r.k: r.seq for r in fm_index.bwt_inverse(table, "k").collect()} == dict(enumerate(texts))
    index = fm_index.build_fm_index(df, "k", "s", width=4)
    wanted = [(k, p) for k, t in enumerate(texts) for p in {" ", "o be", "$", "t $5", "\n", "a", "😀", "x", *t[2:4]}]
    found = fm_index.backward_search(index, spark.createDataFrame(wanted, "k bigint, p string"), "p")
    got = {(r.k, r.pattern, r.pos0) for r in fm_index.locate(index, found).collect()}
    assert got == {(k, p, i) for k, p in set(wanted) for i in range(len(texts[k])) if texts[k].startswith(p, i)}


def test_longest_repeat_of_a_long_text(spark, monkeypatch):
    """10 000 letters, against sorted suffixes; small blocks, so that windows cross their borders."""
    text = "".join(random.Random(5).choices("AB", k=10_000))
    order = sorted(range(len(text)), key=lambda p: text[p : p + 200])
    near = [len(os.path.commonprefix([text[a : a + 200], text[b : b + 200]])) for a, b in zip(order, order[1:])]
    df = spark.createDataFrame([(1, text), (2, ""), (3, "A"), (4, "ABAB")], "k bigint, s string")
    monkeypatch.setattr(repeats._sliding_min, "__defaults__", (64,))
    for k in (2, 4):
        got = {r.k: r.substring for r in repeats.longest_repeat(df, "k", "s", k).collect()}
        least = [min(near[i : i + k - 1]) for i in range(len(near) - k + 2)]
        at = least.index(max(least))
        assert got == {1: text[order[at] : order[at] + least[at]], 2: "", 3: "", 4: "AB" if k == 2 else ""}


def test_ancestors_need_no_walk(spark, monkeypatch):
    """the nodes above every node come from counts, for strings of any length and blocks of any size."""
    rng = random.Random(27)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))),) for _ in range(60)] + [("ab" * 300,), ("ab" * 299 + "b",), (None,), ("a",), ("a",)]
    df = spark.createDataFrame(rows, "s string")
    above = {r.child: r.parent for r in trie.trie_edges(df, "s").collect()}
    want = set()
    for origin in above:
        node, steps = origin, 0
        while node != 1:
            node, steps = above[node], steps + 1
            want.add((origin, node, steps))
    monkeypatch.setattr(traversal, "_walk", None)
    for block in (7, 4096):
        got = [tuple(r) for r in trie.trie_ancestors(df, "s", block).collect()]
        assert len(got) == len(want) and set(got) == want
    assert trie.trie_ancestors(df.where("s IS NULL"), "s").count() == 0


def test_gametes_are_numbers(spark):
    """the same rows as from lists of letters, also of 19 loci and of unequal sizes, and no list of lists."""
    from strandloom.functions import genetics

    rows = [(0, "HDR", "H"), (1, "D", "RHH"), (2, "HHRH", "DHHH"), (3, "", "H"), (4, "R" * 17 + "HH", "H" + "D" * 18), (5, "H" + "R" * 17, "R" * 18), (6, None, "D")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    lists = [genetics.gametes(F.split(c, "")) for c in "ab"]
    for got, want, name in (
        (genetics.gamete_rows(df, "a"), df.select("k", F.posexplode(lists[0]).alias("n", "g")), "gamete"),
        (genetics.offspring_rows(df, "a", "b"), df.select("k", F.posexplode(genetics.cross(*lists)).alias("n", "g")), "offspring"),
    ):
        assert sorted(map(tuple, got.select("k", "n", name).collect())) == sorted(map(tuple, want.select("k", "n", F.array_join("g", "")).collect()))
    short = genetics.offspring_rows(df.where("length(a) < 9"), "a", "b")
    assert "flatten" not in short.where("length(a) BETWEEN 1 AND 18 AND length(b) BETWEEN 1 AND 18")._jdf.queryExecution().executedPlan().toString().split("Union")[0]
