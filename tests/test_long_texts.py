"""Indexes of long texts: suffix trees, common substrings and nearest smaller values, in many blocks."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import borders, fm_index, repeats, suffix, suffix_tree
from strandloom.operators.nearest import nearest_below, nearest_smaller


def smaller_by_hand(values):
    out = []
    for i, v in enumerate(values):
        before = next((j for j in range(i - 1, -1, -1) if values[j] < v), None)
        after = next((j for j in range(i + 1, len(values)) if values[j] < v), None)
        out.append((i, v, before, None if before is None else values[before], after, None if after is None else values[after]))
    return out


@pytest.mark.parametrize("values", [[random.Random(1).randint(-1, 9) for _ in range(300)], [*range(90), *range(90, 0, -1)], [5] * 40, [3]], ids=["random", "hill", "flat", "one"])
def test_nearest_smaller_values(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x int").repartition(3)
    for block in (7, 1 << 16):  # several levels of blocks, and one block
        assert sorted(map(tuple, nearest_smaller(df, "i", "x", len(values), block).collect())) == smaller_by_hand(values)
    asked = spark.createDataFrame([(i, b) for i in range(0, len(values), 11) for b in (0, 4, 100)], "i int, b int")
    for side in ("prev", "next"):
        found = {(r.i, r.b): r["at"] for r in nearest_below(df, "i", "x", asked, "i", "b", side, len(values), 16).collect()}
        for i, b in asked.collect():
            places = range(i - 1, -1, -1) if side == "prev" else range(i + 1, len(values))
            assert found.get((i, b)) == next((j for j in places if values[j] < b), None)


def tree_by_hand(text):
    """Every node but the root: its string, its parent's length, the nodes above, the suffix that ends there."""
    follow = defaultdict(set)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            follow[text[i:j]].add(text[j] if j < len(text) else None)
    nodes = {w for w, after in follow.items() if len(after) > 1 or None in after}
    out = []
    for w in nodes:
        above = [n for n in range(1, len(w)) if w[:n] in nodes]
        out.append((w, max(above, default=0), len(above), len(text) - len(w) if None in follow[w] else None))
    return sorted(out)


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_suffix_tree_in_blocks(spark, block):
    rng = random.Random(2)
    texts = {"a" * 12: 0, "banana": 1, "abcd": 2, "x": 3, "mississippi": 4, "".join(rng.choice("ab") for _ in range(40)): 5, "😀a😀ab": 6}
    df = spark.createDataFrame([(i, t) for t, i in texts.items()] + [(9, ""), (10, None)], "k int, t string")
    found = defaultdict(list)
    text_of = {i: t for t, i in texts.items()}
    for r in suffix_tree.suffix_tree(df, "k", "t", block).collect():
        found[r.k].append((text_of[r.k][r.pos0 : r.pos0 + r.depth], r.parent_depth, r.branch_depth, r.terminal))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()} == {i: tree_by_hand(t) for t, i in texts.items()}


def test_suffix_tree_of_a_long_text(spark):
    """Linear in the text: two rows per letter at most, also where suffixes share thousands of letters."""
    rng = random.Random(3)
    piece = "".join(rng.choice("acgt") for _ in range(4000))
    text = piece + "x" + piece + "y" + "a" * 2000
    tree = suffix_tree.suffix_tree(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 4096).collect()
    assert len(tree) < 2 * len(text) and len({(text[r.pos0 : r.pos0 + r.depth]) for r in tree}) == len(tree)
    assert sorted(r.terminal for r in tree if r.terminal is not None) == list(range(len(text)))
    longest = max((r for r in tree if r.terminal is None), key=lambda r: r.depth)
    assert longest.depth == 4000 and max(r.branch_depth for r in tree) >= 1999  # a^1999 has all shorter ones above it


def common_by_hand(texts):
    best = ""
    for i in range(len(texts[0])):
        for j in range(i + len(best), len(texts[0]) + 1):
            w = texts[0][i:j]
            if all(w in t for t in texts[1:]) and (len(w), [-ord(c) for c in w]) > (len(best), [-ord(c) for c in best]):
                best = w
    return best


@pytest.mark.parametrize("block", [9, 1 << 16])
def test_common_substring_of_groups(spark, block):
    rng = random.Random(4)
    groups = {g: ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))] for g in range(25)}
    groups |= {50: ["same text", "same text", "same text"], 51: ["abc", ""], 52: ["only one"], 53: [""], 54: ["ab", "cd"], 55: ["abab", "b", "xb"]}
    rows = [(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts)] + [(60, 0, None), (60, 1, "a")]
    df = spark.createDataFrame(rows, "g int, i int, t string").repartition(3)
    got = {r.g: r.substring for r in repeats.common_substring(df, "g", "t", "i", block).collect()}
    assert got == {g: common_by_hand(t) for g, t in groups.items()} | {60: ""}
    if block > 9:
        assert {r.g: r.substring for r in repeats.common_substring(df, "g", "t").collect()} == got


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_common_substring_of_pairs(spark, block):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 25))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for _ in range(30)]
    pairs += [("xab_ab", "ab"), ("same", "same"), ("", ""), ("a", None), ("zzab", "abzz")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: (r.substring, r.pos0) for r in repeats.common_substring_pair(df, "k", "a", "b", block).collect()}
    for k, (a, b) in enumerate(pairs):
        best = max(((n, -i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in (b or "")), default=(0, 0))
        assert got[k] == ((a[-best[1] : -best[1] + best[0]], -best[1]) if best[0] else ("", None))


def test_common_substring_of_long_texts(spark):
    """Ten thousand letters each; what they share is found whole, however long."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    shared = letters(3000)
    texts = [letters(4000) + shared + letters(3000), letters(100) + shared + letters(6900), letters(7000) + shared]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("g", F.lit(1))
    found = repeats.common_substring(df, "g", "t", "i", 4096).first().substring
    assert shared in found and all(found in t for t in texts)
    pair = repeats.common_substring_pair(spark.createDataFrame([(1, *texts[:2])], "k int, a string, b string"), "k", "a", "b").first()
    assert shared in pair.substring and texts[0][pair.pos0 :].startswith(pair.substring) and pair.substring in texts[1]


def test_short_groups_pairs_and_patterns_need_no_index(spark, monkeypatch):
    """texts that fit a task are not ranked by rounds of joins, and give what the index gives."""
    rng = random.Random(17)
    word = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    rows = [(g, i, word(rng.randint(1, 40), "ab\U0010ffff\0")) for g in range(30) for i in range(rng.randint(1, 5))]
    rows += [(40, 0, "twice"), (40, 0, "ice"), (None, 1, "a"), (None, 2, "a"), (41, None, "a"), (41, 1, "a"), (42, 1, ""), (42, 2, "a")]
    groups = spark.createDataFrame(rows, "g int, i int, t string")
    pairs = spark.createDataFrame([(k, word(k), word(30 - k)) for k in range(30)] + [(None, "a", "a"), (70, "", None)], "k int, a string, b string")
    texts = spark.createDataFrame([(k, word(k * 3)) for k in range(30)] + [(None, "a"), (70, None), (71, "ab"), (71, "b")], "k int, t string")
    asked = spark.createDataFrame([(k, word(rng.randint(0, 4))) for k in range(32) for _ in range(9)] + [(None, "a"), (71, "b"), (71, "")], "k int, p string")

    def results(local):
        return [
            sorted(map(str, df.collect()))
            for df in (
                repeats.common_substring(groups, "g", "t", "i", local=local),
                repeats.common_substring_pair(pairs, "k", "a", "b", local=local),
                fm_index.pattern_intervals(texts, "k", "t", asked, "p", local=local),
            )
        ]

    plain = results(-1)
    assert results(1 << 16) == plain and all(plain)
    odd = groups.where("g < 40"), texts.where("k < 40")

    def refused(*_):
        raise AssertionError("ranked by joins")

    for module in (repeats, fm_index):
        monkeypatch.setattr(module, "build_group_index", refused)
    assert repeats.common_substring(odd[0], "g", "t", "i").count() == 30
    assert repeats.common_substring_pair(pairs.where("k IS NOT NULL"), "k", "a", "b").count() == 31
    assert fm_index.pattern_intervals(odd[1], "k", "t", asked, "p").count() > 0


def test_transforms_of_short_texts_have_a_row_per_block(spark, monkeypatch):
    """no row per character, and the same transforms, blocks and places as by joins."""
    rng = random.Random(18)
    texts = ["", "$a$", "banana", "\0\U0010ffff" * 9] + ["".join(rng.choice("ab$") for _ in range(n)) for n in (1, 7, 8, 15, 16, 40, 90)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(90, None)], "k int, t string")
    asked = spark.createDataFrame([(k, p) for k in range(12) for p in ("a", "ab", "$", "", "na", "b$a")], "k int, p string")

    def results(local):
        of, index = fm_index.transform(df, "k", "t", local), fm_index.build_fm_index(df, "k", "t", 8, local)
        found = fm_index.backward_search(index, asked, "p")
        blocks = sorted((r.k, r.block, r.text, r.hole, dict(r.before or {}), r.places) for r in index.blocks.collect())
        tables = of.shown(), of.inverse(), fm_index.locate(index, found), fm_index.suffix_offsets(index, found, 4), index.sizes
        return [blocks, *(sorted(map(str, t.collect())) for t in tables)]

    plain = results(-1)
    assert plain[2] == sorted(f"Row(k={k}, seq={t!r})" for k, t in enumerate(texts))

    def refused(*_):
        raise AssertionError("a row per character")

    monkeypatch.setattr(fm_index, "bwt", refused)
    assert results(1 << 16) == plain


def test_group_index_orders_all_suffixes(spark):
    rng = random.Random(7)
    rows = [(g, i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 40, 60])))) for g in range(4) for i in range(5)]
    rows += [(0, 9, rows[0][2]), (1, 9, "ab" * 40), (1, 10, "ab" * 40), (2, 9, "a" * 70), (2, 10, "a" * 90)]
    df = spark.createDataFrame(rows, "g int, i int, t string")
    index = suffix.build_group_index(df, "g", "i", "t")
    text = {(g, i): t for g, i, t in rows}
    suffixes, at = defaultdict(list), {}
    for r in sorted(index.ordered.collect(), key=lambda r: r.r):
        at[r.r] = text[r.g, r.text][r.pos0 - r.start :]
        suffixes[r.g].append(at[r.r])
        assert r.stop - r.start == len(text[r.g, r.text])
    for g, found in suffixes.items():
        assert found == sorted(t[p:] for (h, _), t in text.items() if h == g for p in range(len(t)))
    pairs = index.common_prefixes().collect()
    assert len(pairs) == len(at) - len(suffixes)
    for r in pairs:
        assert r.lcp == len(os.path.commonprefix([at[r.r - 1], at[r.r]]))


def test_shortest_runs_by_hand():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, owners = rng.integers(1, 30), rng.integers(2, 5)
        owner, shared = rng.integers(0, owners, n), rng.integers(0, 6, n)
        want = []
        for j in range(n):
            runs = [int(shared[i + 1 : j + 1].min()) for i in range(j) if len(set(owner[i : j + 1].tolist())) == owners]
            want.append(max(runs, default=-1))
        none = np.zeros(0, np.int64)
        assert repeats.shortest_runs(shared, owner, int(owners), none, none).tolist() == want
        cut = int(rng.integers(0, n))  # the same from a border in the middle
        last = sorted((max(np.flatnonzero(owner[:cut] == o)), o) for o in set(owner[:cut].tolist()))
        reach = [int(shared[i + 1 : cut].min()) if i + 1 < cut else 1 << 62 for i, _ in last]
        got = repeats.shortest_runs(shared[cut:], owner[cut:], int(owners), np.array([o for _, o in last], np.int64), np.array(reach, np.int64))
        assert got.tolist() == want[cut:]


def borders_of(text):
    out, b = [0] * len(text), 0
    for i in range(1, len(text)):
        while b and text[b] != text[i]:
            b = out[b - 1]
        b += text[b] == text[i]
        out[i] = b
    return out


def test_border_arrays(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 50))) for _ in range(15)] + ["a" * 40, "x", "abab" * 9 + "c" + "abab" * 9, "😀a😀a", ""]
    texts.append((("".join(rng.choice("acgt") for _ in range(3000))) + "n") * 3)
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, t string")
    found = defaultdict(dict)
    for r in borders.border_arrays(df, "k", "t", width=16).collect():
        found[r.k][r.pos0] = r.border
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == {k: borders_of(t) for k, t in enumerate(texts) if t}


def test_intervals_of_long_patterns(spark):
    """Patterns of any length, many per text, against the sorted suffixes."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 30, 80)] + ["a" * 50, "", "acgt" * 1500 + "".join(rng.choice("acgt") for _ in range(5000))]
    asked = [(k, p) for k, t in enumerate(texts) for p in {t[:1], t, t[3:40], t[-9:], "ab", "b", "zz", "", t + "a", t[1:] + "a", t[len(t) // 2 :], "a" * 20}]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    queries = spark.createDataFrame([*asked, *asked[:3], (0, None), (77, "a")], "k int, p string")
    got = {(r.k, r.pattern): (r.lo, r.hi) for r in fm_index.pattern_intervals(df, "k", "t", queries, "p", block=64).collect()}
    want = {}
    for k, p in asked:
        ranked = sorted([texts[k][i:] for i in range(len(texts[k]) + 1)])  # the sentinel's suffix is the empty one
        inside = [i for i, s in enumerate(ranked) if s.startswith(p)]
        if inside:
            want[k, p] = (inside[0], inside[-1] + 1)
    assert got == want


def test_intervals_lead_to_places(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "ananas")], "k int, t string")
    index = fm_index.build_fm_index(df, "k", "t")
    asked = spark.createDataFrame([(k, p) for k in (1, 2) for p in ("ana", "na", "s", "banana")], "k int, p string")
    by_letter = sorted(map(tuple, fm_index.backward_search(index, asked, "p").select("k", "pattern", "lo", "hi").collect()))
    together = fm_index.pattern_intervals(df, "k", "t", asked, "p")
    assert sorted(map(tuple, together.collect())) == by_letter
    places = sorted(map(tuple, fm_index.locate(index, together).collect()))
    assert places == [(1, "ana", 1), (1, "ana", 3), (1, "banana", 0), (1, "na", 2), (1, "na", 4), (2, "ana", 0), (2, "ana", 2), (2, "na", 1), (2, "na", 3), (2, "s", 5)]


def test_rows_made_by_explode_are_not_broadcast(spark):
    """What grows with the input has to be shuffled, however small the optimizer takes it to be."""
    from strandloom.operators import spectrum
    from strandloom.sources import simulate

    masses = spark.createDataFrame([(1, 0, 0), (1, 1, 7103711), (2, 0, 5)], "k int, i bigint, m bigint")
    genomes = spark.createDataFrame([(1, "ACGT" * 20)], "k int, g string")
    for found in (
        spectrum.spectrum_edges(masses, "k", "m"),
        spectrum.spectrum_residues(masses, "k", "i", "m"),
        simulate.simulate_reads(genomes, "k", "g", 30, 2.0, width=32),
    ):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in spectrum.spectrum_edges(masses, "k", "m").collect()] == [(1, 0, 7103711, "A")]


def test_masses_at_the_borders_of_bins(spark):
    from strandloom.operators import spectrum

    width, alanine = spectrum._BIN, 7103711
    starts = [n * width - alanine + off for n in (230, 231) for off in (-1001, -1000, -999, -1, 0, 1, 999, 1000, 1001)]
    rows = [(i, m) for i, s in enumerate(starts) for m in (s, s + alanine - 1000, s + alanine + 1000, s + alanine + 1001)]
    got = spectrum.spectrum_edges(spark.createDataFrame(rows, "k int, m bigint"), "k", "m").where("m2 - m1 > 7000000")
    want = [(i, s, s + alanine + off, "A") for i, s in enumerate(starts) for off in (-1000, 1000)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_letters_after_a_long_prefix_come_from_pieces(spark, monkeypatch):
    """A match may go on in the next piece of its text, end with the text, or begin in a later block."""
    from strandloom.operators import search

    monkeypatch.setattr(search, "_PIECE", 16)
    rng = random.Random(5)
    text = "".join(rng.choice("abé") for _ in range(300))
    patterns = sorted({text[i : i + n] for i, n in ((0, 17), (3, 29), (14, 18), (15, 31), (269, 31), (283, 17), (40, 64), (40, 70))})
    texts = spark.createDataFrame([(1, text), (2, text[5:40]), (3, ""), (4, None)], "k int, t string")
    found = search.find_patterns(texts, "k", "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p")
    want = [(k, p, i) for k, t in ((1, text), (2, text[5:40])) for p in patterns for i in range(len(t)) if t.startswith(p, i)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_pieces_are_sent_once_and_windows_are_not(spark):
    """The rest of a match was looked up among the windows of all positions, by a broadcast of them."""
    from strandloom.operators import search

    known = search.build_patterns(spark.createDataFrame([("a" * 20,)], "p string"), "p")
    texts = spark.createDataFrame([(1, "a" * 100)], "k int, t string")
    plan = search.occurrences(texts, "k", "t", known)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_border_arrays_go_back_in_small_batches(monkeypatch):
    import pandas as pd

    from strandloom.functions import strings

    monkeypatch.setattr(strings, "_BORDERS", 8)
    texts = ["aabaa", None, "", "abab", "aaaaaaaaaaaa", "b"]
    got = list(strings.border_array.func(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)])))
    assert max(sum(len(x) for x in part if x is not None) for part in got) <= 12
    flat = [None if x is None else list(x) for part in got for x in part]
    assert flat == [[0, 1, 0, 1, 2], None, [], [0, 0, 1, 2], list(range(12)), [0]]


@pytest.mark.parametrize("local", [0, 20, 1 << 16], ids=["joins", "both", "tasks"])
def test_suffixes_of_short_and_long_texts(spark, monkeypatch, local):
    """Texts are ranked by joins, in tasks, or some in each way, with the same result; ranks have no gaps."""
    monkeypatch.setattr(suffix, "LOCAL", local)
    monkeypatch.setattr(suffix, "_SLICE", 50)
    rng = random.Random(11)
    texts = {i: "".join(rng.choice(("ab", "aé😀", "a")[i % 3]) for _ in range(1 + 7 * i % 45)) for i in range(12)}
    rows = [((k, "x"), t) for k, t in texts.items()] + [((50, "x"), ""), ((51, "x"), None)]
    df = spark.createDataFrame(rows, "k struct<a:int, b:string>, s string")
    index = suffix.build_suffix_index(df, "k", "s", before=True)
    array, near = defaultdict(dict), {}
    for r in index.symbols().collect():
        array[r.k.a][r["rank"]] = (r.pos0, r.before)
    for r in index.neighbours().collect():
        near[r.k.a, r["rank"]] = (r.pos0, r.prev0, r.lcp)
    assert set(array) == set(texts)
    for k, t in texts.items():
        order = sorted(range(len(t)), key=lambda p: t[p:])
        assert array[k] == {i: (p, t[p - 1] if p else None) for i, p in enumerate(order)}
        pairs = [(p, q, len(os.path.commonprefix([t[p:], t[q:]]))) for q, p in zip(order, order[1:], strict=False)]
        assert [near[k, i + 1] for i in range(len(pairs))] == pairs
    places = sorted((r.r, r.k.a) for r in index.ordered.collect())
    assert [r for r, _ in places] == list(range(sum(map(len, texts.values()))))
    assert sum(a[1] != b[1] for a, b in zip(places, places[1:], strict=False)) == len(texts) - 1
    assert index.common_prefixes().count() == len(near) == len(places) - len(texts)
