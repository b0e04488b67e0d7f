"""Suffix trees, suffix arrays and border arrays that are made inside tasks, against definitions and the way by joins."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest

from strandloom.operators import borders, suffix, suffix_tree

RNG = random.Random(4)
TEXTS = {i: "".join(RNG.choice(("ab", "aé😀", "a", "acgt")[i % 4]) for _ in range(1 + 11 * i % 47)) for i in range(16)}
TEXTS |= {20: "a" * 60, 21: "ab" * 30 + "c" + "ab" * 30, 22: "\0a\0a", 23: "".join(map(chr, range(200, 290)))}
WAYS = pytest.mark.parametrize("local", [0, 30, 1 << 18], ids=["joins", "both", "tasks"])


@pytest.fixture
def rows(spark, monkeypatch, local):
    monkeypatch.setattr(suffix, "LOCAL", local)
    monkeypatch.setattr(suffix, "_SLICE", 70)
    data = [((k, "x"), t) for k, t in TEXTS.items()] + [((50, "x"), ""), ((51, "x"), None), (None, "abab")]
    return spark.createDataFrame(data, "k struct<a:int, b:string>, t string").repartition(3)


def tables(spark):
    return {x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("table-")}


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tree_by_hand(text):
    follow = defaultdict(set)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            follow[text[i:j]].add(text[j] if j < len(text) else None)
    nodes = {w for w, after in follow.items() if len(after) > 1 or None in after}
    above = {w: [n for n in range(1, len(w)) if w[:n] in nodes] for w in nodes}
    ends = {w: len(text) - len(w) if None in follow[w] else None for w in nodes}
    return sorted((w, max(above[w], default=0), len(above[w]), ends[w], w[max(above[w], default=0)]) for w in nodes)


@WAYS
def test_trees(spark, rows):
    found = defaultdict(list)
    for r in suffix_tree.suffix_tree(rows, "k", "t", 64, first_char=True).collect():
        found[r.k.a].append((TEXTS[r.k.a][r.pos0 : r.pos0 + r.depth], r.parent_depth, r.branch_depth, r.terminal, r.first_char))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()} == {k: tree_by_hand(t) for k, t in TEXTS.items()}


@pytest.mark.parametrize("local", [1 << 18])
def test_trees_leave_only_their_edges(spark, rows):
    """Texts are shuffled once; no row per suffix is written or shuffled."""
    before = tables(spark)
    plan = steps(suffix_tree.suffix_tree(rows, "k", "t", first_char=True))
    assert len(tables(spark) - before) <= 1  # the keys of other texts
    assert plan.count("Exchange") == 2 and "Join" not in plan  # one of them made by the fixture


def test_nearest_smaller_beyond_the_hops():
    import numpy as np

    from strandloom.operators.nearest import last_smaller

    for values in ([*range(300), 0, 5, 3], [5] * 90, [*range(90, 0, -1)], [RNG.randint(0, 9) for _ in range(500)], [1]):
        values = np.array(values)
        assert suffix_tree._left_smaller(values).tolist() == last_smaller(values, np.arange(len(values)), values).tolist()


@WAYS
def test_arrays(spark, rows):
    found = defaultdict(dict)
    for r in suffix.suffix_array(rows, "k", "t").collect():
        found[r.k.a][r["rank"]] = r.pos0
    assert found == {k: dict(enumerate(sorted(range(len(t)), key=lambda p: t[p:]))) for k, t in TEXTS.items()}


@pytest.mark.parametrize("local", [1 << 18])
def test_arrays_are_not_written(spark, rows):
    before = tables(spark)
    suffix.suffix_array(rows, "k", "t")
    assert len(tables(spark) - before) <= 1


def test_arrays_of_texts_longer_than_a_block(spark):
    """A text of more than 65 536 characters takes no rounds of joins."""
    text = "".join(RNG.choice("abc ") for _ in range(9000)) * 9
    before = tables(spark)
    array = suffix.suffix_array(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert len(tables(spark) - before) <= 1
    found = {r["rank"]: r.pos0 for r in array.collect()}
    order = [found[i] for i in range(len(text))]
    assert sorted(order) == list(range(len(text)))
    assert all(text[a:] < text[b:] for a, b in zip(order[::700], order[1::700], strict=False))


def borders_by_hand(text):
    return [max((b for b in range(1, n) if text[:b] == text[n - b : n]), default=0) for n in range(1, len(text) + 1)]


@WAYS
def test_borders(spark, rows):
    found = defaultdict(dict)
    for r in borders.border_arrays(rows, "k", "t", 16).collect():
        found[r.k.a][r.pos0] = r.border
    assert found == {k: dict(enumerate(borders_by_hand(t))) for k, t in TEXTS.items()}


@pytest.mark.parametrize("local", [1 << 18])
def test_borders_leave_only_their_values(spark, rows):
    """Texts are shuffled once; no row per position is written or shuffled."""
    before = tables(spark)
    plan = steps(borders.border_arrays(rows, "k", "t"))
    assert len(tables(spark) - before) <= 1  # the keys of other texts
    assert plan.count("Exchange") == 2 and "Join" not in plan  # one of them made by the fixture
