"""Source mixing, top-k search, language and toxicity."""

from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import langid, mixing, topk, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_knapsack_is_the_best():
    rng = random.Random(1)
    for _ in range(150):
        sizes, copies = [np.array([rng.randint(0, most) for _ in range(4)]) for most in (12, 3)]
        budget = rng.randint(0, 40)
        take = mixing.knapsack(sizes, copies, budget)
        assert (take <= copies).all() and (take >= 0).all()
        sums = {int(np.dot(sizes, t)) for t in itertools.product(*(range(c + 1) for c in copies))}
        assert int(np.dot(sizes, take)) == max(s for s in sums if s <= budget)


def test_fit_meets_its_target():
    rng = np.random.default_rng(2)
    sizes, counts = np.arange(1, 400), rng.integers(0, 50, 399)
    total = int(sizes @ counts)
    for share in (0.0, 0.3, 0.999, 1.0, 1.37, 2.0):
        passes, extra = mixing.fit(sizes, counts, share * total, 2)
        assert (extra <= counts).all() and passes * total + int(sizes @ extra) == round(share * total)
    passes, extra = mixing.fit(np.array([10**7, 3]), np.array([5, 9]), 2.5e7, 2)
    assert passes == 0 and abs(10**7 * extra[0] + 3 * extra[1] - 2.5e7) <= 10**7


def test_mixing_of_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["b", "a", "é", None, ""]), i) for i in range(600)]
    rows += [(600, None, "a", 0), (601, "", "only empty", 0), (7, rows[7][1], rows[7][2], 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix(docs, "doc_id", "text", "source").collect()
    again = mixing.mix(docs.repartition(5), "doc_id", "text", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    source = {i: s for i, _, s, _ in rows}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    assert all(r.size == size[r.doc_id] for r in got)
    names = sorted({*source.values()} - {None}) + [None]
    sums = {s: sum(r.size for r in got if source[r.doc_id] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(weight[s] * mid, 2 * sums[s]) for s in names) < 1.5 * sum(sums.values()) else (low, mid)
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(r.source_size == sums[s] for r in mine)
        assert mine[0].target == pytest.approx(min(weight[s] * high, 2 * sums[s]))
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2
    assert mixing.mix(docs.limit(0), "doc_id", "text", "source").collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert {r.taken for r in mixing.mix(nothing, "doc_id", "text", "source").collect()} == {0}


def test_threshold_algorithm():
    rng = np.random.default_rng(4)
    for n, d, most in ((1, 3, 4), (50, 2, 3), (400, 5, 50), (3000, 3, 1000)):
        vectors, ids = rng.integers(-most, most + 1, (n, d)), rng.permutation(n * 3)[:n]
        block = topk.Block(ids, vectors)
        for q in [np.zeros(d, np.int64), *rng.integers(-most, most + 1, (12, d))]:
            own = int(ids[0])
            best, score, met = block.search(own, q, 7)
            want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)[:7]
            assert [(-int(s), int(i)) for s, i in zip(score, best, strict=True)] == want and met <= n
    vectors = np.concatenate([np.tile([[100, 0]], (5, 1)), rng.integers(-3, 4, (5000, 2))])
    assert topk.Block(np.arange(len(vectors)), vectors).search(0, np.array([1, 1]), 3)[2] < 1000  # stops early
    with pytest.raises(OverflowError):
        topk.product(np.array([[2**40]]), np.array([2**40]))


def test_top_k_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)], 1) for i in range(100)]
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0], 1), (103, [float("inf")] * 4, 1),
             (None, [9.0] * 4, 1), (104, [2.0], 1), (60, rows[60][1], 1), (120, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = {}
    for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5, 64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = {i: np.floor(64 * np.float32(v + [0.0] * (4 - len(v))).astype(float)).astype(int) for i, v, _ in rows
               if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (0, 20, 40, 60, 80, 120):
        want = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5]
        assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    few = df.where("vec_id < 3")
    assert topk.top_k(few, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, 64).count() == 2
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect() == []


def held(parts, remainder):
    return lambda i: zlib.crc32(str(i).encode()) % parts == remainder


@tables
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), "doc_id", "text", "lang")
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "12 34 !!", 0.0), (4, "ü" * 50000, 0.0), (None, "the", 0.0), (4, "de", 0.0)], "doc_id bigint, text string, score double")
    got = langid.predict(odd, "doc_id", "text", model, {}).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 0) if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and all(r.lang_pred in model.languages for r in got if r.doc_id in (None, 4))
    found = langid.predict(docs, "doc_id", "text", model, {}).join(docs, "doc_id").select("doc_id", "lang", "lang_pred").collect()
    out = [r for r in found if held(3, 1)(r.doc_id)]
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves most at 0
    none = langid.train(docs.where("false"), "doc_id", "text", "lang")
    assert none is None and {r.lang_pred for r in langid.predict(odd, "doc_id", "text", none, {}).collect()} == {"und"}


def test_n_gram_buckets():
    flat, places = langid.features(["ab", None, "", "Ab", "xyz"])
    assert list(np.diff(places)) == [3, 0, 0, 3, 6]
    assert list(flat[places[0] : places[1]]) == list(flat[places[3] : places[4]])


@tables
def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = toxicity.train(docs.where(learn), labels.where(learn), "doc_id", "text", "toxic")
    found = toxicity.score(docs, "doc_id", "text", model, {}).join(labels, "doc_id").collect()
    out = [r for r in found if held(5, 0)(r.doc_id)]
    assert np.mean([r.predicted for r in out if not r.toxic]) < 0.05
    assert np.mean([r.predicted for r in out if r.toxic]) > 0.6
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a " * 100_000, "x")], "doc_id bigint, text string, score string")
    got = toxicity.score(odd, "doc_id", "text", model, {}).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.train(docs, labels.where("false"), "doc_id", "text", "toxic")
    assert none is None and {r.score for r in toxicity.score(odd, "doc_id", "text", none, {}).collect()} == {0.0}


def test_toxic_words_shorten_windows():
    plain = b"the words that everyone uses every day in every text " * 20
    distance = toxicity.Distance(plain, b" zugwumpfer")
    assert distance(b"every text of the day has zugwumpfer in it somewhere").max() >= 3
    assert distance(b"every text of the day has nothing in it").max() <= 1


def test_more_languages_than_a_model_may_have(spark, monkeypatch):
    monkeypatch.setattr(langid, "LABELS", 2)
    rows = [(i, f"some text {i}", f"l{i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(docs, "doc_id", "text", "lang")
    assert langid.train(docs.where("lang <> 'l2'"), "doc_id", "text", "lang") is not None
