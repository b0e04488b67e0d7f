"""BPE round trip, token files and token counts against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import attribution, bpe, tokenfile

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "'re", "<|endoftext|>", "<|end", "1", "23", "!", "...", "é", "你好", "世界",
          "，", "\t", "-", "ÿ", "😀", "tion", "\x1c", "\u0085", "\r", "   ", " Hello", " World,", "́", "İ", "Σ", "<|startoftext|>"]


def texts_of(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.sample(PIECES, rng.randint(1, 6))) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte():
    return open(BYTE, encoding="utf-8").read()


def test_joined_pieces_equal_the_whole(byte):
    made, rng = bpe.tokenizer(byte), random.Random(1)
    for text in texts_of(500, 300, 2):
        cut = rng.randint(0, len(text))
        sides = [(t, bpe._encoded(byte, t)) for t in (text[:cut], text[cut:])]
        if all(t for t, _ in sides):
            got = bpe.joined(byte, *sides, reach=rng.choice([20, 24, 40, 96]))
            assert list(got) == made.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTE, bpe.ByteMemo), (WORD, tokenfile.WordMemo)])
def test_memo_equals_the_library(path, kind):
    definition = open(path, encoding="utf-8").read()
    texts = [*texts_of(1500, 40, 3), None, ""]
    memo, made = kind(definition, most=200), bpe.tokenizer(definition)
    for low in range(0, len(texts), 97):
        part = texts[low : low + 97]
        ids, length = memo(pa.array(texts).slice(low, 97))
        ends = np.cumsum(length)
        for text, a, b in zip(part, ends - length, ends, strict=True):
            assert list(ids[a:b]) == made.encode(text or "", add_special_tokens=False).ids


def test_round_trip_of_documents(spark, byte):
    made = bpe.tokenizer(byte)
    texts = [None, "", "short text", "x" * 3000, "aé你" * 700, "word " * 900, "<|endoftext|>" * 60, " " * 500, "short text", *texts_of(30, 900, 4)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(2, "short text", "clash", 2), (None, "no key " * 80, "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, _text bigint")
    got = sorted(bpe.digests(docs, "doc_id", "text", BYTE).collect(), key=str)
    definition = bpe.shipped(spark, BYTE)
    tree = bpe.encode(docs, "doc_id", "text", definition, leaf=128)
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in tree.collect()) == sorted(
        (i if i is not None else -1, tuple(made.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows
    )
    want = []
    for i, text, *_ in rows:
        ids = made.encode(text or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), made.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *digest))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(want, key=lambda w: str(type(got[0])(*w)))] or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), "doc_id", "text", BYTE).collect() == []


def test_round_trip_takes_one_worker_a_task(spark, byte):
    texts = [None, "", "short text", "é你 <|endoftext|>" * 40, *texts_of(12, 200, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    definition = bpe.shipped(spark, BYTE)
    both = bpe.encoded_and_decoded(docs, "doc_id", "text", definition, leaf=64)
    parts = bpe.decode(bpe.encode(docs, "doc_id", "text", definition, leaf=64), "doc_id", "ids", definition)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, parts.collect()))
    shorts = bpe.encoded_and_decoded(docs, "doc_id", "text", definition)
    assert shorts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_decoding_of_broken_characters(byte):
    made = bpe.tokenizer(byte)
    ids = [made.encode(t, add_special_tokens=False).ids for t in ("你好", "é", "ab")]
    rows = [ids[0][:1], ids[0][1:], ids[1][:1], ids[2], [], [50256]]
    texts = bpe.vocabulary(byte).texts(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    assert texts.to_pylist() == [made.decode(r, skip_special_tokens=False) for r in rows]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20000))
    levels = tokenfile.build_hash(keys)
    assert sorted(tokenfile.ranks_of(levels, keys)) == list(range(len(keys)))
    assert tokenfile.build_hash(keys[:0]) == []


def test_token_files(spark, tmp_path):
    made = bpe.tokenizer(open(WORD, encoding="utf-8").read())
    rows = [(i * 7 - 50, t, 0) for i, t in enumerate([*texts_of(60, 50, 5), None, "", "very long " * 5000])] + [(None, "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    folder = str(tmp_path / "shards")
    got = tokenfile.written_and_read(spark, docs, "doc_id", "text", WORD, 2, folder).collect()
    at, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("shard")) == 2 * at
    asked = spark.createDataFrame([(-50,), (999_999,), (None,)], "doc_id bigint")
    found = tokenfile.payloads(tokenfile.lookup(asked, "doc_id", folder), folder).collect()
    assert {r.key: r.ids for r in found} == {
        k: [*made.encode(t or "", add_special_tokens=False).ids, 2] for k, t in ((-50, rows[0][1]), (tokenfile.NULL_KEY, "none"))
    }
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id bigint, text string")
    again = tokenfile.written_and_read(spark, twice, "doc_id", "text", WORD, 2, str(tmp_path / "twice")).collect()
    assert sorted((r.doc_id, r.start) for r in again) == [(1, 0), (1, 0), (2, 6)]
    assert tokenfile.written_and_read(spark, docs.limit(0), "doc_id", "text", WORD, 2, str(tmp_path / "none")).collect() == []


def counted(byte, text, spans, rule):
    ids = np.array(bpe.tokenizer(byte).encode(text, add_special_tokens=False).ids, np.int64)
    return {int(s): n for s, n in zip(*attribution.counts(ids, bpe.vocabulary(byte), spans, rule), strict=True)}


def test_token_allocation(byte):
    text = "alpha beta gamma"  # tokens: alpha, " beta", " gamma"
    spans = [(0, 5), (5, 7), (7, 10), (10, 16)]
    assert counted(byte, text, spans, "start") == {0: 1, 1: 1, 2: 0, 3: 1}
    assert counted(byte, text, spans, "end") == {0: 1, 1: 0, 2: 1, 3: 1}
    assert counted(byte, text, spans, "majority") == {0: 1, 1: 0, 2: 1, 3: 1}
    assert counted(byte, text, spans, "split") == {0: 1, 1: 0.4, 2: 0.6, 3: 1}
    assert counted(byte, text, [(2, 5)], "majority") == {0: 1, -1: 2}
    assert counted(byte, "", [(0, 0)], "majority") == {0: 0}
    assert counted(byte, "a\n\n\nb", None, "majority") == {0: 2, 1: 0, 2: 1, 3: 1}  # two line ends in one token


def attributed_by_hand(byte, text, spans, rule):
    """Section by section from the library's own offsets."""
    seen = bpe.tokenizer(byte).encode(text or "", add_special_tokens=False)
    spans = [(i, a, b) for i, (a, b) in enumerate(spans)]
    where = {c: i for i, a, b in spans for c in range(a, b)}
    out = {i: 0 for i, *_ in spans}
    last = 0
    for a, b in seen.offsets:
        # The library gives a token of inner bytes its character; here a character counts for its first token.
        chars = [where.get(c, -1) for c in range(max(a, last), b)] or [where.get(b - 1, -1)]
        last = max(last, b)
        times = Counter(chars)
        most = max(times.values())
        pick = {"start": chars[0], "end": chars[-1], "majority": next(c for c in chars if times[c] == most)}.get(rule)
        for section, share in ({pick: 1} if rule != "split" else {c: n / len(chars) for c, n in times.items()}).items():
            out[section] = out.get(section, 0) + share
    return {k: v for k, v in out.items() if k >= 0 or v}


def line_spans_of(text):
    begin = [0, *(i + 1 for i, c in enumerate(text or "") if c == "\n")]
    return list(zip(begin, [*begin[1:], len(text or "")], strict=True))


@pytest.mark.parametrize("rule", attribution.RULES)
def test_allocation_equals_offsets(byte, rule):
    rng = random.Random(9)
    for text in [*texts_of(250, 40, 8), "", "é" * 9, "😀\n" * 5]:
        cuts = sorted(rng.randint(0, len(text)) for _ in range(6))
        for spans in (None, list(zip(cuts[::2], cuts[1::2], strict=True)), []):
            want = attributed_by_hand(byte, text, line_spans_of(text) if spans is None else spans, rule)
            got = counted(byte, text, spans, rule)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), (text, spans)


def test_token_counts_of_repeated_rows_and_long_texts(spark, byte):
    long = "line of words \n" * 9000
    rows = [(1, "ab cd", [(0, 2), (2, 5)]), (1, "ab cd", [(0, 2), (2, 5)]), (1, "other", [(0, 1)]), (None, "x\ny", [(0, 3)]), (None, None, None), (2, long, [(0, 70_000), (70_000, len(long))])]
    docs = spark.createDataFrame(rows, "k int, t string, s array<struct<begin:int,end:int>>").withColumn("key", F.lit("clash")).withColumn("spans", F.lit(1))
    for rule in ("majority", "split"):
        got = Counter((r.k, r.section, round(r.n_tokens, 9)) for r in attribution.token_counts(docs, "k", "t", BYTE, "s", rule).collect())
        assert got == Counter((k, i, round(n, 9)) for k, t, s in rows for i, n in attributed_by_hand(byte, t, s or [], rule).items())
    lines = Counter((r.k, r.section, r.n_tokens) for r in attribution.token_counts(docs, "k", "t", BYTE).collect())
    assert lines == Counter((k, i, n) for k, t, _ in rows for i, n in attributed_by_hand(byte, t, line_spans_of(t), "majority").items())
    assert attribution.token_counts(docs.limit(0), "k", "t", BYTE, "s").collect() == []


def test_token_counts_by_line(spark, byte):
    texts = [None, "", "one\ntwo lines\n", "你好\n世界 " * 40, *texts_of(20, 200, 6)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, section string")
    rows = attribution.token_counts(docs, "doc_id", "text", BYTE).collect()
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == len(bpe.tokenizer(byte).encode(text or "", add_special_tokens=False).ids)
        assert sorted(r.section for r in mine) == list(range((text or "").count("\n") + 1))
    spans = spark.createDataFrame([(1, "ab cd", [(0, 2), (2, 5)]), (2, None, None)], "k int, t string, s array<struct<begin:int,end:int>>")
    got = attribution.token_counts(spans, "k", "t", BYTE, "s", "split").collect()
    assert sorted((r.k, r.section, r.n_tokens) for r in got) == [(1, 0, 1.0), (1, 1, 1.0)]
    with pytest.raises(ValueError):
        attribution.token_counts(docs, "doc_id", "text", BYTE, rule="other")
