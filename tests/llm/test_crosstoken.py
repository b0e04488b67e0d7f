"""Cross-tokenizer alignment against both libraries on whole texts and plain counting."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandloom.llm import crosstoken
from strandloom.llm.bpe import token_bytes

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "'re", "<|endoftext|>", "<s>", "</s>", "<0x41>", "1", "23", "!", "...", "é", "É", "×", "÷",
          "你好", "，", "\t", "-", "ÿ", "😀", "tion", "\x1c", "\u0085", "\r", ";\r", "   ", " Hello", " World,", "́", "İ", "\xa0", "　", "\x00", "ß", "à"]


@pytest.fixture(scope="module")
def tools():
    made = Tokenizer.from_file(A)
    made.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = token_bytes(open(A, encoding="utf-8").read())
    return made, pieces, shown


def aligned(tools, text):
    """The groups of a text: pairs of lists of ids; None without tokens."""
    made, pieces, shown = tools
    if not text:
        return None
    want = (" " + text).encode()
    a, b = made.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    spelled = [[shown[i] for i in a], []]
    for i in b:
        name = pieces.id_to_piece(i)
        spelled[1].append(bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode())
    if any(b"".join(s) != want for s in spelled):
        return None
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def expected(tools, rows):
    all_groups = [aligned(tools, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in all_groups]
    count = Counter(p for found in links for p in found)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), groups, found in zip(rows, all_groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append((
            key, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), sum(found.values()),
            sum(n for p, n in found.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def texts_of(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.sample(PIECES, rng.randint(1, 8))) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_parts_are_independent(tools):
    """Whole texts have the tokens and groups of their parts."""
    known = crosstoken.Alignments(open(A, encoding="utf-8").read(), open(B, "rb").read(), spelled=True, most=500)
    texts = [*texts_of(2500, 30, 1), None, "", " ", "a▁b", "'s 's", "é à É× ÷ b", "x" * 300]
    for low in range(0, len(texts), 90):
        rows = pa.array(texts[low : low + 90])
        parts, first = crosstoken.parts_of(rows)
        number = known.numbers(parts)
        for text, a, b in zip(rows.to_pylist(), first, first[1:], strict=False):
            groups = aligned(tools, text)
            wrong = known.fields["wrong"][number[a:b]].any()
            assert wrong == (groups is None and bool(text))
            if groups:
                want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
                assert ";".join(known.text[n] for n in number[a:b]) == want


def run(spark, rows, tmp_path, name):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, _text string, code int, n_a int")
    return crosstoken.alignments(spark, docs.repartition(5), "doc_id", "text", A, B, str(tmp_path / name))


def test_counts_equal_plain_counting(spark, tools, tmp_path, monkeypatch):
    rows = list(enumerate([None, "", "▁", "a▁b", "a b a b", "a b a b", "word " * 9000, "é" * 5000, *texts_of(120, 80, 2)]))
    rows += [(3, "same key"), (None, "no key"), rows[4]]
    want = sorted(expected(tools, rows), key=str)
    assert sorted(map(tuple, run(spark, rows, tmp_path, "one").collect()), key=str) == want
    # Many slices, many vectors each, and a cache too small to hold two slices.
    monkeypatch.setattr(crosstoken, "SLICE", 100)
    monkeypatch.setattr(crosstoken, "ROWS", 4)
    monkeypatch.setattr(crosstoken, "FAN", 2)
    assert sorted(map(tuple, run(spark, rows, tmp_path, "many").collect()), key=str) == want
    assert len(os.listdir(tmp_path / "many")) == 3


def test_index_checks_its_keys(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three")], "doc_id int, text string")
    from strandloom.llm.bpe import shipped

    model = spark.sparkContext.broadcast(open(B, "rb").read())
    n, top = crosstoken.build_index(docs, "text", shipped(spark, A), model, str(tmp_path / "index"))
    counts = crosstoken.Counts(str(tmp_path / "index"), n, top)
    known = crosstoken.Alignments(open(A, encoding="utf-8").read(), open(B, "rb").read(), spelled=False)
    codes, held = crosstoken.documents_per_pair(known, pa.array(["one two three", "two three", None]))
    assert counts.of(codes).tolist() == held.tolist() and set(held) == {1, 2}
    assert not counts.of(np.arange(1000) * 77_777_777 % 2**31 + 5).any()


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path, "none").collect() == []
    assert run(spark, [(1, None), (2, "")], tmp_path, "nothing").count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_documents(spark, tools, tmp_path):
    from strandloom.llm import queries

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = queries.QUERIES["op12_cross_tokens"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(expected(tools, rows))
