"""Border arrays of whole documents, many at a time."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from strandloom.functions import strings
from strandloom.plans import workloads


def test_empty_documents_have_no_borders(spark, tmp_path):
    rows = [(1, ""), (2, "abab"), (3, None), (4, "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.seq_id: (r.longest, r.last) for r in workloads.QUERIES["border_array_documents"](spark, str(tmp_path)).collect()}
    assert found == {1: (0, 0), 2: (4, 4), 3: (None, None), 4: (0, 0)}


@pytest.mark.parametrize("rounds", [1, 64])
def test_borders_of_many_texts(monkeypatch, rounds):
    """Also of texts that share more with their beginning than is compared at once, and of those too long to go together."""
    monkeypatch.setattr(strings, "_ROUNDS", rounds)
    monkeypatch.setattr(strings, "_BORDERS", 2000)
    rng = random.Random(12)
    texts = ["".join(rng.choice(("ab", "aé😀", "acgt", "\0a")[i % 4]) for _ in range(rng.randint(1, 90))) for i in range(60)]
    texts += ["a" * 1500 + "b" * 3, "ab" * 700, "abc" * 900, "x", "", None, "".join(map(chr, range(100, 900))) * 2]
    texts += [t + t + t for t in texts[:20]]
    got = [x for part in strings.border_array.func(iter([pd.Series(texts, dtype=object)])) for x in part]
    for text, found in zip(texts, got, strict=True):
        assert (found is None) == (text is None)
        for n, border in enumerate(found if text else [], 1):
            assert border == 0 or text[n - border : n] == text[:border]
        assert text is None or list(found) == strings._borders_one_by_one(text).tolist()
