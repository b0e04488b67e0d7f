"""Quality rules, near-duplicates, line dedup and the pipeline."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from strandloom.llm import batches, linededup, mixing, neardup, quality
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n, most, seed, words=("ab", "b", "Éa", "#*", "你", "x<", "the", "c d")):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, most))) for _ in range(n)]


# ---- quality


def counts_by_hand(text):
    found = WORD.findall(text)
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times, lines, seen = Counter(grams), 0, set()
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_counts_of_the_base_rules():
    texts = [*random_texts(200, 60, 1), None, "", "\n\n", "a a a a a a a"]
    got = quality.counts(pa.array(texts).slice(0))
    assert list(zip(*(got[c].tolist() for c in quality.COUNTS), strict=True)) == [counts_by_hand(t or "") for t in texts]


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by its definition, as a function of an n-gram of classes."""
    grams = Counter()
    for text in texts:
        codes = [0] * 3 + [int(quality._CLASS[b]) for b in text.encode()]
        grams.update(tuple(codes[i - 3 : i + 1]) for i in range(3, len(codes)))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def chance(gram):
        n = len(gram)
        if not n:
            return 1 / quality.CLASSES
        counts = levels[n]
        of = [sum(1 for c in counts.values() if c == i) for i in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
        off = [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i - 0.05) if of[i - 1] else 0.5 * i for i in (1, 2, 3)]
        after = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not after:
            return chance(gram[1:])
        total = sum(after.values())
        free = sum(off[min(c, 3) - 1] for c in after.values()) / total
        own = after.get(gram, 0)
        return (own - off[min(own, 3) - 1] if own else 0) / total + free * chance(gram[1:])

    return chance


def test_model_equals_its_definition(spark):
    texts = ["the cat sat.", "the dog!", "Été 12", "", "the the the"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    model, chance = quality.train(docs, "text"), kneser_ney(texts)
    rng = np.random.default_rng(1)
    keys = np.concatenate([quality.ngrams(*batches.strings(pa.array(texts))), rng.integers(0, quality.CLASSES**4, 50)]).astype(np.int64)
    for key, got in zip(keys, model.log2(keys), strict=True):
        gram = tuple(int(key) // quality.CLASSES**i % quality.CLASSES for i in (3, 2, 1, 0))
        assert got == pytest.approx(np.log2(chance(gram)), abs=1e-4)
    context = int(keys[3]) // quality.CLASSES * quality.CLASSES
    assert (2.0 ** model.log2(context + np.arange(quality.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_bands_keep_ordinary_texts(spark):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "amet", "elit", "sed", "magna", "erat", "nulla", "porta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(30, 90))), "la" if i % 3 else None, "x") for i in range(200)]
    rows += [(900, "Q9$%zq " * 3 + "%$#@ zz9 QQ# &&x 7z$ q%q W#9 x&& zq9 %%$ 8#8 ZQ", "la", "x"), (901, None, "la", "x"), (902, "", None, "x"),
             (903, "one two", "xx", "x"), (904, "same words again here now " * 9, "la", "x"), (0, rows[0][1], None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept string")
    got = quality.judge(docs, "text", "lang").select("row.doc_id", "kept", "base_failed").collect()
    assert len(got) == len(rows)
    lost = {r.doc_id for r in got if not r.kept}
    assert lost == {900, 901, 902, 903, 904} and {r.doc_id for r in got if r.base_failed} == lost - {900}
    assert quality.judge(docs.limit(0), "text", "lang").collect() == []


def test_models_of_both_halves(spark, monkeypatch):
    """The tables that Spark makes are the model of each half, for the n-grams of both, also if a task counts few at a time."""
    monkeypatch.setattr(quality, "SHARD", 300)
    monkeypatch.setattr(quality, "ROOM", 600)
    texts = [*random_texts(60, 40, 7), "1234 \x00\x01", "ABC abc", "你好吗" * 5, "", None]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:3]]], "text string").repartition(3)
    halves = docs.select("text", quality.half_of("text").alias("half")).collect()
    models = []
    for half in (0, 1):
        mine = batches.strings(pa.array([r.text for r in halves if r.half == half]))
        models.append(quality.Model(*np.unique(quality.ngrams(*mine, quality.ORDER), return_counts=True), quality.ORDER))
    keys = np.unique(quality.ngrams(*batches.strings(pa.array(texts)), quality.ORDER))
    folder, number = quality.written(docs, "text")
    shards = quality.Shards(folder, number)
    got = shards.log2(keys)
    assert number > 2 and 0 < len(shards.held) < number
    assert got[0] == pytest.approx(models[1].log2(keys), abs=1e-4) and got[1] == pytest.approx(models[0].log2(keys), abs=1e-4)
    with pytest.raises(ValueError, match="not those that were counted"):
        shards.log2(np.array([5]))


def test_tasks_that_count_little_at_a_time(monkeypatch):
    texts = random_texts(300, 50, 8)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(300)])], ["_text", "_half"])
    monkeypatch.setattr(quality, "MOST", 100)
    monkeypatch.setattr(quality, "BLOCK", 256)
    got, rows = defaultdict(lambda: [0, 0]), 0
    for part in quality._counted(5)(iter([batch.slice(0, 150), batch.slice(150)])):
        for r in part.to_pylist():
            rows += 1
            got[r["key"]][0] += r["a"]
            got[r["key"]][1] += r["b"]
    want = defaultdict(lambda: [0, 0])
    for i, text in enumerate(texts):
        for key in quality.ngrams(*batches.strings(pa.array([text])), 5).tolist():
            want[key][i % 2] += 1
    assert got == want and rows > 1.5 * len(want)


def test_symbols_are_told_apart(spark):
    """Random capitals, random numbers, characters of three bytes at random are not ordinary text."""
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "Amet", "elit", "sed", "magna", "1945", "nulla", "2001", "的时候", "我们", "没有什么"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(60, 90))), "la") for i in range(200)]

    def changed(function):
        return " ".join(function(w) for w in rng.choices(words, k=80))

    odd = {
        900: lambda w: "".join(rng.choice([c.upper(), c.lower()]) for c in w),
        901: lambda w: "".join(str(rng.randint(0, 9)) if c.isdigit() else c for c in w),
        902: lambda w: "".join(chr(rng.randint(0x4E00, 0x9FA5)) if ord(c) > 127 else c for c in w),
    }
    rows += [(i, changed(f), "la") for i, f in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs, "text", "lang", carried=["doc_id"]).select("row.doc_id", "kept", "base_failed", "bits").collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert {i for i in odd if got[i].kept} == set() and sum(r.kept for r in got.values()) > 190
    whole = {r.doc_id: (r.kept, r.bits) for r in quality.judge(docs, "text", "lang").select("row.*", "kept", "bits").collect()}
    assert whole == {i: (r.kept, r.bits) for i, r in got.items()}


# ---- near-duplicates


def shingles(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = WORD.findall(folded)
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) if len(found) > 4 else frozenset([tuple(found)] if found else [])


def components_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    holders, both, root = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        both.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_components(df, rows):
    want = components_by_hand(rows)
    for r in df.collect():
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def varied(rng, base, share):
    return " ".join(f"n{rng.randint(0, 10**6)}" if rng.random() < share else w for w in base.split())


def test_near_duplicates_of_made_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 13)  # several blocks in a bucket
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{rng.randint(0, 400)}" for _ in range(300))
    texts = [varied(rng, base, s) for s in (0.0, 0.01, 0.02, 0.04, 0.07) for _ in range(14)]
    texts += [varied(rng, other, s) for s in (0.0, 0.005, 0.03) for _ in range(10)]
    texts += ["A b c d", "a B c d", "a b c", "", None, "  \t\n", "a b c d e", "A B C D E", "a b c d e f", "one " * 30000, "one one one one one"]
    texts += [" ".join(f"k{rng.randint(0, 30)}" for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, rows[5], (None, base), (None, base)]], "doc_id bigint, text string, n_shingles int, _key string")
    check_components(neardup.components(docs, "doc_id", "text"), rows)
    assert neardup.components(docs.limit(0), "doc_id", "text").collect() == []
    assert {r.component_id for r in neardup.components(docs.where("doc_id is null"), "doc_id", "text").collect()} == {None}


def test_several_texts_of_one_key(spark):
    """Rows of one key are one document: the links of each of its texts are its own."""
    base = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "ABCD"}
    near = {c: t + f" more {c}" for c, t in base.items()}
    rows = [(1, base["A"]), (1, base["B"]), (1, base["C"]), (1, None), (2, near["A"]), (3, near["B"]), (4, near["C"]), (5, base["D"]), (5, base["D"]), (6, near["D"]), (7, None), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for dealt in (docs, docs.repartition(7), docs.orderBy(F.desc("text"))):
        got = neardup.components(dealt, "doc_id", "text").collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
            *[(1, 1, True)] * 4, (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True)
        ]


@tables
def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_components(entry.queries()["op7_near_duplicates"](spark, SF), [(r.doc_id, r.text) for r in docs.collect()])


def test_cut_shingles_lose_no_pair():
    shared = [1, 2, 3, 4, 5, 5 + (1 << 32)]  # the last two fall together on 32 bits
    sets = [np.array([*shared, own], np.uint64) for own in (100, 200)]
    rows = [{"_key": i, "component": i, "_n": 7, "_block": 0, "_set": v.astype(np.uint32).tobytes()} for i, v in enumerate(sets)]
    kind = pa.list_(pa.struct([("_key", pa.int64()), ("component", pa.int64()), ("_n", pa.int64()), ("_block", pa.int32()), ("_set", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([rows], kind)], ["_rows"])
    assert [b.to_pylist() for b in neardup._block_links(0.75, np.uint32)(iter([batch]))] == [[{"a": 0, "b": 1}]]


def test_failed_candidates_leave_no_link_out(spark, monkeypatch):
    """With shingles cut to 8 bits, most of the best pairs fail on the full sets."""
    sets_of, block_links, widths = neardup._sets_of, neardup._block_links, []
    monkeypatch.setattr(neardup, "_sets_of", lambda d, c, w, width=np.uint64: sets_of(d, c, w, np.uint8 if width is np.uint32 else width))
    monkeypatch.setattr(neardup, "_block_links", lambda t, width: widths.append(width) or block_links(t, np.uint8 if width is np.uint32 else width))
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(200))
    rows = list(enumerate(varied(rng, base, s) for s in (0.0, 0.01, 0.02, 0.03, 0.05) for _ in range(16)))
    check_components(neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text"), rows)
    assert widths == [np.uint32, np.uint64]


def test_estimate_of_registers():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (500, 900, 1000):
        sets = [np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])]
        found = neardup.registers(np.concatenate(sets), np.array([1000, 1000]))
        assert (found[0] == found[1]).mean() == pytest.approx(shared / (2000 - shared), abs=0.16)
    assert not neardup.registers(pool[:0], np.array([0, 0])).any()


# ---- lines


def removed_by_hand(rows, percent=85, least=1):
    lines = [((i is not None, i or 0), n, frozenset(WORD.findall(line))) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    lines = sorted({x for x in lines if len(x[2]) >= least}, key=lambda x: x[:2])
    gone = defaultdict(list)
    for k, (key, n, words) in enumerate(lines):
        if any(100 * len(words & w) >= percent * len(words | w) for _, _, w in lines[:k]):
            gone[key[1] if key[0] else None].append(n)
    return gone


def made_lines(seed):
    rng = random.Random(seed)
    bases = [" ".join(f"t{rng.randint(0, 60)}" for _ in range(rng.randint(4, 40))) for _ in range(12)]

    def line():
        words = rng.choice(bases).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"t{rng.randint(0, 90)}"
        return rng.choice(["", " ", "\t"]).join([" ".join(words), ""])

    texts = ["\n".join(line() for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return [*((i * 2 - 20, t) for i, t in enumerate(texts)), (500, None), (501, ""), (502, "\n\n"), (None, texts[3]), (503, "long " + "w1 w2 w3 w4 w5 " * 9000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    rows = made_lines(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*rows, rows[4]]], "doc_id bigint, text string, n_lines string, no int")
    want = removed_by_hand(rows)
    got = linededup.removed_by_document(docs, "doc_id", "text").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert list(r.removed) == want.get(r.doc_id, [])
    text = dict(rows)
    for r in linededup.without_lines(docs, "doc_id", "text").collect():
        gone = set(want.get(r.doc_id, []))
        if r.doc_id != rows[4][0]:
            assert r.text == ("\n".join(x for n, x in enumerate(text[r.doc_id].split("\n")) if n not in gone) if gone else text[r.doc_id])
    assert linededup.removed_by_document(docs.limit(0), "doc_id", "text").collect() == []



def test_documents_of_short_lines_stay(spark):
    footer = "this line stands below all of them"
    rows = [(1, footer), (2, f"milk\nfour eggs\n{footer}"), (3, footer), (4, f"{footer}\n \t\n"), (5, f"a b c d\n{footer}\n\u00e9"), (6, " \n"), (7, None), (None, f"x\n{footer}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.without_lines(docs, "doc_id", "text").collect()}
    # A null key is before all others, so its footer is the one that stays.
    assert got == {2: "milk\nfour eggs", 5: "a b c d\n\u00e9", 6: " \n", 7: None, None: f"x\n{footer}"}
    staged = stage(spark, "line dedup", [(i, t, "en", "s", 0) for i, t in rows])
    assert {r.doc_id for r in staged.collect()} == set(got)



def test_buckets_of_words_are_sorted_once(spark):
    rows = spark.range(500).selectExpr("cast(id * 7919 % 97 as int) AS word", "id")
    table, drop = linededup._bucketed(rows, "word")
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    with linededup._in_bucket_order(spark):
        pairs = table.select("word", F.col("id").alias("a")).hint("merge").join(table.select("word", F.col("id").alias("b")), "word")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == sum(n * n for n in Counter(i * 7919 % 97 for i in range(500)).values())
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.conf.get(name) == before
    drop()


def test_words_are_cut_at_every_blank(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words)), (2, "\t" + "\x0b".join(words) + "\r"), (3, "\x0c\x0c".join(reversed(words)) + "\n\t\n"), (4, "\xa0".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(r.removed) for r in linededup.removed_by_document(docs, "doc_id", "text").collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: []}
    ranks = linededup._ranks(docs, "text")
    kind = linededup._words_of(linededup._lines(docs, "doc_id", "text"), ranks).schema["_words"].dataType
    assert not kind.containsNull  # so they are sorted as plain numbers


def test_short_lines_against_all_pairs(spark):
    rows = [*made_lines(1), (600, "Les.\nno no no"), (601, "x\n Les.\nno\n\n"), (602, "a b c d " * 20 + "\nd c b a\n\n \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = removed_by_hand(rows, least=1)
    assert want[601] == [1, 2] and want[602] == [1]
    for r in linededup.removed_by_document(docs, "doc_id", "text", least=1).collect():
        assert list(r.removed) == want.get(r.doc_id, [])
    for r in corpus_pipeline.line_dedup(spark, docs, "").collect():
        lines = (dict(rows)[r.doc_id] or "").split("\n")
        assert (r.text or "") == "\n".join(x for n, x in enumerate(lines) if n not in want.get(r.doc_id, []))


# ---- queries and pipeline


@tables
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op") and q[2].isdigit()}
    for name in ("op3_top_k", "op8_line_dedup", "op13_url_filter"):
        df = entry.queries()[name](spark, SF)
        answer = con.execute(entry.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in answer.description], answer.fetchall())


def stage(spark, name, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


def test_stages_take_effect(spark):
    lines = made_lines(3)
    rows = [(i, t, "en", "s", 0) for i, t in lines]
    want = removed_by_hand(lines)
    for r in stage(spark, "line dedup", rows).collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.text.count("\n") + 1 == dict(lines)[r.doc_id].count("\n") + 1 - len(want.get(r.doc_id, [])) if r.text is not None else True
    base = " ".join(f"w{i}" for i in range(80))
    near = [(5, base, None, None, 1), (3, base + " more", "en", "s", 1), (9, "else " * 3, "en", "s", 1), (None, base, "en", "s", 1), (4, None, "en", "s", 1)]
    kept = stage(spark, "near dedup", near)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == {3, 9, None, 4}
    mixed = stage(spark, "source mixing", [(i, "a b c", "en", s, 5) for i, s in enumerate("aab")] + [(7, None, None, None, None)])
    assert Counter(r.doc_id for r in mixed.collect()) == {0: 1, 1: 1, 2: 2} or sum(1 for _ in mixed.collect()) in (4, 5)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, []).collect() == []


def test_stages_with_repeated_rows(spark):
    base, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "wv")
    near = [(1, base, "en", "s", 1), (1, base, "en", "s", 1), (1, other, "en", "s", 1), (2, base + " more", "en", "s", 1), (4, None, "en", "s", 1), (4, None, "en", "s", 1)]
    kept = stage(spark, "near dedup", near + [(None, base, "en", "s", 1)] * 2).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {(1, base): 1, (1, other): 1, (4, None): 1, (None, base): 2}
    rows = [(i % 3, "a b c", "en", "s", i) for i in range(15)] + [(None, "x " * (i % 4), None, "t", i) for i in range(30)]
    rows += [(7, "y " * i, "en", "s", 1) for i in (1, 2, 5)] + [(8, "one two", "en", None, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    planned = Counter()
    for r in mixing.mix(docs, "doc_id", "text", "source").collect():
        planned[r.source_size] += r.taken
    size, made = Counter(), Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for r in stage(spark, "source mixing", rows).collect():
        made[size[r.source]] += len(r.text.split())
    assert len(set(size.values())) == 3 and made == planned


@tables
def test_pipeline_runs_to_its_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path / str(len(steps)))
        function(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append((name, docs))
    assert all(d.columns == corpus_pipeline.COLUMNS for _, d in steps[:-1])
    texts = [(r.doc_id, r.text) for r in steps[-2][1].collect()]
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(made.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens) for r in steps[-1][1].collect()) == want
    kept = [(r.doc_id, r.text) for r in steps[2][1].collect()]
    assert len({c for _, c in components_by_hand(kept).values()}) == len(kept)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, steps[-1][1].collect()))
    assert whole.where(F.col("n_tokens") > 0).count() > 50
