"""Vector codes against plain loops over Python integers; URL filter against plain rules and sets."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import urlfilter, vectorcode
from strandloom.llm.queries import URL_RULES

# ---- vector codes


def codes_by_hand(rows, parts=8, entries=16, rounds=6, factor=4096):
    kept = [(k, v, y) for k, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(factor * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts if whole else 0
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[best(c[p], books[p])[1]].append(c[p])
            for e, of in members.items():
                books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    out, total = [], defaultdict(int)
    for (k, _, y), c in zip(kept, cut, strict=True):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append([k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), y])
        total[y] += out[-1][2]
    return sorted(((k, c, e, total[y]) for k, c, e, y in out), key=str), books


def vectors(spark, rows):
    shape = "vec_id bigint, embedding array<float>, label int, part string, _row int, entry int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], shape)


def check(spark, rows, **how):
    coded, books = vectorcode.codes(vectors(spark, rows), "vec_id", "embedding", "label", **how)
    want, by_hand = codes_by_hand(rows, **how)
    got = vectorcode.with_label_error(coded, "label").select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=str) == want
    flat = ",".join(str(x) for b in by_hand for e in b for x in e)
    assert vectorcode.digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_codes_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    rows = [(i * 3 % 401, (centres[i % 5] + rng.normal(size=16) * 0.2).astype("float32").tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(7000 + i, rows[11][1], 9) for i in range(200)]  # a third are copies
    rows += [rows[3], (rows[4][0], rows[5][1], 1), (None, rows[6][1], None)]  # repeated rows and keys, no key
    rows += [(-1, None, 1), (-2, [float("nan")] * 16, 1), (-3, [None] + [0.5] * 15, 1), (-4, [float("inf")] * 16, None)]
    check(spark, rows)
    check(spark, rows, parts=4, entries=3, rounds=2, factor=10)


def test_codes_of_few_equal_and_no_rows(spark):
    check(spark, [(i, [0.25, -0.5] * 4, 1) for i in range(30)])  # every entry is the same: ties to the first
    check(spark, [(1, [0.1] * 8, None), (2, [-0.1] * 8, 3)])
    none = vectors(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)])
    for table in (none, none.limit(0)):
        coded, books = vectorcode.codes(table, "vec_id", "embedding", "label")
        assert vectorcode.with_label_error(coded, "label").collect() == [] and vectorcode.digest(books)


def test_very_long_and_large_vectors(spark):
    rng = random.Random(2)
    check(spark, [(i, [float(rng.randint(-3, 3)) for _ in range(1024)], 0) for i in range(20)], rounds=2)
    check(spark, [(i, np.float32([rng.uniform(-9e4, 9e4) for _ in range(8)]).tolist(), i) for i in range(40)])
    with pytest.raises(Exception, match="can be coded"):
        vectorcode.codes(vectors(spark, [(1, [1e30] * 8, 1)]), "vec_id", "embedding", "label")
    with pytest.raises(ValueError, match="multiple"):
        vectorcode.codes(vectors(spark, [(1, [0.5] * 9, 1)]), "vec_id", "embedding", "label")


def test_only_parts_that_change_their_entry_move(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("float32").tolist(), 0) for i in range(300)]
    books = vectorcode.scaled(np.array([r[1] for r in rows[:4]]), 64).reshape(4, 8, 1).transpose(1, 0, 2)
    numbered = vectors(spark, rows).select(
        F.col("vec_id").alias("_row"), F.struct(F.col("vec_id").alias("_key"), F.col("label").alias("_label")).alias("_of"), F.col("embedding").alias("_vector")
    )
    shape = "_row bigint, position int, entry int, part array<int>, _of struct<_key:bigint,_label:int>"
    residents = vectorcode._owned(numbered.mapInArrow(vectorcode._cut(books, 64), shape), 5)
    assert residents.rdd.getNumPartitions() == 5
    moved = vectorcode._means(residents, books)
    judged = residents.mapInArrow(vectorcode._judge(moved), f"{shape}, now int, far bigint")
    stay, leave, _ = vectorcode._parted(judged)
    assert stay.count() + leave.count() == 8 * 300 and stay.count() == judged.where("now = entry").count() > leave.count() > 0


# ---- URLs

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM", "http://www.example.com/en/x", "http://a.example.com/en/", "http://example.com/enx",
    "https://x.net/es/1?q#f", "https://net/fr/", "https://xnet/fr/", "http://com/", "ftp://b.example.org/a/b.html?utm_source=f&b=2&a=1#t",
    "http://WWW.Spam.example.org:80/", "http://m.spam.example.org/p/q", "http://notspam.example.org/", "http://host:8080/a", "x://y://z/en/",
    "http://a.org\n/q", "http://b.example.org/a/b?a=1&b=2", "http://ünï.example.org/ä", "http://a.org/" + "é/" * 50_000, "http://?x", "http://#",
]


def judged_by_hand(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = "", ""
    for i, c in enumerate([*rest, "/"]):
        if c in "/?#":
            host, path = "".join(x.lower() if x.isascii() else x for x in rest[:i]), rest[i:]
            break
    path = path.split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    site = host.removeprefix("www.").removesuffix(":80")
    on = any(s.endswith("/") and (site == s[:-1] or site.endswith("." + s[:-1])) for s in listed)
    return host, path, None, "block" if host and on else "allow"


def test_rules_and_sites(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(1, "http://spam.example.org", "x", "y"), (None, "http://spam.example.org", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, _form string")
    listed = ["spam.example.org/", "other.org/", None, "spam.example.org/"]
    for bits in (1, 16):  # with two blocks almost everything may be on the list
        got = urlfilter.judge(pages, "page_id", "url", URL_RULES, spark.createDataFrame([(x,) for x in listed], "form string"), "form", bits).collect()
        want = [(i, *judged_by_hand(u, [x for x in listed if x])) for i, u, *_ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "form string")
    assert {r.verdict for r in urlfilter.judge(pages, "page_id", "url", [], none, "form").collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), "page_id", "url", URL_RULES, none, "form").collect() == []
    with pytest.raises(ValueError):
        urlfilter.bloom(none, "form", 20)


def test_canonical_urls(value):
    canonical = lambda u: value(urlfilter.canonical(F.lit(u)))
    assert canonical("HTTP://WWW.A.org:443/b/index.html?utm_source=x&c=2&b=1#f") == "a.org/b?b=1&c=2"
    assert canonical("https://a.org/b/") == canonical("http://a.org/b.html") == canonical("http://a.org/b") == "a.org/b"
    assert canonical("http://a.org") == canonical("http://a.org/?") == "a.org/" and canonical("a.org") is None and canonical(None) is None


def test_listed_pages_and_filter(spark):
    rng = random.Random(4)
    urls = [f"http://h{rng.randint(0, 50)}.org/p{i}" for i in range(3000)]
    listed = spark.createDataFrame([(u,) for u in urls[:300]], "u string").select(urlfilter.canonical(F.col("u")).alias("form"))
    pages = spark.createDataFrame(list(enumerate(urls)) + [(9999, urls[0].replace("http", "https") + "/#x")], "id int, url string")
    got = urlfilter.judge(pages, "id", "url", [], listed, "form", 8)
    assert sorted(r.id for r in got.where("verdict = 'block'").collect()) == [*range(300), 9999]
    forms = pages.select(urlfilter.canonical(F.col("url")).alias("form"))
    hits = urlfilter.possible(forms, "form", urlfilter.bloom(listed, "form")).count()
    assert 301 <= hits <= 320  # all that are listed, hardly any other
