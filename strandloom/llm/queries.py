"""The registered queries of the operators here, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import attribution, bpe, crosstoken, langid, linededup, mixing, neardup, quality, tokenfile, topk, toxicity, urlfilter, vectorcode
from strandloom.plans.session import shared_folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = [t.where(_part_of("doc_id", 5) != 0) for t in (docs, labels)]
    model = toxicity.train(*learn, "doc_id", "text", "toxic")
    held_out = F.coalesce(F.crc32(F.col("_key").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, "doc_id", "text", model, {"held_out": held_out})


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, factor=64)


def _part_of(key: str, parts: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % parts


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.where(_part_of("doc_id", 3) != 1), "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("_key").cast("string")) % 3 == 1, F.lit(False))
    return langid.predict(docs, "doc_id", "text", model, {"held_out": held_out})


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    judged = quality.judge(docs, "text", "lang", carried=["doc_id"])
    return judged.select("row.doc_id", *quality.COUNTS, "base_failed", "kept", "bits")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), "doc_id", "text", "source")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_documents(spark, sf_dir), "doc_id", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.removed_by_document(_documents(spark, sf_dir), "doc_id", "text")
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenfile.written_and_read(spark, _documents(spark, sf_dir), "doc_id", "text", path, 2, folder)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return attribution.token_counts(_documents(spark, sf_dir), "doc_id", "text", path, rule="majority")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = vectorcode.codes(vectors, "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, factor=4096)
    rows = vectorcode.with_label_error(coded, "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vectorcode.digest(books)).alias("codebooks_sha256"))


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return crosstoken.alignments(spark, _documents(spark, sf_dir), "doc_id", "text", *paths, folder)


#: Rules of the query, and names of sites whose pages are unwanted. Fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UNWANTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
_UNWANTED_SITE = rf"(?:^|\.)((?:{'|'.join(UNWANTED)})\..*)$"


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list has the sites of unwanted names that occur in the pages, as canonical URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    site = F.regexp_extract(urlfilter.host_of(F.col("url")), _UNWANTED_SITE, 1)
    listed = pages.select(site.alias("site")).where("site <> ''").select(F.concat("site", F.lit("/")).alias("form"))
    return urlfilter.judge(pages, "page_id", "url", URL_RULES, listed, "form")


QUERIES = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_toxicity": op2_toxicity,
    "op3_top_k": op3_top_k,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_source_mixing": op6_source_mixing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_url_filter": op13_url_filter,
}
_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_LINES_SQL = """
WITH numbered AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM numbered
), worded AS (
  SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS words
  FROM lines
), sets AS (
  SELECT words, len(words) AS n, min(ROW(doc_id, no)) AS first, row_number() OVER () AS id
  FROM worded WHERE len(words) >= 1 GROUP BY words
), tokens AS (
  SELECT id, n, unnest(words) AS word FROM sets
), rare AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, word) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY word) AS c FROM tokens)
), prefix AS (
  SELECT id, n, word FROM rare WHERE place <= n - (85 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b USING (word)
  WHERE a.id <> b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
), near AS (
  SELECT DISTINCT y.id FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  WHERE x.first < y.first
    AND len(list_intersect(x.words, y.words)) * 100 >= (x.n + y.n - len(list_intersect(x.words, y.words))) * 85
), gone AS (
  SELECT w.doc_id, w.no FROM worded w JOIN sets s ON s.words = w.words
  WHERE ROW(w.doc_id, w.no) > s.first OR s.id IN (SELECT id FROM near)
), listed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM numbered LEFT JOIN listed USING (doc_id)
"""

_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

_URLS_SQL = f"""
WITH rules(of, start, verdict) AS (VALUES {_RULES_SQL}),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), ruled AS (
  SELECT DISTINCT host, path, arg_max(of || start, len(of || start)) OVER w AS rule, arg_max(verdict, len(of || start)) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start)
  WINDOW w AS (PARTITION BY host, path)
), sites AS (
  SELECT DISTINCT regexp_extract(host, '{_UNWANTED_SITE}', 1) AS site FROM split
), hosts AS (
  SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM split) h JOIN sites ON site <> '' AND (h.host = site OR ends_with(h.host, '.' || site))
)
SELECT page_id, s.host, s.path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN hosts.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM split s LEFT JOIN ruled USING (host, path) LEFT JOIN hosts USING (host)
"""

ORACLES: dict[str, str] = {"op3_top_k": _TOP_K_SQL, "op8_line_dedup": _LINES_SQL, "op13_url_filter": _URLS_SQL}
