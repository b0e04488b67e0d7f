"""Language identification by sparse multinomial logistic regression.

Features are character 1-, 2- and 3-grams of the lower-cased text, hashed to `BUCKETS`. A
feature's value is its share of the text's n-grams times the inverse document frequency, which is counted over
all texts that may be learned from. The weights are learned by follow-the-regularised-leader
with per-coordinate rates and an elastic net: the l1 part keeps a coordinate at exactly 0 until
its gradients outweigh it. Learning takes a sample of about `per_language` texts of every
language, chosen by a hash of the key, in `SHARDS` shards whose weights are averaged. A fifth of the
sample is set aside for the temperature that makes the highest probability a calibrated score.

Texts that are null or have no letter get the language `und` with score 0; so do all texts if
there is nothing to learn from. A text with letters always gets a learned language. Repeated rows are
scored one by one, very long texts as a whole; of equally likely languages the first in order is given. An empty
table gives an empty result. At most `LABELS` languages can be learned, more are an error. The language column is read of
the rows to learn from only; names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.batches import slices
from strandloom.plans.session import checkpointed

BUCKETS, ORDERS, SHARDS = 1 << 15, (1, 2, 3), 4
LABELS = 200  # each has a weight per bucket, so the model has 50 MB at most
#: Brings a typical text's vector to about length 1.
SCALE = 16.0
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and where each text's begin (one more at the end)."""
    lower = [(t or "").lower() for t in texts]
    length = np.array([len(t) for t in lower], np.int64)
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lower)), length)
    out, rows = [], []
    for order in ORDERS:
        n = max(len(code) - order + 1, 0)
        value = np.zeros(n, np.uint32)
        for i in range(order):
            value = (value ^ code[i : i + n]) * _FACTORS[i]
            value ^= value >> np.uint32(15)
        value = (value * np.uint32(0x27D4EB2F)) >> np.uint32(17)
        inside = row[:n] == row[order - 1 :] if n else np.zeros(0, bool)
        out.append(value[inside])
        rows.append(row[:n][inside])
    count = sum(np.bincount(r, minlength=len(lower)) for r in rows)
    places = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(places[-1]), np.int32)
    at = places[:-1].copy()
    for value, r in zip(out, rows, strict=True):
        size = np.bincount(r, minlength=len(lower))
        flat[np.arange(len(r)) + np.repeat(at - (np.cumsum(size) - size), size)] = value
        at += size
    return flat, places


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, np.int64)  # the last one counts texts
    for part in slices(batches, "_text", 1 << 20):
        flat, places = features(part["_text"].to_pylist())
        for a, b in zip(places, places[1:], strict=False):
            seen = np.zeros(BUCKETS, bool)
            seen[flat[a:b]] = True
            total[:-1] += seen
        total[-1] += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])


def learn(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 3, rate: float = 1.0,
          smooth: float = 1.0, l1: float = 1e-2, l2: float = 1e-4) -> np.ndarray:
    """Weights (buckets x classes) after `epochs` passes over sparse rows of (buckets, values)."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(rows):
        zr, nr = z[rows], n[rows]
        shrunk = np.sign(zr) * np.maximum(np.abs(zr) - l1, 0)
        return -shrunk / ((smooth + np.sqrt(nr)) / rate + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            rows, values = vectors[i]
            w = weights(rows)
            logits = values @ w
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            gradient = values[:, None] * chance[None, :]
            square = n[rows] + gradient**2
            z[rows] += gradient - (np.sqrt(square) - np.sqrt(n[rows])) / rate * w
            n[rows] = square
    return weights(slice(None))


def logits(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Scores of every class (weights times inverse document frequency, summed and averaged)."""
    flat, places = features(texts)
    size = np.diff(places)
    out = np.zeros((len(texts), weights.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        for c in range(weights.shape[1]):
            sums = np.concatenate([[0], np.cumsum(weights[:, c][flat], dtype=np.float64)])
            out[:, c] = np.diff(sums[places])
        out[full] /= size[full, None]
    return out


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the labels most likely."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = scores / np.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, temperature: float):
        self.languages, self.weights, self.temperature = languages, weights, temperature

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        scores = logits(texts, self.weights) / self.temperature
        chance = np.exp(scores - scores.max(1, keepdims=True))
        return scores.argmax(1), chance.max(1) / chance.sum(1)


def train(docs: DataFrame, key: str, text: str, lang: str, per_language: int = 3000) -> Model | None:
    """Learn from all rows of `docs` whose language is not null."""
    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.where("_lang is not null and _text is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(LABELS + 1).collect()}
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    frequent = rows.mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    count = np.zeros(BUCKETS + 1)
    for r in frequent.collect():  # one row per bucket
        count[r["bucket"]] = r["n"]
    idf = np.log((1 + count[-1]) / (1 + count[:-1])) + 1
    share = F.create_map(*(x for l in languages for x in (F.lit(l), F.lit(min(1.0, per_language / sizes[l])))))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "_key"), F.lit(1 << 30)) / float(1 << 30)
    sample = checkpointed(
        rows.where(drawn < F.element_at(share, F.col("_lang")))
        .withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_key"), F.lit(5 * SHARDS)))
    )
    shared = docs.sparkSession.sparkContext.broadcast((languages, idf))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names, weight = shared.value
        rows = rows.sort_values(["_key", "_text"])
        vectors = []
        for at in range(0, len(rows), 256):
            flat, places = features(rows["_text"].iloc[at : at + 256].tolist())
            for a, b in zip(places, places[1:], strict=False):
                bucket, times = np.unique(flat[a:b], return_counts=True)
                vectors.append((bucket, times / max(b - a, 1) * SCALE * weight[bucket]))
        labels = np.array([names.index(x) for x in rows["_lang"]])
        return pd.DataFrame({"w": [learn(vectors, labels, len(names)).astype(np.float32).tobytes()], "n": [len(rows)]})

    shards = sample.where(F.col("_part") >= SHARDS).groupBy(F.pmod("_part", F.lit(SHARDS)).alias("_shard")).applyInPandas(fit, "w binary, n bigint").collect()
    if not shards:
        shards = sample.groupBy(F.lit(0)).applyInPandas(fit, "w binary, n bigint").collect()
    total = sum(s["n"] for s in shards)
    mean = sum(np.frombuffer(bytes(s["w"]), np.float32).reshape(BUCKETS, -1).astype(np.float64) * (s["n"] / total) for s in shards)
    model = Model(languages, mean * idf[:, None] * SCALE, 1.0)
    weighted = docs.sparkSession.sparkContext.broadcast(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            found = logits(part["_text"].to_pylist(), weighted.value)
            yield pa.RecordBatch.from_arrays([part["_lang"], pa.array(list(found), pa.list_(pa.float64()))], ["_lang", "x"])

    kept = sample.where(F.col("_part") < SHARDS).mapInArrow(scored, "_lang string, x array<double>").collect()
    if kept:
        labels = np.array([languages.index(r["_lang"]) for r in kept])
        model.temperature = temperature(np.array([r["x"] for r in kept]), labels)
    return model


def predict(docs: DataFrame, key: str, text: str, model: Model | None, more: dict[str, Column]) -> DataFrame:
    """`(key, more, lang_pred, score)` for every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    if model is None:
        return rows.select(F.col("_key").alias(key), *(c.alias(n) for n, c in more.items()), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, "_text", 1 << 20):
            best, chance = known.predict(part["_text"].to_pylist())
            letter = part["_letter"].to_numpy(zero_copy_only=False)
            names = [known.languages[b] if x else "und" for b, x in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([part["_key"], pa.array(names), pa.array(np.where(letter, chance, 0.0))], ["_key", "lang_pred", "score"])

    out = rows.mapInArrow(run, f"_key {kind}, lang_pred string, score double")
    return out.select(F.col("_key").alias(key), *(c.alias(n) for n, c in more.items()), "lang_pred", "score")
