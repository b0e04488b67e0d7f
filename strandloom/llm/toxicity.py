"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a labelled sample. The ordinary one is trained on windows
of ordinary texts. The toxic one holds the same and, in front, what is typical of toxic texts:
words that stand in many different contexts there and in hardly any in ordinary texts. Counting
contexts instead of occurrences keeps out what is merely repeated in copies of a toxic text.
Every text is lower-cased and cut into overlapping windows; a window that the toxic dictionary shortens by more
bytes than the ordinary one speaks for toxicity. As the dictionaries share what is ordinary, other windows differ by a
byte or two at most.

How many windows exceed each threshold, in total and as a share, the largest and the mean difference and the number of windows go
into a logistic regression, which is the calibration. It is fitted on differences that
dictionaries from the other half of the sample give, so no text is measured with what it taught.

The sample has at most `most_toxic` and `most_ordinary` labelled rows, the first by a hash of the
key. All texts are scored as a whole; a null text is empty. Without toxic or ordinary labels to learn
from, all scores are 0; an empty table has no scores. Very long texts are cut into windows like others. Repeated rows
are scored one by one; of repeated labels the highest counts; equal hashes of the sample are ordered by the key. Only
the columns named are read, so names of others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.batches import slices
from strandloom.plans.session import checkpointed

WINDOW, STEP, LEVEL = 64, 32, 12
THRESHOLDS, FOLDS = tuple(range(1, 9)), 5
ORDINARY_BYTES, TOXIC_WORDS = 1 << 16, 1 << 12
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Distance:
    """Bytes that the toxic dictionary saves against the ordinary one, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.parts = ordinary, toxic
        self.one, self.other = (self._compressor(c) for c in (ordinary, toxic + ordinary))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        content = content or b"\n" * 8  # a dictionary has 8 bytes at least
        dictionary = zstandard.ZstdCompressionDict(content.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def __call__(self, text: bytes) -> np.ndarray:
        one, other = self.one.compress, self.other.compress
        windows = [text[i : i + WINDOW] for i in range(0, max(1, len(text) - STEP), STEP)]
        return np.fromiter((len(one(w)) - len(other(w)) for w in windows), np.int64, len(windows))

    def features(self, text: bytes) -> list[float]:
        saved = self(text)
        over = np.array([(saved >= t).sum() for t in THRESHOLDS], float)
        return [1.0, *np.sqrt(over), *np.sqrt(20 * over / len(saved)), float(saved.max()), float(np.log(len(saved))), float(saved.mean())]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, regularised on the features' own scale, by Newton's method."""
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    x = x / scale
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to eight windows from all over each text."""
    for batch in batches:
        fold, out = [], []
        for f, text in zip(batch["_fold"].to_pylist(), batch["_text"].to_pylist(), strict=True):
            data = (text or "").lower().encode()
            for at in np.linspace(0, max(0, len(data) - WINDOW), 8).astype(int):
                fold.append(f)
                out.append(data[at : at + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(out, pa.binary())], ["_fold", "window"])


def _ordinary(windows: list[bytes]) -> bytes:
    """A dictionary trained on ordinary windows; of few windows, the windows themselves."""
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, windows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(windows)[:ORDINARY_BYTES]


def _toxic(words: list[tuple[str, int]]) -> bytes:
    """The typical words, those of most contexts last, where matches are cheapest."""
    best = sorted(words, key=lambda w: (w[1], w[0]))[-TOXIC_WORDS:]
    return b"".join(b" " + w.encode() for w, _ in best)


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, most_toxic: int, most_ordinary: int) -> DataFrame:
    """`(_key, _text, _toxic, _fold)` of the labelled rows to learn from."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col(toxic)).cast("int").alias("_toxic")
    )
    known = known.withColumn("_hash", F.xxhash64(F.lit("sample"), F.col("_key").cast("string")))
    few = [known.where(F.col("_toxic") == c).orderBy("_hash", "_key").limit(n) for c, n in ((1, most_toxic), (0, most_ordinary))]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # most_toxic + most_ordinary rows
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fold = F.pmod("_hash", F.lit(FOLDS)).cast("int").alias("_fold")
    return checkpointed(rows.join(chosen, "_key").select("_key", "_text", "_toxic", fold))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, ended by a blank, and beginnings of words, each with the word before it."""
    for part in slices(batches, "_text"):
        out: list[tuple[int, int, str, str]] = []
        for toxic, fold, text in zip(*(part[c].to_pylist() for c in ("_toxic", "_fold", "_text")), strict=True):
            words = _WORD.findall((text or "").lower())
            pairs = {(f"{w} ", p) for w, p in zip(words, ["", *words], strict=False)}
            pairs |= {(w[:n], p) for w, p in zip(words, ["", *words], strict=False) for n in BEGINNINGS if len(w) > n}
            out += [(toxic, fold, w, p) for w, p in pairs]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
            ["_toxic", "_fold", "w", "p"],
        )


def _typical(sample: DataFrame, least: int = 4, odds: float = 20.0) -> list[tuple[str, list[int]]]:
    """Words and beginnings of at least `least` toxic contexts, `odds` times as many as ordinary
    texts let expect, with their toxic contexts in every fold."""
    contexts = checkpointed(sample.repartition("_key").mapInArrow(_contexts, "_toxic int, _fold int, w string, p string").distinct())
    bad = F.col("_toxic") == 1
    totals = contexts.agg(F.count_if(bad), F.count_if(~bad)).first()
    if not totals[0] or not totals[1]:
        return []
    each = F.array(*(F.count_if(bad & (F.col("_fold") == f)) for f in range(FOLDS)))
    counted = contexts.groupBy("w").agg(each.alias("each"), F.count_if(bad).alias("a"), F.count_if(~bad).alias("b"))
    share = (F.col("a") + 0.5) / (totals[0] + 1) / ((F.col("b") + 0.5) / (totals[1] + 1))
    best = counted.where((F.col("a") >= least) & (share >= odds)).orderBy(F.desc("a"), "w").limit(TOXIC_WORDS)
    return [(r["w"], r["each"]) for r in best.collect()]


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, most_toxic: int = 2000, most_ordinary: int = 6000) -> Model | None:
    """Learn from the labelled rows of `docs`."""
    sample = sampled(docs, labels, key, text, toxic, most_toxic, most_ordinary)
    words = _typical(sample)
    windows = sample.where("_toxic = 0").mapInArrow(_windows, "_fold int, window binary").collect()
    if not windows or sample.where("_toxic = 1").isEmpty():
        return None
    pieces = [[bytes(w["window"]) for w in windows if w["_fold"] == f] for f in range(FOLDS)]

    def without(fold: int | None) -> tuple[bytes, bytes]:
        """The dictionaries of all folds but one."""
        used = [f for f in range(FOLDS) if f != fold]
        known = [(w, sum(each[f] for f in used)) for w, each in words]
        return _ordinary([x for f in used for x in pieces[f]]), _toxic([k for k in known if k[1] >= 3])

    others = [without(f) for f in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = [Distance(*h) for h in shared.value]
        for batch in batches:
            rows = [distance[f].features((t or "").lower().encode()) for f, t in zip(batch["_fold"].to_pylist(), batch["_text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_toxic"], pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.repartition("_key").mapInArrow(measured, "y int, x array<double>").collect()
    weights = logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))
    return Model(*without(None), weights)


def score(docs: DataFrame, key: str, text: str, model: Model | None, more: dict[str, Column]) -> DataFrame:
    """`(key, more, score, predicted)` for every row; `more` are columns over `_key`."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        distance = Distance(known.ordinary, known.toxic) if known else None
        for part in slices(batches, "_text"):
            if known:
                x = np.array([distance.features((t or "").lower().encode()) for t in part["_text"].to_pylist()])
                chance = 1 / (1 + np.exp(-np.clip(x @ known.weights, -30, 30)))
            else:
                chance = np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part["_key"], pa.array(chance)], ["_key", "score"])

    out = rows.mapInArrow(run, f"_key {kind}, score double")
    return out.select(
        F.col("_key").alias(key), *(c.alias(n) for n, c in more.items()), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
