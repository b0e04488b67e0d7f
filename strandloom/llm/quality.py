"""Quality rules: simple counts per document, then the perplexity of a character model.

The model is an interpolated modified Kneser-Ney model of order 5 over the bytes of UTF-8 as they are: 256 symbols and
one that stands before a text. N-grams are digits to the base 257 in 64 bits, which no two share. They are counted over
all whole texts; a task sums up what it has read before it shuffles, some MB at a time. Their number grows with the corpus, so
counts of the shorter n-grams, discounts, sums per context and interpolation are Spark jobs over tables, and nothing but the
counts of counts goes to the driver.

No text is scored by a model that has counted it, as that would know its garbage by heart: texts are dealt to two
halves by their hash (equal texts to the same one), each half has a model, and a text is scored by that of the other
half. Probabilities are made for all n-grams of both halves, so that none is missing when texts are scored.

The probabilities lie in shards, files of the shared folder. A task reads each shard once and keeps `ROOM` n-grams (128 MB); of a
larger model, it reads the other shards again for every 512 kB of texts. They are searched by bisection for what differs in those.

A document is rejected outside its language's band of log2-perplexity. The band lies around the
median of the language's documents that pass the base rules. Its half width is `spread` times the
distance of the quartiles of their deviations, each times the root of the length, over
the root of the document's length, as short texts scatter more; at least `least`. Documents
whose language is null have a band of their own. Perplexity is that of all bytes per byte of a letter or digit, which is
also the length: marks and blanks that are easy to foresee would hide the rest of a text, if they counted as length.

Null and empty texts have no words and fail the base rules. Very long texts are counted and scored whole. Repeated rows
count each. An empty table gives an empty result. Columns are carried in a struct, so their names cannot clash; a
document on the edge of its band is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.batches import SEPARATOR, line_hashes, mixed, slices, strings, words
from strandloom.plans.session import checkpointed, dropped, shared_folder

ORDER, CLASSES = 5, 257
MOST, SHARD, ROOM = 3 << 19, 1 << 20, 8 << 20  # n-grams that a task counts at once, of a shard, that a task keeps
BLOCK = 1 << 19  # bytes worked on together
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTER = np.arange(256) > 127
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_CLASS = np.arange(1, CLASSES)  # every byte is a symbol of its own; 0 stands before the first byte of a text


def ngrams(data: np.ndarray, places: np.ndarray, order: int = 4) -> np.ndarray:
    """The n-gram that ends at every byte, texts being padded with symbol 0 in front."""
    sizes = np.diff(places)
    padded = np.zeros(len(data) + (order - 1) * len(sizes), np.int64)
    at = np.arange(len(data)) + np.repeat((order - 1) * np.arange(1, len(sizes) + 1), sizes)
    padded[at] = _CLASS[data]
    key = padded.copy()
    for back in range(1, order):
        key[back:] += padded[: len(padded) - back] * CLASSES**back
    return key[at]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(part) for part in zip(*held, strict=True))
    order = np.argsort(code)
    code, n = code[order], n[order]
    heads = np.flatnonzero(np.diff(code, prepend=-1))
    return code[heads], np.add.reduceat(n, heads) if len(heads) else n


def _halves(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of ascending n-grams with their half as last bit, as a row per n-gram."""
    heads = np.flatnonzero(np.diff(code >> 1, prepend=-1))
    for at in range(0, len(heads), 1 << 16):
        some = heads[at : at + (1 << 16)]
        end = heads[at + len(some)] if at + len(some) < len(heads) else len(code)
        both = np.zeros((2, len(some)), np.int64)
        mine = code[some[0] : end]
        both[mine & 1, np.searchsorted(some, np.arange(some[0], end), "right") - 1] = n[some[0] : end]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code[some] >> 1, *both)], ["key", "a", "b"])


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, 0
        for part in slices(batches, "_text", BLOCK):
            data, places = strings(part["_text"])
            keys = ngrams(data, places, order) * 2 + np.repeat(part["_half"].to_numpy(), np.diff(places))
            for at in range(0, len(keys), BLOCK):
                held.append(np.unique(keys[at : at + BLOCK], return_counts=True))
                size += len(held[-1][0])
                if size <= whole + BLOCK:
                    continue
                held = [_merged(held)]
                size = whole = len(held[0][0])
                if whole > MOST:
                    yield from _halves(*held[0])
                    held, size, whole = [], 0, 0
        if held:
            yield from _halves(*_merged(held))

    return run


def half_of(text: str) -> Column:
    """The half, 0 or 1, that a text belongs to."""
    return F.xxhash64(text).bitwiseAND(F.lit(1))


def count_ngrams(docs: DataFrame, text: str, order: int = 4) -> DataFrame:
    """`(key, a, b)`: how often every n-gram occurs in the texts of each half."""
    counted = docs.select(F.col(text).alias("_text"), half_of(text).alias("_half")).mapInArrow(_counted(order), "key bigint, a bigint, b bigint")
    return counted.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _discounts(of: list[int]) -> list[float]:
    """What n-grams seen once, twice and more often lose, from the numbers of those seen 1 to 4 times."""
    share = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.0
    return [min(max(i - (i + 1) * share * of[i] / of[i - 1], 0.05), i - 0.05) if of[i - 1] else 0.5 * i for i in (1, 2, 3)]


def probabilities(counted: DataFrame, order: int) -> tuple[DataFrame, list[DataFrame]]:
    """`(key, a, b)`: the probability of every n-gram's last symbol after those before, by the model of
    each half; and the tables that this is read from."""
    levels = {order: counted}
    for n in range(order - 1, 0, -1):  # in how many different contexts the shorter n-gram is seen
        seen = (F.sum((F.col(c) > 0).cast("bigint")).alias(c) for c in "ab")
        levels[n] = checkpointed(levels[n + 1].groupBy((F.col("key") % CLASSES**n).alias("key")).agg(*seen))
    few = None
    for n, table in levels.items():
        times = (F.coalesce(F.sum((F.col(c) == i).cast("bigint")), F.lit(0)).alias(f"{c}{i}") for c in "ab" for i in range(1, 5))
        row = table.agg(*times).select(F.lit(n).alias("n"), "*")
        few = row if few is None else few.unionByName(row)
    off = {r["n"]: {c: _discounts([r[f"{c}{i}"] for i in range(1, 5)]) for c in "ab"} for r in few.collect()}  # a row per order
    lower = None
    for n in range(1, order + 1):
        context = Window.partitionBy(F.expr(f"key div {CLASSES}"))
        loss = {c: F.when(F.col(c) > 2, off[n][c][2]).when(F.col(c) == 2, off[n][c][1]).when(F.col(c) == 1, off[n][c][0]).otherwise(0.0) for c in "ab"}
        sums = [x for c in "ab" for x in ((F.col(c) - loss[c]).alias(f"{c}_own"), F.sum(c).over(context).alias(f"{c}_all"), F.sum(loss[c]).over(context).alias(f"{c}_free"))]
        table = levels[n].select("key", *sums)
        if lower is None:
            table = table.select("*", *(F.lit(1 / CLASSES).alias(f"{c}_low") for c in "ab"))
        else:
            table = table.join(lower.select(F.col("key").alias("_of"), *(F.col(c).alias(f"{c}_low") for c in "ab")), F.col("key") % CLASSES ** (n - 1) == F.col("_of"))
        chance = "{0}_own / {0}_all + {0}_free / {0}_all * {0}_low"
        lower = table.select("key", *(F.when(F.col(f"{c}_all") > 0, F.expr(chance.format(c))).otherwise(F.col(f"{c}_low")).alias(c) for c in "ab"))
    return lower, list(levels.values())


def written(docs: DataFrame, text: str) -> tuple[str, int]:
    """Make the models of both halves; the folder and the number of the shards that they are in: n-grams with log2 of
    the probabilities that score a text of half 0 and of half 1."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/model-{uuid.uuid4().hex}"
    counted = checkpointed(count_ngrams(docs, text, ORDER))
    number = max(1, -(-counted.count() // SHARD))
    chances, tables = probabilities(counted, ORDER)
    table = chances.select("key", F.log2("b").cast("float").alias("x0"), F.log2("a").cast("float").alias("x1"), (F.col("key") % number).alias("shard"))
    table.repartition("shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)
    for table in tables:
        dropped(table)
    return folder, number


class Shards:
    """The n-grams of a model's files and their scores, read as they are needed."""

    def __init__(self, folder: str, number: int):
        self.folder, self.number = folder, number
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.free = ROOM

    def _read(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard in self.held:
            return self.held[shard]
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(f"{path}/shard={shard}", allow_not_found=True))
        names = [f.path for f in found if f.path.endswith(".parquet")]
        tables = [pq.ParquetFile(system.open_input_file(name)).read(["key", "x0", "x1"]) for name in names]
        if not tables:
            return np.zeros(0, np.int64), np.zeros((2, 0), np.float32)
        table = pa.concat_tables(tables)
        key, scores = table["key"].to_numpy(), np.stack([table["x0"].to_numpy(), table["x1"].to_numpy()])
        if len(names) > 1:
            order = np.argsort(key)
            key, scores = key[order], scores[:, order]
        if len(key) <= self.free:
            self.held[shard] = key, scores
            self.free -= len(key)
        return key, scores

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """For each half, log2 of the probabilities of different n-grams of its texts."""
        out, of = np.zeros((2, len(keys)), np.float32), keys % self.number
        for shard in range(self.number):
            mine = np.flatnonzero(of == shard)
            if not len(mine):
                continue
            known, scores = self._read(shard)
            at = np.searchsorted(known, keys[mine])
            if not len(known) or (known[np.minimum(at, len(known) - 1)] != keys[mine]).any():
                raise ValueError("the texts to score are not those that were counted")
            out[:, mine] = scores[:, at]
        return out


class Model:
    """The model of a small table in one process, for any n-gram: what `probabilities` is compared with. Per order:
    ascending n-grams with log2 probabilities, contexts with log2 backoffs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, length: int = 4):
        order = np.argsort(keys)
        levels = [(keys[order].astype(np.int64), counts[order].astype(np.float64))]
        for n in range(length - 1, 0, -1):  # in how many different contexts the shorter n-gram is seen
            shorter, seen = np.unique(levels[-1][0] % CLASSES**n, return_counts=True)
            levels.append((shorter, seen.astype(np.float64)))
        self.orders: list[tuple[np.ndarray, ...]] = []
        below = None
        for key, count in reversed(levels):
            off = _discounts([int((count == i).sum()) for i in range(1, 5)])
            discount = np.choose(np.minimum(count, 3).astype(int) - 1, off)
            context, head = np.unique(key // CLASSES, return_index=True)
            total = np.add.reduceat(count, head) if len(head) else np.zeros(0)
            free = np.add.reduceat(discount, head) / total if len(head) else np.zeros(0)
            at = np.searchsorted(context, key // CLASSES)
            lower = np.full(len(key), 1 / CLASSES) if below is None else 2 ** self._log(below, key % CLASSES ** below)
            chance = (count - discount) / total[at] + free[at] * lower
            self.orders.append((key, np.log2(chance).astype(np.float32), context, np.log2(free).astype(np.float32)))
            below = len(self.orders)

    def _log(self, order: int, keys: np.ndarray) -> np.ndarray:
        if not order:
            return np.full(len(keys), -np.log2(CLASSES), np.float32)
        known, chance, context, free = self.orders[order - 1]
        if not len(known):
            return self._log(order - 1, keys % CLASSES ** max(order - 1, 0))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = chance[at].copy()
        miss = np.flatnonzero(known[at] != keys)
        if len(miss):
            rest = self._log(order - 1, keys[miss] % CLASSES ** (order - 1))
            where = np.minimum(np.searchsorted(context, keys[miss] // CLASSES), len(context) - 1)
            out[miss] = rest + np.where(context[where] == keys[miss] // CLASSES, free[where], 0)
        return out

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last class after the ones before."""
        return self._log(len(self.orders), keys)


def train(docs: DataFrame, text: str, order: int = 4) -> Model:
    """The model of all texts of a small table."""
    table = count_ngrams(docs, text, order).toArrow()
    return Model(table["key"].to_numpy(), table["a"].to_numpy() + table["b"].to_numpy(), order)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of the base rules for every string."""
    found = words(column)
    data, places, rows = found.data, found.places, len(found.count)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[places])

    owner, begin, end, value = line_hashes(data, places)
    first = np.searchsorted(found.begin, begin)
    worded = np.flatnonzero(np.searchsorted(found.begin, end) > first)
    marks = mixed(value[worded] ^ mixed(owner[worded].astype(np.uint64) + np.uint64(1)))
    fresh = np.unique(marks, return_index=True)[1]
    lines = np.bincount(owner[worded], minlength=rows) - np.bincount(owner[worded[fresh]], minlength=rows)
    window, head = found.windows(found.hashes(), 5)
    marks = mixed(window ^ mixed(found.row[head].astype(np.uint64) + np.uint64(1)))
    _, inverse, times = np.unique(marks, return_inverse=True, return_counts=True)
    twice = head[times[inverse] > 1]
    edge = np.zeros(len(found.row) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": found.count,
        "word_chars": per_row(~SEPARATOR[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(found.row[covered], minlength=rows),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(folder: str, number: int, kept: list[str], field: str | None = None):
    """Counts and bits of `_text`, or of this field of `row`, which is then sent to Python once."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.struct_field(batch["row"], field) if field else batch["_text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), batch["_half"], text], [*kept, "_half", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Shards(folder, number)
        for part in slices(texts(batches), "_text", BLOCK):
            data, places = strings(part["_text"])
            size = np.diff(places)
            keys, half = ngrams(data, places, ORDER), np.repeat(part["_half"].to_numpy(), size)
            scores = np.zeros(len(keys), np.float32)
            for at in range(0, len(keys), BLOCK):
                some = slice(at, at + BLOCK)
                different, which = np.unique(keys[some], return_inverse=True)
                scores[some] = model.log2(different)[half[some], which]
            sums = np.diff(np.concatenate([[0], np.cumsum(scores, dtype=np.float64)])[places])
            found = counts(part["_text"])
            letters = np.maximum(np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[places]), 1)
            bits = -sums / letters
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in kept), *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(letters), pa.array(bits)],
                [*kept, *COUNTS, "n_letters", "bits"],
            )

    return run


def judge(docs: DataFrame, text: str, lang: str, spread: float = 3.0, least: float = 0.06, carried: list[str] | None = None) -> DataFrame:
    """The columns `carried` (all) of every row in a struct `row`, the counts, `base_failed`, `bits` (log2 of the
    perplexity per byte of a letter or digit) and `kept`. Nothing is joined by a key, so nulls and repeated rows are no matter."""
    carried = docs.columns if carried is None else carried
    rows = docs.select(F.struct(*carried).alias("row"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), half_of(text).alias("_half"))
    model = written(docs, text)
    kind = rows.schema["row"].dataType.simpleString()
    shape = "_lang string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", n_letters bigint, bits double"
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if text in carried:
        # Scores alone are written for the bands; texts are scored again rather than written with them.
        scores = checkpointed(rows.select("_lang", "_half", "_text").mapInArrow(_scored(*model, ["_lang"]), shape))
        whole = rows.select("row", "_lang", "_half").mapInArrow(_scored(*model, ["row", "_lang"], text), f"row {kind}, {shape}")
    else:
        scores = whole = checkpointed(rows.mapInArrow(_scored(*model, ["row", "_lang"]), f"row {kind}, {shape}"))
    scored = whole.withColumn("base_failed", failed)
    good = scores.where(~failed).select("_lang", "n_letters", "bits")
    middle = good.groupBy("_lang").agg(F.percentile_approx("bits", 0.5, 10000).alias("_middle"))
    middle = _small(checkpointed(middle.withColumnRenamed("_lang", "_of")))
    off = (F.col("bits") - F.col("_middle")) * F.sqrt("n_letters")
    quartiles = F.percentile_approx(off, [0.25, 0.75], 10000)
    near = good.join(middle, F.col("_lang").eqNullSafe(F.col("_of"))).groupBy("_of", "_middle").agg(quartiles.alias("_q"))
    bands = _small(checkpointed(near.select("_of", "_middle", (spread * (F.col("_q")[1] - F.col("_q")[0])).alias("_wide"))))
    half = F.greatest(F.lit(least), F.col("_wide") / F.sqrt("n_letters"))
    inside = F.abs(F.col("bits") - F.col("_middle")) <= half
    out = scored.join(bands, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return out.select("row", *COUNTS, "base_failed", kept.alias("kept"), F.round("bits", 4).alias("bits"))


def _small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of one row per language, to be broadcast if it has few."""
    return F.broadcast(table) if table.count() <= most else table
