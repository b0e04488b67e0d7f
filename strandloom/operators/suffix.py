"""Suffix arrays by prefix doubling, with longest common prefixes, of single texts or groups of them.

Sorting whole suffixes moves a number of bytes quadratic in the text. Here positions are
ranked by windows of 16 characters, and pairs of ranks then rank windows of twice the
length, until all are distinct: about log2(longest repeat / 16) rounds, each one range sort
of the positions still tied and equi-joins on unique keys. Ranks run over all texts at once
and ties are spread by position, so neither one huge text nor one repeated window is a
single task's work.

The texts of a group are laid out behind one another, a place apart. A suffix ends where its own text
does; of equal suffixes the one of the earlier text comes first.

Single texts of up to 262 144 characters, one row per key, are ranked where they are, many at a time in the same
way with numpy, and only the sorted suffixes are shuffled. What two texts share is found in the same way, with
the two behind one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.strings import lcp_length
from strandloom.operators.windows import text_windows
from strandloom.plans.ordering import blocked_running_sum, dense_index
from strandloom.plans.session import checkpointed, dropped

WINDOW = 16
LOCAL = 1 << 18  # longer texts are ranked by joins
SHORT = 1 << 16  # the same where a task holds more than the order of a text's suffixes
_SLICE = 1 << 18  # characters ranked at a time


@dataclass
class SuffixIndex:
    """`ordered` has `(key, pos0, r)`, `r` being the rank among all suffixes of all keys, and for groups
    also `text`, `start` and `stop` of the text that holds the position; `levels[j]` has the rank of the
    window of 16 * 2^j characters at every position."""

    key: str
    ordered: DataFrame
    windows: DataFrame
    levels: list[DataFrame] = field(default_factory=list)

    @property
    def array(self) -> DataFrame:
        """`(key, rank, pos0)`, ranks from 0 per key."""
        first = self.ordered.groupBy(self.key).agg(F.min("r").alias("_first"))
        return self.ordered.join(first, self.key).select(self.key, (F.col("r") - F.col("_first")).alias("rank"), "pos0")

    def symbols(self) -> DataFrame:
        """`(key, rank, pos0, before)` of an index with the characters in front."""
        first = self.ordered.groupBy(self.key).agg(F.min("r").alias("_first"))
        return self.ordered.join(first, self.key).select(self.key, (F.col("r") - F.col("_first")).alias("rank"), "pos0", "before")

    def at(self, df: DataFrame, pos: Column, level: int, name: str) -> DataFrame:
        """Add the rank of the window at `pos`, NULL beyond the end of the text."""
        table = self.levels[level].select(self.key, F.col("pos0").alias("_at"), F.col("r").alias(name))
        return df.withColumn("_at", pos).join(table, [self.key, "_at"], "left").drop("_at")

    def window_at(self, df: DataFrame, pos: Column, name: str) -> DataFrame:
        table = self.windows.select(self.key, F.col("pos0").alias("_at"), F.col("window").alias(name))
        joined = df.withColumn("_at", pos).join(table, [self.key, "_at"], "left").drop("_at")
        return joined.withColumn(name, F.coalesce(name, F.lit("")))

    def common_prefixes(self) -> DataFrame:
        """`(key, r, pos0, prev0, lcp)` and what `ordered` has besides: the suffix before in order and
        the common prefix with it. The first suffix of a key has no row."""
        grouped = "stop" in self.ordered.columns
        more = [F.col("stop").alias("_prev_stop")] if grouped else []
        before = self.ordered.select(self.key, (F.col("r") + 1).alias("r"), F.col("pos0").alias("prev0"), *more)
        pairs = self.ordered.join(before, [self.key, "r"]).withColumn("lcp", F.lit(0).cast("bigint"))
        ends = [F.col("stop") - F.col("pos0"), F.col("_prev_stop") - F.col("prev0")] if grouped else []
        for level in reversed(range(len(self.levels))):
            pairs = self.at(pairs, F.col("pos0") + F.col("lcp"), level, "_a")
            pairs = self.at(pairs, F.col("prev0") + F.col("lcp"), level, "_b")
            longer = F.when(F.col("_a") == F.col("_b"), F.lit(WINDOW << level)).otherwise(F.lit(0))
            # Windows of different texts may be equal and shorter than their width.
            reached = F.least(F.col("lcp") + longer, *ends) if ends else F.col("lcp") + longer
            pairs = pairs.withColumn("lcp", reached).drop("_a", "_b")
        pairs = self.window_at(pairs, F.col("pos0") + F.col("lcp"), "_a")
        pairs = self.window_at(pairs, F.col("prev0") + F.col("lcp"), "_b")
        return pairs.withColumn("lcp", F.col("lcp") + lcp_length(F.col("_a"), F.col("_b"))).drop("_a", "_b", "_prev_stop")

    def neighbours(self) -> DataFrame:
        """`(key, rank, pos0, prev0, lcp)`: the same with ranks from 0 per key."""
        first = self.ordered.groupBy(self.key).agg(F.min("r").alias("_first"))
        pairs = self.common_prefixes().join(first, self.key)
        return pairs.select(self.key, (F.col("r") - F.col("_first")).alias("rank"), "pos0", "prev0", "lcp")


def _indexed(windows: DataFrame, key: str) -> SuffixIndex:
    """Rank the positions of `(key, pos0, window)`; further columns belong to a group's texts.

    The rank of a window is the number of positions, over all texts, with a smaller one. It
    is final as soon as no other position shares it, so a round only sorts what is tied.
    """
    more = [c for c in windows.columns if c not in (key, "pos0", "window")]
    columns = [key, "pos0", "r", *more]
    placed = dense_index(windows, [key, "window", "pos0"], "i")
    groups = placed.groupBy(key, "window").agg(F.min("i").alias("r"), F.count("*").alias("n"))
    ranked = checkpointed(placed.join(groups, [key, "window"]).select(*columns, "n"))
    dropped(placed)
    levels, done, width = [ranked.select(key, "pos0", "r")], None, WINDOW
    while True:
        final = ranked.where("n = 1").select(*columns)
        done = final if done is None else done.union(final)
        tied = ranked.where("n > 1").drop("n")
        if tied.isEmpty():
            break
        after = levels[-1].select(key, (F.col("pos0") - width).alias("pos0"), F.col("r").alias("r2"))
        # Beyond the end of the text nothing follows, which sorts first.
        inside = F.col("pos0") + width < F.col("stop") if "stop" in more else F.lit(True)
        pairs = tied.join(after, [key, "pos0"], "left").withColumn("r2", F.coalesce(F.when(inside, F.col("r2")), F.lit(-1).cast("bigint")))
        placed = dense_index(pairs, ["r", "r2", "pos0"], "i")
        parts = placed.groupBy("r", "r2").agg(F.min("i").alias("_i"), F.count("*").alias("_n"))
        starts = parts.groupBy("r").agg(F.min("_i").alias("_first"))
        moved = parts.join(starts, "r").select("r", "r2", "_n", "_i", "_first")
        # Suffixes that have ended are equal as a whole and keep the order of their places.
        ended = F.col("r2") < 0
        new = F.col("r") + F.when(ended, F.col("i")).otherwise(F.col("_i")) - F.col("_first")
        placed_at = placed.join(moved, ["r", "r2"]).withColumn("_r", new).withColumn("n", F.when(ended, 1).otherwise(F.col("_n")))
        ranked = checkpointed(placed_at.select(key, "pos0", F.col("_r").alias("r"), *more, "n"))
        dropped(placed)
        levels.append(done.select(key, "pos0", "r").union(ranked.select(key, "pos0", "r")))
        width *= 2
    return SuffixIndex(key, done, windows, levels)


def sorted_suffixes(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all suffixes in order, text by text: the text's number, the position, that of the suffix before in
    order (-1 for a text's first) and the common prefix with it; also the code points of all texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return sorted_codes(sizes, code_points(texts))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def _windows(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int, int]:
    """As a number per position, as many characters from there on as fit beside the text's number, with zeros beyond
    the text's end; how many these are, and the bits of one."""
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    letters = np.cumsum(used)  # characters by their order among those that occur, from 1
    bits = int(letters[-1]).bit_length()
    width = (62 - len(sizes).bit_length()) // bits
    # A gap of zeros after each text.
    at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * width, sizes)
    laid = np.zeros(len(codes) + len(sizes) * width, np.int64)
    laid[at] = letters[codes]
    windows = laid.copy()
    for ahead in range(1, width):
        windows <<= bits
        windows[:-ahead] |= laid[ahead:]
    return windows[at], width, bits


def _ordered(sizes: np.ndarray, codes: np.ndarray, neighbours: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The places of all suffixes in order, text by text, and with `neighbours` how many characters each shares with
    the one before of its text.

    Windows of some characters are ranked first, then windows of twice the length by the ranks of their halves, only
    where there are equal ones. A rank is the place in order of the first equal window.
    """
    row, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
    windows, width, bits = _windows(sizes, codes)
    keys = row << width * bits | windows
    order = np.argsort(keys)
    keys = keys[order]
    apart = np.append(True, keys[1:] != keys[:-1])
    rank = np.empty(len(codes), np.int32)
    rank[order] = np.flatnonzero(apart)[np.cumsum(apart) - 1]
    since = np.where(apart, 0, 127).astype(np.int8)  # the round that told a suffix from the one before
    levels, reach = [rank.copy()] if neighbours else [], width
    tied = np.flatnonzero(~(apart & np.append(apart[1:], True)))
    turn = 0
    while len(tied):
        place, turn = order[tied], turn + 1
        follows = np.zeros(len(tied), np.int64)  # nothing after the end, which sorts first
        inside = np.flatnonzero(place + reach < end[place])
        follows[inside] = rank[place[inside] + reach] + 1
        keys = rank[place].astype(np.int64) << 32 | follows
        moved = np.argsort(keys)
        place, keys = place[moved], keys[moved]
        order[tied] = place
        apart = np.append(True, keys[1:] != keys[:-1])
        old = np.append(True, keys[1:] >> 32 != keys[:-1] >> 32)
        since[tied[apart & ~old]] = turn
        rank[place] = tied[np.flatnonzero(apart)[np.cumsum(apart) - 1]]
        tied = tied[~(apart & np.append(apart[1:], True))]
        if neighbours:
            levels.append(rank.copy())
        reach *= 2
    if not neighbours:
        return order, None
    shared = np.zeros(len(codes), np.int64)
    for level in reversed(range(len(levels))):
        pairs = np.flatnonzero(since > level)
        a, b = order[pairs] + shared[pairs], order[pairs - 1] + shared[pairs]
        fits = np.flatnonzero(np.maximum(a, b) < end[order[pairs]])
        same = fits[levels[level][a[fits]] == levels[level][b[fits]]]
        shared[pairs[same]] += width << level
    # What is left is shorter than a window.
    pairs = np.flatnonzero(np.append(False, row[order[1:]] == row[order[:-1]]))
    a, b = order[pairs] + shared[pairs], order[pairs - 1] + shared[pairs]
    fits = np.flatnonzero(np.maximum(a, b) < end[order[pairs]])
    differ, pairs = windows[a[fits]] ^ windows[b[fits]], pairs[fits]
    for letter in range(1, width):
        shared[pairs] += differ < 1 << (width - letter) * bits
    return order, shared


def sorted_codes(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for texts given as the code points of all and the size of each."""
    if not len(codes):
        return codes, codes, codes, codes, codes
    order, shared = _ordered(sizes, codes, True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = (np.cumsum(sizes) - sizes)[row]  # the texts keep their order, so a text's ranks begin where it does
    first = start == np.arange(len(codes))
    before = np.concatenate([order[:1], order[:-1]])
    return row, order - start, np.where(first, -1, before - start), shared, codes


def least_since(values: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The least value after the last mark, up to and with each place; a mark's own is beyond all."""
    group = np.cumsum(mark)
    return np.minimum.accumulate(np.where(mark, 1 << 22, values) - (group << 23)) + (group << 23)


def shared_lengths(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """For every suffix of each `a`, in order and text by text: the text's number, the suffix's rank and position,
    and how many of its characters occur somewhere in the `b` of the same number."""
    parts = [x for pair in zip(a, b, strict=True) for x in (pair[0], "\0", pair[1])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 3)
    codes, heads = code_points(parts) + 1, sizes[:, 0]
    whole = sizes.sum(axis=1)
    codes[np.cumsum(whole) - whole + heads] = 0  # between the two, before all characters
    row, pos0, _, shared, _ = sorted_codes(whole, codes)
    in_b = pos0 > heads[row]
    # The nearest suffixes of `b`, before and after in order, share the most. A text's first shares 0 with none.
    up = least_since(shared, in_b)
    down = least_since(np.append(shared[1:], 0)[::-1], in_b[::-1])[::-1]
    mine = np.flatnonzero(pos0 < heads[row])
    rank = np.arange(len(mine)) - (np.cumsum(heads) - heads)[row[mine]]
    return row[mine], rank, pos0[mine], np.maximum(up, down)[mine]


def cut_by_size(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose sizes add up to about `_SLICE`."""
    parts = np.cumsum(sizes, dtype=np.int64) // _SLICE
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    return ((low, high) for low, high in zip(cuts, cuts[1:], strict=False) if low < high)


def _sorted_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["_seq"]).to_numpy()):
            row, pos0, prev0, shared, codes = sorted_suffixes(batch["_seq"].slice(low, high - low).to_pylist())
            sizes = np.bincount(row)
            rank = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            at = (np.cumsum(sizes) - sizes)[row] + pos0
            for some in np.split(np.arange(len(row)), range(1 << 16, len(row), 1 << 16)):
                head = codes[at[some] - 1].tolist()
                symbols = [chr(c) if p else None for c, p in zip(head, pos0[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_key"].take(pa.array(row[some] + low)), pa.array(rank[some]), pa.array(pos0[some]),
                        pa.array(prev0[some], mask=prev0[some] < 0), pa.array(shared[some]), pa.array(symbols, pa.string()),
                    ],
                    ["_key", "rank", "pos0", "prev0", "lcp", "before"],
                )


def _arrays_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the order."""
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["_seq"]).to_numpy()):
            texts = batch["_seq"].slice(low, high - low).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            order, _ = _ordered(sizes, code_points(texts), False)
            row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            start = starts[row]
            rank, pos0 = np.arange(len(row)) - start, order - start
            for at in range(0, len(row), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [batch["_key"].take(pa.array(row[some] + low)), pa.array(rank[some]), pa.array(pos0[some])], ["_key", "rank", "pos0"]
                )


@dataclass
class LocalIndex:
    """The same for texts of which each was ranked in one task: `suffixes` has `(key, rank, pos0, prev0, lcp)` and,
    if asked for, `before`; `others`, if any, is the index of the remaining texts."""

    key: str
    suffixes: DataFrame
    more: list[str]
    others: SuffixIndex | None = None
    _numbered: DataFrame | None = None

    def _rows(self) -> DataFrame:
        """`suffixes` with `r`, after the ranks of the other texts."""
        if self._numbered is None:
            offset = self.others.ordered.count() if self.others else 0
            numbered = dense_index(self.suffixes, [self.key, "rank"], "_i")
            self._numbered = numbered.withColumn("r", F.col("_i") + offset).drop("_i")
        return self._numbered

    def _and(self, own: DataFrame, of) -> DataFrame:
        return own.unionByName(of(self.others)) if self.others else own

    @property
    def ordered(self) -> DataFrame:
        return self._and(self._rows().select(self.key, "pos0", "r", *self.more), lambda x: x.ordered)

    @property
    def array(self) -> DataFrame:
        return self._and(self.suffixes.select(self.key, "rank", "pos0"), lambda x: x.array)

    def symbols(self) -> DataFrame:
        return self._and(self.suffixes.select(self.key, "rank", "pos0", "before"), lambda x: x.symbols())

    def common_prefixes(self) -> DataFrame:
        own = self._rows().where("prev0 IS NOT NULL").select(self.key, "r", "pos0", *self.more, "prev0", "lcp")
        return self._and(own, lambda x: x.common_prefixes())

    def neighbours(self) -> DataFrame:
        own = self.suffixes.where("prev0 IS NOT NULL").select(self.key, "rank", "pos0", "prev0", "lcp")
        return self._and(own, lambda x: x.neighbours())


def split_local(df: DataFrame, key: str, size: Column, most: int = SHORT) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a key of their own whose `size` is at most `most`, dealt out by key, as they are to be worked on
    inside tasks; and the others, if any: larger ones, and those of a null or repeated key."""
    sizes = df.select(F.col(key).alias("_of"), size.alias("_size"))
    odd = sizes.groupBy("_of").agg(F.count("*").alias("_n"), F.max("_size").alias("_size"))
    odd = checkpointed(odd.where(F.col("_of").isNull() | (F.col("_n") > 1) | (F.col("_size") > most)).select("_of"))
    short, rest = df, None
    if not odd.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_of"))
        short, rest = df.join(odd, same, "left_anti"), df.join(odd, same, "left_semi")
    return short.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key), rest


def local_texts(df: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts `(_key, _seq)` that are not empty, of a key of their own and of at most `LOCAL` characters, dealt out by key, as
    they are to be worked on inside tasks; and the rows of the other texts, if any, but those of a null key."""
    sizes = df.where(F.length(seq) > 0).select(F.col(key).alias("_of"), F.length(seq).alias("_size"))
    odd = checkpointed(sizes.groupBy("_of").agg(F.count("*").alias("_n"), F.max("_size").alias("_size")).where((F.col("_n") > 1) | (F.col("_size") > LOCAL)))
    short, rest = df.where(F.col(key).isNotNull() & (F.length(seq) > 0)), None
    if not odd.isEmpty():
        rest = df.join(odd, F.col(key) == F.col("_of"), "left_semi")
        short = short.join(odd, F.col(key) == F.col("_of"), "left_anti")
    # Dealt out, as sorting is heavy and files may have few row groups.
    dealt = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return short.select(F.col(key).alias("_key"), F.col(seq).alias("_seq")).repartition(dealt, "_key"), rest


def build_suffix_index(df: DataFrame, key: str, seq: str, before: bool = False) -> SuffixIndex | LocalIndex:
    """Index the texts of `df`, one row per text with a unique `key`; with `before`, `ordered` has the
    character in front of each suffix, too."""
    texts, rest = local_texts(df, key, seq)
    others = None if rest is None else _indexed(checkpointed(text_windows(rest, key, seq, WINDOW, before)), key)
    kind = texts.schema["_key"].dataType.simpleString()
    found = texts.mapInArrow(_sorted_here, f"_key {kind}, rank bigint, pos0 bigint, prev0 bigint, lcp bigint, before string")
    more = ["before"] if before else []
    return LocalIndex(key, checkpointed(found.select(F.col("_key").alias(key), "rank", "pos0", "prev0", "lcp", *more)), more, others)


def build_group_index(df: DataFrame, group: str, text: str, seq: str) -> SuffixIndex:
    """Index the texts of every group together: one row per text, `text` unique in its group."""
    rows = df.select(F.col(group).alias("_group"), F.col(text).alias("_text"), F.col(seq).alias("_seq")).where("_seq IS NOT NULL")
    numbered = dense_index(rows.select("_group", "_text", (F.length("_seq").cast("bigint") + 1).alias("_size")), ["_group", "_text"], "_i")
    ends = checkpointed(blocked_running_sum(numbered, ["_group"], "_i", "_size", "_end"))
    dropped(numbered)
    places = ends.select("_group", "_text", (F.col("_end") - F.col("_size")).alias("_start"), (F.col("_end") - 1).alias("_stop"))
    laid = rows.join(places, ["_group", "_text"])
    of = F.struct(F.col("_group"), F.col("_text"), F.col("_start"), F.col("_stop")).alias("_of")
    cut = text_windows(laid.select(of, "_seq"), "_of", "_seq", WINDOW)
    windows = cut.select(
        F.col("_of._group").alias(group), (F.col("_of._start") + F.col("pos0")).alias("pos0"), "window",
        F.col("_of._text").alias("text"), F.col("_of._start").alias("start"), F.col("_of._stop").alias("stop"),
    )
    return _indexed(checkpointed(windows), group)


def suffix_array(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Sorted suffixes of every text: `(key, rank, pos0)`."""
    texts, rest = local_texts(df, key, seq)
    kind = texts.schema["_key"].dataType.simpleString()
    own = texts.mapInArrow(_arrays_here, f"_key {kind}, rank bigint, pos0 bigint").select(F.col("_key").alias(key), "rank", "pos0")
    if rest is None:
        return own
    return own.unionByName(_indexed(checkpointed(text_windows(rest, key, seq, WINDOW)), key).array)
