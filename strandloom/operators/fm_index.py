"""Burrows-Wheeler transform and FM index as tables.

The index has one row per block of the transform: its characters and, per character, the
number of suffixes that sort before those the block's occurrences lead to, and the positions of the block's
suffixes. A search step for all patterns is one equi-join per bound with that table. Texts that fit a task are
transformed, cut into blocks and restored there, so no row of theirs is a single character.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.constants import SENTINEL_FIRST
from strandloom.operators.nearest import BLOCK, nearest_below
from strandloom.operators.suffix import SHORT, build_group_index, build_suffix_index, code_points, cut_by_size, sorted_suffixes, split_local
from strandloom.plans.ordering import blocked_running_max, blocked_running_sum, dense_index, ordered_concat
from strandloom.plans.session import checkpointed, dropped, shuffled


def bwt(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows `(key, rank, pos0, symbol)` of the terminated texts: the sorted suffixes and the
    character before each. The sentinel sorts before every character and is none itself: before
    the whole text, `symbol` is null."""
    index = build_suffix_index(df, key, seq, before=True)
    array = index.symbols().select(key, (F.col("rank") + 1).alias("rank"), "pos0", F.col("before").alias("symbol"))
    # The suffix of the sentinel alone sorts first.
    size = F.length(seq).cast("bigint")
    last = df.where(size >= 0).select(key, F.lit(0).cast("bigint").alias("rank"), size.alias("pos0"), F.when(size > 0, F.right(seq, F.lit(1))).alias("symbol"))
    return array.unionByName(last)


def bwt_string(table: DataFrame, key: str) -> DataFrame:
    """The transform of each text as one string, the sentinel shown as `$`."""
    shown = table.withColumn("symbol", F.coalesce("symbol", F.lit(SENTINEL_FIRST)))
    return ordered_concat(shown, [key], "rank", "symbol", "bwt")


def _shown(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the terminated texts, one behind the other: the code points of the transforms, with `$` for the
    sentinel, the positions of the sorted suffixes, the rows of each text and the sentinel's place in it."""
    row, pos0, _, _, codes = sorted_suffixes(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, rows = np.cumsum(sizes) - sizes, sizes + 1
    heads = np.cumsum(rows) - rows
    places = np.empty(len(codes) + len(texts), np.int64)
    places[heads] = sizes  # the suffix of the sentinel alone sorts first
    places[np.arange(len(row)) + row + 1] = pos0
    first = places == 0
    which = np.repeat(starts, rows) + places - 1
    letters = np.where(first, ord(SENTINEL_FIRST), codes[np.where(first, 0, which)] if len(codes) else 0)
    return letters, places, rows, np.flatnonzero(first) - heads


def _spelled(codes: np.ndarray, sizes: np.ndarray) -> list[str]:
    text, ends = codes.astype(np.uint32).tobytes().decode("utf-32-le"), np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _transformed_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in cut_by_size(pc.add(pc.utf8_length(batch["_seq"]), 1).to_numpy()):
            part = batch.slice(low, high - low)
            letters, _, rows, holes = _shown(part["_seq"].to_pylist())
            yield pa.RecordBatch.from_arrays([part["_key"], pa.array(_spelled(letters, rows), pa.string()), pa.array(holes)], ["_key", "bwt", "hole"])


def _restored_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["bwt"]).to_numpy()):
            part = batch.slice(low, high - low)
            texts = part["bwt"].to_pylist()
            rows = np.fromiter(map(len, texts), np.int64, len(texts))
            heads, codes = np.cumsum(rows) - rows, code_points(texts)
            keys = codes + 1
            keys[heads + part["hole"].to_numpy()] = 0  # the sentinel sorts first
            lf = np.empty(len(codes), np.int64)
            lf[np.argsort(np.repeat(np.arange(len(texts)), rows) << 21 | keys, kind="stable")] = np.arange(len(codes))
            step, out = lf.tolist(), []
            for head, text, n in zip(heads.tolist(), texts, rows.tolist(), strict=True):
                at, letters = head, []
                for _ in range(n - 1):
                    letters.append(text[at - head])
                    at = step[at]
                out.append("".join(reversed(letters)))
            yield pa.RecordBatch.from_arrays([part["_key"], pa.array(out, pa.string())], ["_key", "seq"])


@dataclass
class Transform:
    """The transforms of many texts: `strings` has `(key, bwt, hole)` of those that were transformed in one task,
    `hole` being the place of the sentinel in `bwt`; `table`, if any, has the rows of the others."""

    key: str
    strings: DataFrame
    table: DataFrame | None = None

    def shown(self) -> DataFrame:
        own = self.strings.select(self.key, "bwt")
        return own if self.table is None else own.unionByName(bwt_string(self.table, self.key))

    def inverse(self) -> DataFrame:
        """The texts back: `(key, seq)`."""
        given = self.strings.select(F.col(self.key).alias("_key"), "bwt", "hole")
        kind = given.schema["_key"].dataType.simpleString()
        own = given.mapInArrow(_restored_here, f"_key {kind}, seq string").withColumnRenamed("_key", self.key)
        return own if self.table is None else own.unionByName(bwt_inverse(self.table, self.key))


def transform(df: DataFrame, key: str, seq: str, local: int = SHORT) -> Transform:
    """The transforms of the texts, one row per key; those of up to `local` characters stay whole."""
    short, rest = split_local(df.select(key, seq), key, F.length(seq), local)
    texts = short.where(F.col(seq).isNotNull()).select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    kind = texts.schema["_key"].dataType.simpleString()
    strings = checkpointed(texts.mapInArrow(_transformed_here, f"_key {kind}, bwt string, hole bigint").withColumnRenamed("_key", key))
    return Transform(key, strings, None if rest is None else checkpointed(bwt(rest, key, seq)))


def lf_map(table: DataFrame, key: str) -> DataFrame:
    """`(key, rank, lf)`: the rank of the suffix one character longer.

    Equal characters keep their order, so `lf` is the place of a row when rows are sorted by
    character, the sentinel first, and rank.
    """
    placed = dense_index(table.select(key, "symbol", "rank"), [key, "symbol", "rank"], "_i")
    first = placed.groupBy(key).agg(F.min("_i").alias("_first"))
    return placed.join(first, key).select(key, "rank", (F.col("_i") - F.col("_first")).alias("lf"))


def bwt_inverse(table: DataFrame, key: str) -> DataFrame:
    """The texts back from `(key, rank, symbol)`: `(key, seq)`.

    The steps from a row back to the start of its text are its position; they are counted by
    pointer doubling, in log2(length) rounds. A row that has arrived is set aside, so the places
    that rows look up are all different and no end of a text is a hot key.
    """
    steps = lf_map(table, key).join(table.select(key, "rank", "symbol"), [key, "rank"])
    ends = table.where("symbol IS NULL").select(key, F.col("rank").alias("_end"))
    first = steps.join(ends, key).select(
        key, "rank", "symbol", F.col("lf").alias("to"),
        F.when(F.col("symbol").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        (F.col("symbol").isNull() | (F.col("lf") == F.col("_end"))).alias("home"),
    )
    hops = checkpointed(first)
    while not hops.where("NOT home").isEmpty():
        ahead = hops.select(
            key, F.col("rank").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("home").alias("_home")
        )
        moved = hops.where("NOT home").join(ahead, [key, "to"]).select(
            key, "rank", "symbol", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_home").alias("home")
        )
        before, hops = hops, checkpointed(hops.where("home").union(moved))
        dropped(before)
    letters = hops.where("symbol IS NOT NULL").select(key, (F.col("dist") - 1).alias("pos0"), "symbol")
    texts = ordered_concat(letters, [key], "pos0", "symbol", "seq")
    return table.select(key).distinct().join(texts, key, "left").na.fill("", ["seq"])


@dataclass
class FmIndex:
    key: str
    width: int
    # key, block, text, hole (the sentinel's place in it), before: map<string, bigint>, places: array<bigint>
    blocks: DataFrame
    sizes: DataFrame  # key, size: rows of the transform

    @property
    def suffixes(self) -> DataFrame:
        """`(key, rank, pos0)`."""
        rows = self.blocks.select(self.key, "block", F.posexplode("places").alias("_p", "pos0"))
        return rows.select(self.key, (F.col("block") * self.width + F.col("_p")).alias("rank"), "pos0")


def _blocks_here(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in cut_by_size(pc.add(pc.utf8_length(batch["_seq"]), 1).to_numpy()):
                part = batch.slice(low, high - low)
                letters, places, rows, holes = _shown(part["_seq"].to_pylist())
                count, heads = len(rows), np.cumsum(rows) - rows
                row = np.repeat(np.arange(count), rows)
                # Also the block right after the last row, which the upper bound may fall into.
                blocks = rows // width + 1
                base = np.cumsum(blocks) - blocks
                owner = np.repeat(np.arange(count), blocks)
                block = np.arange(len(owner)) - base[owner]
                sizes = np.minimum(rows[owner] - block * width, width)
                hole = np.full(len(owner), -1, np.int64)
                hole[base + holes // width] = holes % width
                real = np.ones(len(letters), bool)
                real[heads + holes] = False
                # A cell for every character of a text at each of its blocks, by text, character and block.
                symbols, which = np.unique(row[real] << 21 | letters[real], return_inverse=True)
                of = symbols >> 21
                cells = np.cumsum(blocks[of]) - blocks[of]
                inside = ((np.arange(len(letters)) - heads[row]) // width)[real]
                total = int(blocks[of].sum())
                seen = np.bincount(cells[which] + inside, minlength=total)
                # Characters are counted in order, so the count so far is the rank that they lead to.
                upto = np.cumsum(seen) - seen
                kinds = np.bincount(of, minlength=count)
                first = np.cumsum(kinds) - kinds
                start = np.cumsum(rows - 1) - (rows - 1)
                # The same cells by text, block and character.
                entries = kinds[owner]
                at = np.arange(int(entries.sum())) - np.repeat(np.cumsum(entries) - entries, entries)
                symbol = np.repeat(first[owner], entries) + at
                value = upto[cells[symbol] + np.repeat(block, entries)] - np.repeat(start[owner], entries) + 1
                names = _spelled(symbols & ((1 << 21) - 1), np.ones(len(symbols), np.int64))
                before = pa.MapArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(entries)]), pa.int32()), pa.array(names, pa.string()).take(pa.array(symbol)), pa.array(value)
                )
                ranks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(places))
                columns = [
                    part["_key"].take(pa.array(owner)), pa.array(block), pa.array(_spelled(letters, sizes), pa.string()),
                    pa.array(hole, mask=hole < 0), before, ranks,
                ]
                for cut in range(0, len(owner), 1 << 12):
                    yield pa.RecordBatch.from_arrays([c.slice(cut, 1 << 12) for c in columns], ["_key", "block", "text", "hole", "before", "places"])

    return run


def build_fm_index(df: DataFrame, key: str, seq: str, width: int = 1024, local: int = SHORT) -> FmIndex:
    """Index the texts of `df`, one row per key; blocks of texts of up to `local` characters are made in one task."""
    short, rest = split_local(df.select(key, seq), key, F.length(seq), local)
    texts = short.where(F.col(seq).isNotNull()).select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    kind = texts.schema["_key"].dataType.simpleString()
    shape = f"_key {kind}, block bigint, text string, hole bigint, before map<string, bigint>, places array<bigint>"
    blocks = checkpointed(texts.mapInArrow(_blocks_here(width), shape).withColumnRenamed("_key", key))
    rows = F.sum(F.size("places")).alias("size")
    if rest is None:
        return FmIndex(key, width, blocks, blocks.groupBy(key).agg(rows))
    blocks = blocks.unionByName(_blocks_of(checkpointed(bwt(rest, key, seq)), key, width))
    return FmIndex(key, width, blocks, blocks.groupBy(key).agg(rows))


def _blocks_of(table: DataFrame, key: str, width: int) -> DataFrame:
    """The blocks of an index from the rows of the transforms."""
    placed = table.withColumn("block", F.floor(F.col("rank") / width))
    shown = placed.withColumn("symbol", F.coalesce("symbol", F.lit(SENTINEL_FIRST)))
    text = ordered_concat(shown, [key, "block"], "rank", "symbol", "text", width)
    ranks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos0"))), lambda x: x.pos0).alias("places")
    places = placed.groupBy(key, "block").agg(ranks)
    holes = placed.where("symbol IS NULL").select(key, "block", (F.col("rank") % width).alias("hole"))
    sizes = table.groupBy(key).agg(F.count("*").alias("size"))
    ends = sizes.select(key, F.floor(F.col("size") / width).alias("block"))
    # Also the block right after the last row, which the upper bound may fall into.
    grid = text.select(key, "block").union(ends).distinct()
    counts = placed.where("symbol IS NOT NULL").groupBy(key, "block", "symbol").agg(F.count("*").alias("n"))
    # Every character of the text at every block, with the count so far.
    symbols = counts.groupBy(key, "symbol").agg(F.sum("n").alias("total"))
    # One row per character of the alphabet, so this window stays small.
    smaller = Window.partitionBy(key).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    # Rank 0 is the sentinel's.
    first = symbols.select(key, "symbol", (F.coalesce(F.sum("total").over(smaller), F.lit(0)) + 1).alias("first"))
    cells = grid.join(first, key).join(counts, [key, "block", "symbol"], "left").na.fill(0, ["n"])
    running = blocked_running_sum(cells, [key, "symbol"], "block", "n", "upto")
    before = running.groupBy(key, "block").agg(
        F.map_from_entries(
            F.collect_list(F.struct("symbol", (F.col("first") + F.col("upto") - F.col("n")).alias("v")))
        ).alias("before")
    )
    whole = grid.join(before, [key, "block"], "left").join(text, [key, "block"], "left").join(holes, [key, "block"], "left")
    whole = whole.join(places, [key, "block"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))
    return checkpointed(whole.na.fill("", ["text"]).select(key, "block", "text", "hole", "before", "places"))


def _step(index: FmIndex, state: DataFrame, bound: str) -> DataFrame:
    """Move one bound of every row over its next character, to the left."""
    blocks = index.blocks.withColumnRenamed("block", "_b").drop("places")
    joined = state.withColumn("_b", F.floor(F.col(bound) / index.width)).join(blocks, [index.key, "_b"])
    part = F.left("text", (F.col(bound) - F.col("_b") * index.width).cast("int"))
    seen = F.length(part) - F.length(F.replace(part, F.col("_c"), F.lit("")))
    shown = (F.col("_c") == SENTINEL_FIRST) & (F.col("hole") < F.length(part))
    seen = seen - F.when(shown, 1).otherwise(0)
    return joined.withColumn(bound, F.try_element_at("before", F.col("_c")) + seen).drop("_b", "text", "hole", "before")


def backward_search(index: FmIndex, queries: DataFrame, pattern: str) -> DataFrame:
    """Rank intervals of the patterns `(key, pattern)`, each searched in the text of its key:
    `(key, pattern, lo, hi)`, half-open, without the patterns that do not occur."""
    key = index.key
    start = queries.select(key, F.col(pattern).alias("pattern")).distinct().join(index.sizes, key)
    state = start.select(key, "pattern", F.lit(0).cast("bigint").alias("lo"), F.col("size").alias("hi"))
    longest = state.agg(F.max(F.length("pattern"))).first()[0] or 0
    done = state.where("pattern = ''")
    for i in range(longest):
        going = state.where(F.length("pattern") > i)
        stepping = going.withColumn("_c", F.substring(F.reverse("pattern"), i + 1, 1))
        state = checkpointed(
            _step(index, _step(index, stepping, "lo"), "hi").where("lo < hi").select(key, "pattern", "lo", "hi")
        )
        done = done.union(state.where(F.length("pattern") == i + 1))
    return done


def _found_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bisections of the text's sorted suffixes per pattern."""
    for batch in batches:
        for low, high in cut_by_size(pc.utf8_length(batch["_seq"]).to_numpy()):
            part = batch.slice(low, high - low)
            texts = part["_seq"].to_pylist()
            row, pos0, *_ = sorted_suffixes(texts)
            ends = np.cumsum(np.bincount(row, minlength=len(texts)))
            out = []
            for i, (text, patterns, end) in enumerate(zip(texts, part["_patterns"].to_pylist(), ends.tolist(), strict=True)):
                places = pos0[end - len(text) : end].tolist()
                for pattern in patterns:
                    head = lambda at, t=text, n=len(pattern): t[at : at + n]
                    first = bisect_left(places, pattern, key=head)
                    last = bisect_right(places, pattern, first, key=head)
                    if first < last:
                        out.append((i, pattern, first + 1, last + 1))  # rank 0 is the sentinel's
            which, found, lo, hi = zip(*out, strict=True) if out else ([], [], [], [])
            columns = [part["_key"].take(pa.array(which, pa.int64())), pa.array(found, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "pattern", "lo", "hi"])


def pattern_intervals(
    df: DataFrame, key: str, seq: str, queries: DataFrame, pattern: str, block: int = BLOCK, local: int = SHORT
) -> DataFrame:
    """The same intervals `(key, pattern, lo, hi)` for patterns of any length, any number per text, without a
    round per character. Texts of up to `local` characters meet their patterns in a task, some thousands of
    characters of patterns at a time; longer ones are ranked together with theirs."""
    asked = queries.select(key, F.col(pattern).alias("pattern")).where("pattern IS NOT NULL")
    known = df.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    short, rest = split_local(known, "_key", F.length("_seq"), local)
    asked = asked.withColumnRenamed(key, "_key").distinct()
    short, filled = short.where("_seq IS NOT NULL"), asked.where("pattern <> ''")
    size = F.sum(F.length("pattern")).alias("_sum")
    shares = filled.groupBy("_key").agg(size).select("_key", (1 + F.shiftright("_sum", 16)).alias("_shares"))
    share = F.pmod(F.xxhash64("pattern"), F.col("_shares")).alias("_share")
    grouped = filled.join(shares, "_key").groupBy("_key", share).agg(F.collect_list("pattern").alias("_patterns"))
    dealt = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = short.where("_seq <> ''").join(grouped, "_key").repartition(dealt, "_key", "_share").select("_key", "_seq", "_patterns")
    found = both.mapInArrow(_found_here, f"_key {both.schema['_key'].dataType.simpleString()}, pattern string, lo bigint, hi bigint")
    every = asked.where("pattern = ''").join(short, "_key").select(
        "_key", "pattern", F.lit(0).cast("bigint").alias("lo"), (F.length("_seq") + 1).cast("bigint").alias("hi")
    )
    out = found.unionByName(every).withColumnRenamed("_key", key)
    return out if rest is None else out.unionByName(_ranked_together(rest, "_key", "_seq", asked, block).withColumnRenamed("_key", key))


def _ranked_together(df: DataFrame, key: str, seq: str, queries: DataFrame, block: int) -> DataFrame:
    """Patterns are ranked together with the text's suffixes, in a number of rounds that grows with the logarithm
    of the longest repeat. A pattern stands right before the suffixes that begin with it, which end where
    neighbours share less than its length."""
    asked = queries.select(F.col(key).alias("_key"), "pattern").where("pattern IS NOT NULL").distinct()
    known = df.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"))
    asked = asked.join(known.select("_key"), "_key", "left_semi")
    numbered = dense_index(asked.where("pattern <> ''"), ["_key", "pattern"], "_n")
    patterns = checkpointed(numbered.select("_key", "pattern", F.col("_n").alias("text")))
    dropped(numbered)
    last = F.lit((1 << 63) - 1).alias("text")  # after all patterns, as equal suffixes are in this order
    together = patterns.select("_key", "text", F.col("pattern").alias("_seq")).unionByName(known.select("_key", last, "_seq"))
    index = build_group_index(together, "_key", "text", "_seq")
    shared = index.common_prefixes().select("_key", "r", "text", "pos0", "start", "lcp")
    heads = index.ordered.groupBy("_key").agg(F.min(F.struct("r", "text", "pos0", "start")).alias("_h"))
    rows = shared.unionByName(heads.select("_key", "_h.*", F.lit(-1).cast("bigint").alias("lcp")))
    # How many suffixes of the text itself come before each rank; the sentinel's has rank 0.
    own = F.when(F.col("text") == (1 << 63) - 1, 1).otherwise(0)
    placed = checkpointed(blocked_running_sum(rows.withColumn("_own", own), ["_key"], "r", "_own", "upto"))
    places = placed.where("_own = 0 AND pos0 = start").join(patterns, ["_key", "text"])
    places = checkpointed(places.select("_key", "pattern", "r", F.length("pattern").cast("bigint").alias("_size"), F.col("upto").alias("lo")))
    ends = nearest_below(placed, "r", "lcp", places, "r", "_size", "next", placed.count(), block).select("r", "_size", F.col("at").alias("_end"))
    before = placed.select(F.col("r").alias("_end"), F.col("_key").alias("_in"), (F.col("upto") - F.col("_own")).alias("_upto"))
    sizes = known.select("_key", F.length("_seq").cast("bigint").alias("_total"))
    found = places.join(ends, ["r", "_size"], "left").join(before, "_end", "left").join(sizes, "_key")
    # Beyond the last suffix of the key is another key, or nothing.
    hi = F.when(F.col("_in") == F.col("_key"), F.col("_upto")).otherwise(F.col("_total"))
    found = found.select(F.col("_key").alias(key), "pattern", (F.col("lo") + 1).alias("lo"), (hi + 1).alias("hi")).where("lo < hi")
    every = asked.where("pattern = ''").join(sizes, "_key").select(
        F.col("_key").alias(key), "pattern", F.lit(0).cast("bigint").alias("lo"), (F.col("_total") + 1).alias("hi")
    )
    return found.unionByName(every)


def locate(index: FmIndex, found: DataFrame) -> DataFrame:
    """Positions of the intervals `(key, pattern, pos0)`; the sentinel's own, of rank 0, is left out."""
    width, lo = index.width, F.greatest("lo", F.lit(1))
    each = F.explode(F.sequence(F.floor(lo / width), F.floor((F.col("hi") - 1) / width))).alias("block")
    spans = shuffled(found.where(lo < F.col("hi")).select(index.key, "pattern", lo.alias("lo"), "hi", each))
    hits = spans.join(index.blocks.select(index.key, "block", "places"), [index.key, "block"])
    begin = F.greatest(F.col("lo") - F.col("block") * width, F.lit(0))
    end = F.least(F.col("hi") - F.col("block") * width, F.lit(width))
    inside = F.slice("places", (begin + 1).cast("int"), (end - begin).cast("int"))
    return hits.select(index.key, "pattern", F.explode(inside).alias("pos0"))


def suffix_offsets(index: FmIndex, found: DataFrame, factor: int = 10) -> DataFrame:
    """For every hit, the steps back to the nearest sampled rank, a multiple of `factor`, if
    only those positions were stored: `(key, pattern, rank, offset)`."""
    key = index.key
    ranks = shuffled(found.withColumn("rank", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))))
    # The nearest sampled position to the left is a running maximum along the text; before the
    # first one, steps go on from the end of the text.
    sampled = F.when(F.col("rank") % factor == 0, F.col("pos0"))
    marked = index.suffixes.withColumn("_sampled", sampled)
    near = blocked_running_max(marked, [key], "pos0", "_sampled", "_near")
    last = marked.groupBy(key).agg(F.max("_sampled").alias("_last"))
    around = near.join(last, key).join(index.sizes, key)
    back = F.coalesce(F.col("pos0") - F.col("_near"), F.col("pos0") + F.col("size") - F.col("_last"))
    return ranks.join(around.select(key, "rank", back.cast("int").alias("offset")), [key, "rank"]).select(
        key, "pattern", "rank", "offset"
    )
