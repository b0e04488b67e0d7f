"""Longest repeated and longest common substrings, from suffix indexes.

A substring common to all texts of a group is a common prefix of a run of neighbouring suffixes that has
one of every text. The shortest runs up to each suffix are found by sweeps over blocks of ranks, which
start from the last suffix of every text before the block and what it shares with the block's first.

Texts that fit a task take a shorter way: the substring lies in a shortest text of the group, so every text is
compared with that one in a task, and of each of its suffixes the least length that is found is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.alphabet import let
from strandloom.functions.strings import longest_common_substring
from strandloom.operators.suffix import SHORT, build_group_index, build_suffix_index, cut_by_size, shared_lengths, split_local
from strandloom.plans.ordering import blocked_running_sum
from strandloom.plans.session import checkpointed

BLOCK = 1 << 16


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of `values[low : high]` of every stretch; no stretch is empty."""
    tables, width = [values], 1
    while 2 * width <= len(values):
        tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    level = np.frexp(high - low)[1] - 1
    out = np.empty(len(low), np.int64)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(tables[k][low[mine]], tables[k][high[mine] - (1 << k)])
    return out


def shortest_runs(shared: np.ndarray, owner: np.ndarray, owners: int, before: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Per suffix, what the shortest run that ends there and has all `owners` shares; -1 without one.

    `shared` is what each suffix shares with the one before. `before` are the owners whose last suffix lies
    before the first row, in the order of those, and `reach` what these share with the row before the first.
    """
    n, c = len(shared), len(before)
    codes = np.unique(np.concatenate([before, owner]), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    again = np.full(n + c, n + c)
    again[order[:-1][same]] = order[1:][same]
    first = np.ones(n + c, bool)
    first[order[1:][same]] = False
    starts = np.flatnonzero(first)
    out = np.full(n, -1, np.int64)
    if len(starts) < owners:
        return out
    ends = np.arange(max(starts[owners - 1], c), n + c)
    # The run has to reach back to the last suffix of the owner that was met longest ago.
    back = np.searchsorted(np.maximum.accumulate(again), ends, "right")
    inside = back >= c
    got = np.empty(len(ends), np.int64)
    alone = back == ends
    got[alone] = -1
    if (mine := inside & ~alone).any():
        got[mine] = _least(shared, back[mine] + 1 - c, ends[mine] + 1 - c)
    if (mine := ~inside).any():
        got[mine] = np.minimum(np.minimum.accumulate(shared)[ends[mine] - c], reach[back[mine]])
    out[ends - c] = got
    return out


def _sweep(rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
    """The longest shared prefix of a run with all owners, per group of one block."""
    if not len(rows):
        return pd.DataFrame({"first": [], "shared": [], "r": []})
    rows = rows.sort_values("r", ignore_index=True)
    carried = carried.rename(columns=lambda c: c[1:]).sort_values("last")
    group, place, shared, owner = (rows[c].to_numpy() for c in ("first", "r", "lcp", "start"))
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() + [len(rows)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        mine = carried[carried["first"] == group[a]] if a == 0 else carried.iloc[:0]
        found = shortest_runs(
            shared[a:b], owner[a:b], int(rows["owners"].iat[a]), mine["start"].to_numpy(np.int64), mine["reach"].to_numpy(np.int64)
        )
        best = int(found.argmax())
        if found[best] > 0:
            out.append((group[a], found[best], place[a + best]))
    return pd.DataFrame(out, columns=["first", "shared", "r"])


def _carried(rows: DataFrame) -> DataFrame:
    """`(block, first, start, last, reach)`: for blocks that begin inside a group, the last suffix of each of
    its texts before the block, and the least common prefix from there to the block's border."""
    spans = rows.groupBy("first").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).where("_low < _high")
    rows = rows.join(spans.select("first"), "first", "left_semi")
    after = Window.partitionBy("first", "block").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    rest = rows.withColumn("_rest", F.min("lcp").over(after))
    # Nothing follows the last suffix of a block in it, so it shares more than any value with the border.
    beyond = F.lit((1 << 62) - 1)
    last = rest.groupBy("first", "block", "start").agg(
        F.max("r").alias("last"), F.max_by(F.coalesce("_rest", beyond), "r").alias("_reach")
    )
    whole = rows.groupBy("first", "block").agg(F.min("lcp").alias("_all"))
    owners = rows.select("first", "start").distinct()
    grid = whole.join(owners, "first").join(last, ["first", "block", "start"], "left")
    along = Window.partitionBy("first", "start").orderBy("block")
    grid = grid.withColumn("_since", F.count("last").over(along)).where("_since > 0")
    held = Window.partitionBy("first", "start", "_since").orderBy("block")
    grid = grid.withColumn("reach", F.min(F.coalesce("_reach", "_all")).over(held)).withColumn("last", F.max("last").over(held))
    moved = grid.select((F.col("block") + 1).alias("block"), "first", "start", "last", "reach")
    return moved.join(spans, "first").where("block <= _high").drop("_low", "_high")


def _ranked(index, df: DataFrame, group: str) -> DataFrame:
    """`(group, first, r, lcp, start, text, pos0)` of all suffixes: `first` is the group's first rank, whose
    suffix shares -1 with none before it, and `start` names the text."""
    firsts = index.ordered.groupBy(group).agg(F.min("r").alias("first"))
    columns = [group, "r", "lcp", "start", "text", (F.col("pos0") - F.col("start")).alias("pos0")]
    shared = index.common_prefixes().select(*columns)
    heads = index.ordered.join(firsts.select(group, F.col("first").alias("r")), [group, "r"]).withColumn("lcp", F.lit(-1).cast("bigint"))
    return checkpointed(shared.unionByName(heads.select(*columns)).join(firsts, group))


def _best_runs(ranked: DataFrame, df: DataFrame, group: str, block: int) -> DataFrame:
    """`(group, shared, r)` of the longest prefix common to all texts of each group, the first in order; groups
    without one, and those of one text, have no row."""
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("owners"))
    # A block has room for one suffix of every text of a group.
    block = max(block, sizes.agg(F.max("owners")).first()[0] or 0)
    rows = ranked.join(sizes.where("owners > 1"), F.col(group).eqNullSafe(F.col("_group")))
    rows = rows.select("first", "r", "lcp", "start", "owners", F.floor(F.col("r") / block).alias("block"))
    carried = _carried(rows)
    carried = carried.select(*(F.col(c).alias(f"_{c}") for c in carried.columns))
    found = rows.groupBy("block").cogroup(carried.groupBy("_block")).applyInPandas(_sweep, "first bigint, shared bigint, r bigint")
    best = found.groupBy("first").agg(F.max(F.struct("shared", (-F.col("r")).alias("_r"))).alias("_best"))
    return ranked.select(group, "first", "r", "text", "pos0").join(
        best.select("first", F.col("_best.shared").alias("shared"), (-F.col("_best._r")).alias("r")), ["first", "r"]
    )


def _sliding_min(near: DataFrame, key: str, width: int, block: int = 1 << 16) -> DataFrame:
    """Add `_least`, the minimum of `lcp` over the `width` ranks up to the row; rows with fewer before
    them have none. Ranks are cut into blocks that repeat the end of the block before, so that no
    window holds a whole text."""
    block = max(block, 2 * width)
    own = F.floor(F.col("rank") / block)
    again = F.col("rank") % block >= block - (width - 1)
    rows = near.withColumn("_own", own).withColumn("_block", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    up_to = Window.partitionBy(key, "_block").orderBy("rank").rowsBetween(-(width - 1), 0)
    least = F.when(F.count("*").over(up_to) == width, F.min("lcp").over(up_to))
    return rows.withColumn("_least", least).where("_own = _block AND _least IS NOT NULL").drop("_own", "_block")


def longest_repeat(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Per text (unique `key`), the longest substring with at least k occurrences, overlaps
    counted: `(key, substring)`. Of equally long ones, the first in alphabetical order.

    In the order of the suffixes, k suffixes in a row share what the shortest of the k - 1 common
    prefixes between them is, so the answer is the largest minimum of k - 1 neighbours.
    """
    if k < 2:
        return df.select(key, F.col(seq).alias("substring"))
    near = build_suffix_index(df, key, seq).neighbours().select(key, "rank", "pos0", "lcp")
    runs = _sliding_min(near, key, k - 1).where("_least > 0")
    best = runs.groupBy(key).agg(F.max(F.struct("_least", (-F.col("rank")).alias("_first"), "pos0")).alias("_best"))
    found = F.substring(F.col(seq), (F.col("_best.pos0") + 1).cast("int"), F.col("_best._least").cast("int"))
    return df.select(key, seq).join(best, key, "left").select(key, F.coalesce(found, F.lit("")).alias("substring"))


def _kept_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and suffix of its shortest text: the least length found in the texts at hand."""
    for batch in batches:
        sizes = pc.add(pc.utf8_length(batch["_seed"]), pc.utf8_length(batch["_s"])).to_numpy()
        for low, high in cut_by_size(sizes):
            part = batch.slice(low, high - low)
            row, rank, pos0, found = shared_lengths(part["_seed"].to_pylist(), part["_s"].to_pylist())
            ids, group = np.unique(part["_id"].to_numpy(), return_inverse=True)
            order = np.lexsort((rank, group[row]))
            of, rank, pos0, found = group[row][order], rank[order], pos0[order], found[order]
            heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (rank[1:] != rank[:-1])]))
            columns = [ids[of[heads]], rank[heads], pos0[heads], np.minimum.reduceat(found, heads)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_id", "rank", "pos0", "shared"])


def _in_shortest(rows: DataFrame, short: DataFrame) -> DataFrame:
    """`(_g, _found)` of the groups `short` `(_g, _n, _least, _most)`, from rows `(_g, _t, _s)`."""
    mine = rows.join(short, "_g")
    seeds = mine.where(F.length("_s") == F.col("_least")).groupBy("_g").agg(F.min("_s").alias("_seed"))
    seeds = checkpointed(seeds.withColumn("_id", F.monotonically_increasing_id()))
    # Small groups come to one task, large ones in shares of about a million characters.
    share = F.pmod(F.xxhash64("_t"), 1 + F.floor(F.col("_n") * F.col("_most") / (1 << 20)))
    dealt = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = mine.select("_g", "_s", share.alias("_share")).join(seeds, "_g").repartition(dealt, "_g", "_share")
    kept = pairs.select("_id", "_seed", "_s").mapInArrow(_kept_here, "_id bigint, rank bigint, pos0 bigint, shared bigint")
    least = kept.groupBy("_id", "rank").agg(F.min("shared").alias("shared"), F.min("pos0").alias("pos0")).where("shared > 0")
    best = least.groupBy("_id").agg(F.max(F.struct("shared", (-F.col("rank")).alias("_r"), "pos0")).alias("_b")).select("_id", "_b.shared", "_b.pos0")
    cut = F.substring("_seed", (F.col("pos0") + 1).cast("int"), F.col("shared").cast("int"))
    return best.join(seeds, "_id").select("_g", cut.alias("_found"))


def _by_index(df: DataFrame, group: str, seq: str, text: str, block: int) -> DataFrame:
    """The same, for texts of any length."""
    ranked = _ranked(build_group_index(df, group, text, seq), df, group)
    best = _best_runs(ranked, df, group, block).select(
        F.col(group).alias("_group"), F.col("text").alias("_text"), "pos0", "shared"
    )
    rows = df.select(F.col(group).alias("_g"), F.col(text).alias("_t"), F.col(seq).alias("_s"))
    cut = F.substring("_s", (F.col("pos0") + 1).cast("int"), F.col("shared").cast("int"))
    return rows.join(best, (F.col("_g") == F.col("_group")) & (F.col("_t") == F.col("_text"))).select("_g", cut.alias("_found"))


def common_substring(df: DataFrame, group: str, seq: str, text: str | None = None, block: int = BLOCK, local: int = SHORT) -> DataFrame:
    """Longest substring common to all texts of each group, the first in alphabetical order: `(group, substring)`.

    `text` tells the texts of a group apart; without it they are numbered, which writes them once. A group
    with an empty or null text has nothing in common. Two texts of a group that have more than `local`
    characters together, and texts of one name, take the way over the index.
    """
    if text is None:
        text = "_number"
        df = checkpointed(df.select(group, seq, F.monotonically_increasing_id().alias(text)))
    rows = df.select(F.col(group).alias("_g"), F.col(text).alias("_t"), F.col(seq).alias("_s"))
    size = F.coalesce(F.when(F.col("_t").isNotNull(), F.length("_s")), F.lit(0))
    named = rows.groupBy("_g", "_t").agg(F.count("*").alias("_n"), F.min(size).alias("_least"), F.max(size).alias("_most"))
    sizes = named.groupBy("_g").agg(
        F.sum("_n").alias("_n"), F.max("_n").alias("_same"), F.min("_least").alias("_least"), F.max("_most").alias("_most")
    )
    sizes = checkpointed(sizes.where("_n > 1 AND _g IS NOT NULL"))
    fits = (F.col("_same") == 1) & (F.col("_least") + F.col("_most") <= local)
    found = _in_shortest(rows, sizes.where(fits & (F.col("_least") > 0)).drop("_same"))
    odd = sizes.where(~fits)
    if not odd.isEmpty():
        rest = df.join(odd.select("_g"), F.col(group) == F.col("_g"), "left_semi")
        found = found.unionByName(_by_index(rest, group, seq, text, block))
    single = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.max("_s").alias("_one"))
    both = single.select(F.col("_g").alias(group), "_n", F.when(F.col("_n") == 1, F.col("_one")).alias("_one"))
    out = both.join(found, F.col(group) == F.col("_g"), "left")
    return out.select(group, F.coalesce("_found", "_one", F.lit("")).alias("substring"))


def _pairs_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.add(pc.utf8_length(batch["_a"]), pc.utf8_length(batch["_b"])).to_numpy()
        for low, high in cut_by_size(sizes):
            part = batch.slice(low, high - low)
            texts = part["_a"].to_pylist()
            row, _, pos0, found = shared_lengths(texts, part["_b"].to_pylist())
            order = np.lexsort((pos0, -found, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            at, size = np.zeros((2, len(texts)), np.int64)
            at[row[first]], size[row[first]] = pos0[first], found[first]
            cut = [t[i : i + n] for t, i, n in zip(texts, at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["_key"], pa.array(cut, pa.string()), pa.array(at, mask=size == 0)], ["_key", "substring", "pos0"])


def common_substring_pair(df: DataFrame, key: str, a: str, b: str, block: int = BLOCK, local: int = SHORT) -> DataFrame:
    """Longest substring that the texts `a` and `b` of each row share, the one starting first in `a`:
    `(key, substring, pos0)`, empty without a position if they share nothing. `key` is unique. For texts of any
    length; rows of up to `local` characters are compared inside a task."""
    a_size, b_size = F.coalesce(F.length(a), F.lit(0)), F.coalesce(F.length(b), F.lit(0))
    short, rest = split_local(df.select(key, a, b), key, a_size + b_size, local)
    texts = short.select(F.col(key).alias("_key"), F.coalesce(a, F.lit("")).alias("_a"), F.coalesce(b, F.lit("")).alias("_b"))
    found = texts.mapInArrow(_pairs_here, f"_key {texts.schema['_key'].dataType.simpleString()}, substring string, pos0 bigint")
    found = found.withColumnRenamed("_key", key)
    return found if rest is None else found.unionByName(_pair_by_index(rest, key, a, b, block))


def _pair_by_index(df: DataFrame, key: str, a: str, b: str, block: int) -> DataFrame:
    pair = F.array(F.struct(F.lit(0).alias("n"), F.col(a).alias("s")), F.struct(F.lit(1).alias("n"), F.col(b).alias("s")))
    texts = df.select(F.col(key).alias("_key"), F.explode(pair).alias("_p")).select("_key", F.col("_p.n").alias("_n"), F.col("_p.s").alias("_s"))
    ranked = _ranked(build_group_index(texts, "_key", "_n", "_s"), texts, "_key")
    best = checkpointed(_best_runs(ranked, texts, "_key", block).select("first", "shared"))
    rows = ranked.join(best, "first").withColumn("_new", F.when(F.col("lcp") < F.col("shared"), 1).otherwise(0))
    runs = blocked_running_sum(rows.select("_key", "first", "r", "text", "pos0", "shared", "_new"), ["first"], "r", "_new", "run")
    in_a = F.when(F.col("text") == 0, F.col("pos0"))
    found = runs.groupBy("_key", "first", "run").agg(F.min(in_a).alias("pos0"), F.max("text").alias("_b"), F.max("shared").alias("shared"))
    placed = found.where("pos0 IS NOT NULL AND _b = 1").groupBy("_key").agg(F.min("pos0").alias("pos0"), F.max("shared").alias("shared"))
    out = df.select(F.col(key), F.col(a).alias("_a")).join(placed, F.col(key) == F.col("_key"), "left")
    cut = F.substring("_a", (F.col("pos0") + 1).cast("int"), F.col("shared").cast("int"))
    return out.select(key, F.coalesce(cut, F.lit("")).alias("substring"), "pos0")


def common_substring_fold(texts: Column) -> Column:
    """Pairwise longest common substrings folded over an array from the left.

    Not the same as `common_substring`: the longest part two texts share may be missing from
    a third although a shorter one is not.
    """
    first = F.element_at(texts, 1)
    rest = F.slice(texts, F.lit(2), F.size(texts))
    return F.aggregate(rest, first, lambda acc, t: let(acc, lambda a: longest_common_substring(a, t)))
