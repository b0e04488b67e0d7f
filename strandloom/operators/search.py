"""Many patterns in many texts, as joins on unique keys.

The distinct patterns become a dictionary of their prefixes, in the manner of a trie in which a step may
take 2^k letters: prefixes are numbered, and a prefix of length n is reached over the numbers that the
binary form of n has, longest first. Every position of a text walks down as far as it can, which takes one
join per power of two, and ends at the longest prefix of any pattern that starts there. The longest
pattern that is a prefix of that is known in the dictionary, and so are all shorter ones.

Steps of 16 letters and more go over windows of the texts: a window of 32 letters is a pair of numbers
of windows of 16, and so on; only positions whose first 16 letters some pattern has at all take part. The
remaining letters are looked up as strings. So a text has at most one row per position and power of two, however
many patterns share their beginnings, and the dictionary has one row per letter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.windows import text_pieces, text_windows
from strandloom.plans.ordering import blocked_running_max, dense_index
from strandloom.plans.session import checkpointed, dropped, shuffled

SEED = 16
_PIECE = 4096  # characters of a text that meet the prefixes which end there
_WIDE = 24  # bits for a length; the rest of a 63-bit number is for a pattern
_NONE = -1


@dataclass
class Patterns:
    """`patterns` is `(pid, pattern, size)`. `windows[j]` numbers the windows of seed * 2^j letters, by their
    text or by the two halves; `steps[j]` leads on from a prefix over such a window, `tails` over a piece of
    text; a prefix is `(at, node)`, its length and a number. `ends` has the longest pattern that is a prefix of
    a prefix, `shorter` every pattern that a pattern starts with."""

    seed: int
    patterns: DataFrame
    windows: list[DataFrame]
    steps: list[DataFrame]
    tails: list[DataFrame]
    ends: DataFrame
    shorter: DataFrame


def _grown(rows: DataFrame, over: str, letters: int, more: list) -> DataFrame:
    """One step down for all rows that have `over`. Patterns with the same prefix get the same node: the
    least number of a pattern among them."""
    named = rows.groupBy("at", "node", over).agg(F.min("pid").alias("_to"))
    return checkpointed(
        rows.join(named, ["at", "node", over]).select(
            "pid", F.col("at").alias("_at"), F.col("node").alias("_node"), over, (F.col("at") + letters).alias("at"), F.col("_to").alias("node"), *more
        )
    )


def _leading(grown: DataFrame, over: str) -> DataFrame:
    """The step as a table from `(at, node, over)`: the row of the pattern that named the node."""
    return grown.where("pid = node").select(F.col("_at").alias("at"), F.col("_node").alias("node"), over, F.col("node").alias("_to"))


def build_patterns(patterns: DataFrame, pattern: str, seed: int = SEED) -> Patterns:
    """The dictionary of the distinct patterns that are not null and not empty. `seed` is a power of two."""
    wanted = patterns.select(F.col(pattern).alias("pattern")).distinct().where("pattern <> ''")
    numbered = dense_index(wanted, ["pattern"], "pid")
    known = checkpointed(numbered.withColumn("size", F.length("pattern").cast("bigint")))
    dropped(numbered)

    # Windows at multiples of their own width, from the text first and then from pairs.
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("size") / seed) - 1)
    cut = known.where(F.col("size") >= seed).select("pid", "pattern", F.explode(starts).alias("i"))
    cut = cut.select("pid", "i", F.substring("pattern", (F.col("i") * seed + 1).cast("int"), F.lit(seed)).alias("window"))
    windows, placed, keys = [], [], ["window"]
    while True:
        code = F.shiftleft("pid", _WIDE) + F.col("i")
        rows = checkpointed(cut)
        if rows.isEmpty():
            break
        table = checkpointed(rows.groupBy(*keys).agg(F.min(code).alias("wid")))
        windows.append(table)
        placed.append(checkpointed(rows.join(table, keys).select("pid", "i", "wid")))
        dropped(rows)
        half = 1 << (len(placed) - 1)
        right = placed[-1].select("pid", (F.col("i") - half).alias("i"), F.col("wid").alias("right"))
        cut = placed[-1].where(F.col("i") % (2 * half) == 0).withColumnRenamed("wid", "left").join(right, ["pid", "i"])
        keys = ["left", "right"]

    # Prefixes, by the longest steps first.
    here = known.select("pid", F.lit(0).cast("bigint").alias("at"), F.lit(_NONE).cast("bigint").alias("node"))
    steps = [None] * len(windows)
    for level in reversed(range(len(windows))):
        at = placed[level].select("pid", (F.col("i") * seed).alias("at"), "wid")
        grown = _grown(here.join(at, ["pid", "at"]), "wid", seed << level, [])
        steps[level] = _leading(grown, "wid")
        here = here.unionByName(grown.select("pid", "at", "node"))
    rest = F.substring("pattern", (F.col("at") + 1).cast("int"), F.lit(seed - 1)).alias("rest")
    here = checkpointed(here.join(known, "pid").select("pid", "at", "node", rest))
    tails, letters = [], seed >> 1
    while letters:
        rows = here.where(F.length("rest") >= letters).withColumn("piece", F.left("rest", F.lit(letters)))
        grown = _grown(rows, "piece", letters, [F.substring("rest", letters + 1, seed).alias("rest")])
        tails.append(_leading(grown, "piece"))
        here = here.withColumn("rest", F.left("rest", F.lit(letters - 1))).unionByName(grown.select("pid", "at", "node", "rest"))
        letters >>= 1
    every = checkpointed(here.where("at > 0").select("pid", "at", "node"))
    full = every.join(known.select("pid", F.col("size").alias("at")), ["pid", "at"]).select("at", "node", F.col("pid").alias("ends"))
    marked = checkpointed(every.join(full, ["at", "node"], "left"))
    code = F.when(F.col("ends").isNotNull(), F.shiftleft("at", 63 - _WIDE) + F.col("ends"))
    near = blocked_running_max(marked.withColumn("_code", code), ["pid"], "at", "_code", "_near")
    ends = near.where("pid = node AND _near IS NOT NULL").select("at", "node", F.col("_near").bitwiseAND(F.lit((1 << (63 - _WIDE)) - 1)).alias("found"))
    shorter = marked.where("ends IS NOT NULL").select(F.col("pid").alias("found"), F.col("ends").alias("pid"), F.col("at").alias("size"))
    return Patterns(seed, known, windows, steps, tails, checkpointed(ends), shorter)


def _down(state: DataFrame, table: DataFrame, over: str, letters: int) -> DataFrame:
    """Every row that can takes the step."""
    taken = state.join(table, ["at", "node", over], "left")
    went = F.col("_to").isNotNull()
    return (
        taken.withColumn("at", F.col("at") + F.when(went, letters).otherwise(0))
        .withColumn("node", F.coalesce("_to", "node"))
        .withColumn("_went", went)
        .drop("_to", over)
    )


def _tail(known: Patterns, state: DataFrame) -> DataFrame:
    """Walk over up to seed - 1 letters of `rest`."""
    letters = known.seed >> 1
    for table in known.tails:
        rows = _down(state.withColumn("piece", F.left("rest", F.lit(letters))), table, "piece", letters)
        rest = F.when(F.col("_went"), F.substring("rest", letters + 1, known.seed)).otherwise(F.left("rest", F.lit(letters - 1)))
        state = rows.withColumn("rest", rest).drop("_went")
        letters >>= 1
    return state


def _found(known: Patterns, state: DataFrame, key: str, low: int, high: int | None) -> DataFrame:
    """`(key, pid, pos0)` of all patterns of the sizes asked for that the prefixes reached start with."""
    sizes = known.shorter.where(F.col("size") >= low)
    sizes = sizes if high is None else sizes.where(F.col("size") < high)
    last = state.where("at > 0").select(key, "pos0", "at", "node").join(known.ends, ["at", "node"])
    return last.join(sizes, "found").select(key, "pid", "pos0")


def occurrences(texts: DataFrame, key: str, text: str, known: Patterns) -> DataFrame:
    """`(key, pid, pos0)`: all overlapping occurrences of the patterns in the texts, one per unique `key`."""
    seed, start = known.seed, [F.lit(0).cast("bigint").alias("at"), F.lit(_NONE).cast("bigint").alias("node")]
    at = text_windows(texts, key, text, seed)
    found = []
    if not known.patterns.where(F.col("size") < seed).isEmpty():
        state = at.select(key, "pos0", *start, F.left("window", F.lit(seed - 1)).alias("rest"))
        found.append(_found(known, _tail(known, state), key, 1, seed))
    if known.windows:
        level = checkpointed(at.join(known.windows[0], "window").select(key, "pos0", "wid"))
        levels = [level]
        for j, table in enumerate(known.windows[1:]):
            right = levels[-1].select(key, (F.col("pos0") - (seed << j)).alias("pos0"), F.col("wid").alias("right"))
            pairs = levels[-1].withColumnRenamed("wid", "left").join(shuffled(right), [key, "pos0"]).join(table, ["left", "right"])
            levels.append(checkpointed(pairs.select(key, "pos0", "wid")))
        state = level.select(key, "pos0", *start)
        for j in reversed(range(len(levels))):
            ahead = levels[j].select(key, F.col("pos0").alias("_there"), "wid")
            seen = state.withColumn("_there", F.col("pos0") + F.col("at")).join(shuffled(ahead), [key, "_there"], "left").drop("_there")
            state = _down(seen, known.steps[j], "wid", seed << j).drop("_went")
        state = checkpointed(state.where("at > 0"))
        # The letters that follow are cut from pieces of the texts, each of which is sent once.
        pieces = shuffled(text_pieces(texts, key, text, _PIECE, seed - 2))
        there = F.col("pos0") + F.col("at")
        met = state.withColumn("piece", F.floor(there / _PIECE)).join(pieces, [key, "piece"], "left")
        rest = F.substring("chars", (there % _PIECE + 1).cast("int"), F.lit(seed - 1))
        seen = met.withColumn("rest", F.coalesce(rest, F.lit(""))).drop("piece", "chars")
        found.append(_found(known, _tail(known, seen), key, seed, None))
    if not found:
        return at.where(F.lit(False)).select(key, F.lit(0).cast("bigint").alias("pid"), "pos0")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def find_patterns(
    texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, seed: int = SEED
) -> DataFrame:
    """All overlapping occurrences `(key, pattern, pos0)` of the distinct patterns.

    An empty pattern occurs at every position.
    """
    known = build_patterns(patterns, pattern, seed)
    found = occurrences(texts, key, text, known).join(known.patterns.select("pid", "pattern"), "pid").select(key, "pattern", "pos0")
    if not patterns.where(F.col(pattern) == "").isEmpty():
        found = found.union(text_windows(texts, key, text, 1).select(key, F.lit("").alias("pattern"), "pos0"))
    return found


def first_occurrence(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Smallest position of every pattern in every text that has it, with the number of hits: `(key, pattern,
    pos0, hits)`. An empty pattern is first in every text that has characters."""
    known = build_patterns(patterns, pattern)
    hits = occurrences(texts, key, text, known).groupBy(key, "pid").agg(F.min("pos0").alias("pos0"), F.count("*").alias("hits"))
    found = hits.join(known.patterns.select("pid", "pattern"), "pid").select(key, "pattern", "pos0", "hits")
    if not patterns.where(F.col(pattern) == "").isEmpty():
        every = texts.where(F.length(text) > 0).select(
            key, F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("pos0"), F.length(text).cast("bigint").alias("hits")
        )
        found = found.union(every)
    return found
