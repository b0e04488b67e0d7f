"""Search and comparison on string columns. Positions are 0-based unless a name says `1`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.alphabet import let

_NO_POSITIONS = "array<bigint>"


def _quoted(t: Column) -> Column:
    """Regex that matches `t` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _lookahead_starts(s: Column, pattern: Column) -> Column:
    """All 0-based starts at which `pattern` matches, overlaps included.

    Splitting at a zero-width lookahead cuts the string right before every match, so the
    starts are the running lengths of the pieces: one pass over the text, where a
    `substring` per position would be quadratic.
    """
    ahead = F.concat(F.lit("(?s)(?="), pattern, F.lit(")"))
    cuts = F.transform(F.split(s, ahead), lambda piece: F.length(piece).cast("bigint"))
    ends = F.aggregate(
        cuts,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    # `ends` is [0, |p1|, |p1|+|p2|, ..., |s|]: the inner ones are matches, 0 only if s starts with one.
    starts = F.slice(ends, F.lit(1), F.size(ends) - 1)
    at_zero = F.regexp_like(s, F.concat(F.lit(r"\A"), ahead))
    found = F.when(at_zero, starts).otherwise(F.slice(starts, F.lit(2), F.size(starts)))
    return F.when(F.length(s) == 0, F.array().cast(_NO_POSITIONS)).otherwise(found)


def find(s: Column, t: Column) -> Column:
    """First start of `t` in `s`, NULL if absent. An empty `t` is at 0 of any non-empty `s`."""
    return F.when(F.length(s) > 0, F.nullif(F.instr(s, t), F.lit(0)) - 1)


def contains(s: Column, t: Column) -> Column:
    return F.contains(s, t)


def positions(s: Column, t: Column) -> Column:
    """All overlapping starts; an empty `t` is at every position of `s`."""
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.length(s), F.lit(1)).cast("bigint") - 1)
    return (
        F.when(F.length(s) == 0, F.array().cast(_NO_POSITIONS))
        .when(F.length(t) == 0, every)
        .otherwise(_lookahead_starts(s, _quoted(t)))
    )


def count_occurrences(s: Column, t: Column) -> Column:
    """Number of overlapping occurrences, without building the list of positions."""
    cut = F.size(F.split(s, F.concat(F.lit("(?s)(?="), _quoted(t), F.lit(")"))))
    starts_with = F.when(F.startswith(s, t), F.lit(1)).otherwise(F.lit(0))
    return (
        F.when(F.length(s) == 0, F.lit(0))
        .when(F.length(t) == 0, F.length(s))
        .otherwise(cut - 1 + starts_with)
        .cast("bigint")
    )


def regex_positions1(s: Column, pattern: str) -> Column:
    """All overlapping 1-based starts of a regular expression.

    A split inside a character outside the basic plane would count it twice, so texts with one
    are tried character by character.
    """
    fast = F.transform(_lookahead_starts(s, F.lit(f"(?:{pattern})")), lambda p: p + 1)
    every = F.sequence(F.lit(0).cast("bigint"), F.length(s).cast("bigint") - 1)
    skipped = lambda p: F.concat(F.lit("(?s)\\A.{"), p.cast("string"), F.lit(f"}}(?-s:(?:{pattern}))"))
    slow = F.transform(F.filter(every, lambda p: F.regexp_like(s, skipped(p))), lambda p: p + 1)
    return F.when(_wide(s), slow).otherwise(fast)


def replace_all(s: Column, t: Column, u: Column) -> Column:
    """Left-to-right, non-overlapping; an empty `t` leaves `s` as it is."""
    return F.replace(s, t, u)


def overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of `a` that is a prefix of `b` (up to the whole string)."""
    longest = F.least(F.length(a), F.length(b))
    fits = F.filter(
        F.sequence(F.lit(1), F.greatest(longest, F.lit(1))),
        lambda n: F.right(a, n) == F.left(b, n),
    )
    return F.when(longest == 0, F.lit(0)).otherwise(F.coalesce(F.array_max(fits), F.lit(0))).cast("bigint")


def _bisect(limit: Column, holds) -> Column:
    """Largest n in 0..limit with holds(n), for a property that holds up to some n."""
    start = F.struct(F.lit(0).cast("int").alias("lo"), limit.cast("int").alias("hi"))
    rounds = F.sequence(F.lit(1), F.length(F.bin(limit.cast("bigint"))))

    def step(state: Column, _round: Column) -> Column:
        mid = F.shiftright(state["lo"] + state["hi"] + 1, 1)
        ok = (state["lo"] < state["hi"]) & holds(mid)
        lower = F.when(ok, mid).otherwise(state["lo"])
        upper = F.when(ok | (state["lo"] >= state["hi"]), state["hi"]).otherwise(mid - 1)
        return F.struct(lower.alias("lo"), upper.alias("hi"))

    return F.aggregate(rounds, start, step)["lo"]


def lcp_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection on prefix equality."""
    return _bisect(F.least(F.length(a), F.length(b)), lambda n: F.left(a, n) == F.left(b, n))


def lcp(a: Column, b: Column) -> Column:
    return F.left(a, lcp_length(a, b))


def _ahead(s: Column, count: Column) -> Column:
    """The characters that a repeat count like `{3}` takes at every position, in one pass.

    The regular expression sees a character outside the basic plane as two, so texts with
    one are cut from their array of characters instead.
    """
    return F.regexp_extract_all(s, F.concat(F.lit("(?s)(?=(."), count, F.lit("))")), F.lit(1))


def _wide(s: Column) -> Column:
    return F.regexp_like(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def _cut(s: Column, k: Column, starts: Column) -> Column:
    every = F.sequence(F.lit(1), F.greatest(starts, F.lit(1)))
    cut = let(F.split(s, ""), lambda cs: F.transform(every, lambda i: F.array_join(F.slice(cs, i, k), "")))
    return F.when(starts < 1, F.array().cast("array<string>")).otherwise(cut)


def kmers(s: Column, k: Column | int) -> Column:
    """All overlapping substrings of length `k` >= 1, in order."""
    width = (k if isinstance(k, Column) else F.lit(k)).cast("int")
    fast = _ahead(s, F.concat(F.lit("{"), width.cast("string"), F.lit("}")))
    return F.when(_wide(s), _cut(s, width, F.length(s) - width + 1)).otherwise(fast)


def windows(s: Column, width: int) -> Column:
    """Up to `width` characters at every position, fewer only at the end."""
    return F.when(_wide(s), _cut(s, F.lit(width), F.length(s))).otherwise(_ahead(s, F.lit(f"{{1,{width}}}")))


def hamming(a: Column, b: Column) -> Column:
    """Mismatching positions over the length of the shorter string."""
    n = F.least(F.length(a), F.length(b))
    differs = F.zip_with(
        F.split(F.left(a, n), ""),
        F.split(F.left(b, n), ""),
        lambda x, y: F.when(x != y, F.lit(1)).otherwise(F.lit(0)),
    )
    return F.aggregate(differs, F.lit(0).cast("bigint"), lambda acc, d: acc + d)


def longest_common_substring(a: Column, b: Column) -> Column:
    """Longest common substring; of equally long ones, the one starting first in `a`.

    If some substring of length n is shared then so is one of every shorter length, so n is
    found by bisection; each probe is a hash intersection of the two sets of n-mers.
    """

    def shared(n: Column) -> Column:
        return F.arrays_overlap(kmers(a, n), kmers(b, n))

    length = _bisect(F.least(F.length(a), F.length(b)), shared)

    def first_shared(n: Column) -> Column:
        return F.element_at(F.array_intersect(kmers(a, n), kmers(b, n)), 1)

    return let(length, lambda n: F.when(n == 0, F.lit("")).otherwise(first_shared(n)))


def maximal_prefix_length(s: Column, t: Column) -> Column:
    """Length of the longest prefix of `t` that occurs somewhere in `s`."""
    return _bisect(F.length(t), lambda n: F.instr(s, F.left(t, n)) > 0)


def maximal_prefix_matches(s: Column, t: Column) -> Column:
    """Struct of the longest prefix of `t` found in `s`: length, full, all starts, and the
    start of the lexicographically smallest suffix that has it."""

    def located(n: Column) -> Column:
        return let(
            positions(s, F.left(t, n)),
            lambda at: F.struct(
                n.cast("bigint").alias("length"),
                (n == F.length(t)).alias("full"),
                at.alias("positions"),
                F.array_min(
                    F.transform(at, lambda p: F.struct(F.substring(s, (p + 1).cast("int"), F.length(s)), p.alias("p")))
                )["p"].alias("pos0"),
            ),
        )

    return let(maximal_prefix_length(s, t), located)


#: Values of border arrays that go back to Spark at a time, a longer text's being alone.
_BORDERS = 1 << 18
#: Windows that a position is compared with its text's beginning for, before the text is gone through one by one.
_ROUNDS = 64


def _borders_one_by_one(text: str) -> np.ndarray:
    out = np.zeros(len(text), dtype=np.int32)
    b = 0
    for i in range(1, len(text)):
        c = text[i]
        while b and text[b] != c:
            b = int(out[b - 1])
        b += text[b] == c
        out[i] = b
    return out


def _borders_together(texts: list[str]) -> list[np.ndarray]:
    """Border arrays of some texts that are not empty.

    How much each position shares with the beginning of its text is found by windows of as many characters as fit
    a number. A border that ends at a position begins where one that reaches so far begins first.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row, ends, place = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes), np.arange(len(codes))
    starts = ends - sizes
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    letters = np.cumsum(used)[codes]
    bits, width = int(letters.max()).bit_length(), 1
    windows = np.append(letters, np.zeros(64, np.int64))
    while 2 * width * bits <= 52:  # so that lengths are exact as floating point numbers
        windows[:-width] = windows[:-width] << width * bits | windows[width:]
        width *= 2
    shared = np.zeros(len(codes), np.int64)
    going = np.setdiff1d(np.flatnonzero(letters == letters[starts][row]), starts, assume_unique=True)
    for ahead in range(0, _ROUNDS * width, width):
        if not len(going):
            break
        differ = windows[going + ahead] ^ windows[starts[row[going]] + ahead]
        shared[going] = ahead + width - -(-np.frexp(differ.astype(np.float64))[1] // bits)
        going = going[(differ == 0) & (going + ahead + width < ends[row[going]])]
    # Windows go on into the text behind.
    shared = np.minimum(shared, ends[row] - place)
    found = np.flatnonzero(shared)
    first = np.full(len(codes), len(codes))
    np.minimum.at(first, found + shared[found] - 1, found)
    first = np.minimum.accumulate(first[::-1])[::-1]
    out = np.split(np.maximum(place + 1 - first, 0).astype(np.int32), ends[:-1])
    for long in np.unique(row[going]).tolist():  # texts that share very much with their beginning
        out[long] = _borders_one_by_one(texts[long])
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def border_array(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per position, the length of the longest proper border of the prefix ending there.

    No built-in expresses this in linear time. Arrays are larger than their texts, so they are made and sent back
    for some texts at a time, not for a whole batch at once.
    """

    def borders(held: list[str | None]) -> pd.Series:
        some = [i for i, text in enumerate(held) if text and len(text) <= _BORDERS]
        found = dict(zip(some, _borders_together([held[i] for i in some]) if some else [], strict=True))
        return pd.Series([found[i] if i in found else None if text is None else _borders_one_by_one(text) for i, text in enumerate(held)], dtype=object)

    for batch in texts:
        held, values = [], 0
        for text in batch:
            held.append(text)
            values += len(text or "")
            if values >= _BORDERS:
                yield borders(held)
                held, values = [], 0
        if held or not len(batch):
            yield borders(held)


def border_array_simple(s: Column) -> Column:
    """The same by definition, quadratic; a check for short strings."""
    borders = F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.when(
            i > 1,
            F.coalesce(
                F.array_max(
                    F.filter(
                        F.sequence(F.lit(1), F.greatest(i - 1, F.lit(1))),
                        lambda b: F.right(F.left(s, i), b) == F.left(s, b),
                    )
                ),
                F.lit(0),
            ),
        ).otherwise(F.lit(0)),
    )
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(borders)
