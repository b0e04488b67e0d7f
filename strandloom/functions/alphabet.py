"""Alphabets and typed-string primitives. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.constants import ALPHABETS, SENTINEL_FIRST, SENTINEL_LAST


def let(value: Column, body) -> Column:
    """Bind `value` once for use inside higher-order functions.

    An expression captured by a lambda is evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(s: Column) -> Column:
    """Array of characters; empty for the empty string."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def symbols(alphabet: str, sentinel: str | None = None) -> list[str]:
    """Symbols in sort order, optionally widened by a sentinel sorting first or last."""
    letters = [chr(i) for i in range(128)] if alphabet == "ascii" else list(ALPHABETS[alphabet])
    if sentinel == "first":
        return [SENTINEL_FIRST, *letters]
    if sentinel == "last":
        return [*letters, SENTINEL_LAST]
    return letters


def alphabet_table(spark: SparkSession) -> DataFrame:
    """All alphabets as rows `(alphabet, symbol, ord)`."""
    rows = [(a, c, i) for a in [*ALPHABETS, "ascii"] for i, c in enumerate(symbols(a))]
    return spark.createDataFrame(rows, "alphabet string, symbol string, ord int")


def _class_pattern(alphabet: str) -> str:
    if alphabet == "ascii":
        return r"\A\p{ASCII}*\z"
    return rf"\A[{ALPHABETS[alphabet]}]*\z"


def is_valid(s: Column, alphabet: str) -> Column:
    return s.rlike(_class_pattern(alphabet))


def parse(s: Column, alphabet: str, strict: bool = True) -> Column:
    """The string itself if it spells in `alphabet`; else an error, or NULL if not strict."""
    bad = (
        F.raise_error(F.concat(F.lit(f"invalid char for {alphabet}: "), s)).cast("string")
        if strict
        else F.lit(None).cast("string")
    )
    return F.when(s.isNull() | is_valid(s, alphabet), s).otherwise(bad)


def symbol_index(ch: Column, alphabet: str, sentinel: str | None = None) -> Column:
    """Ordinal of a symbol, NULL if it is not in the alphabet."""
    letters = F.lit("".join(symbols(alphabet, sentinel)))
    return F.when(F.length(ch) == 1, F.nullif(F.instr(letters, ch), F.lit(0)) - 1)


def symbol_at(index: Column, alphabet: str, sentinel: str | None = None) -> Column:
    return F.try_element_at(F.lit(symbols(alphabet, sentinel)), index + 1)


def slice_(s: Column, start: Column | int | None = None, stop: Column | int | None = None) -> Column:
    """`s[start:stop]`, half-open, either bound optional."""
    lo = F.lit(0) if start is None else (start if isinstance(start, Column) else F.lit(start))
    hi = F.length(s) if stop is None else (stop if isinstance(stop, Column) else F.lit(stop))
    return F.substring(s, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def slice_inclusive(s: Column, start: Column | int, last: Column | int) -> Column:
    stop = (last if isinstance(last, Column) else F.lit(last)) + 1
    return slice_(s, start, stop)


def char_at(s: Column, index: Column) -> Column:
    """Character at a 0-based index, NULL when out of range."""
    inside = (index >= 0) & (index < F.length(s))
    return F.when(inside, F.substring(s, (index + 1).cast("int"), F.lit(1)))


def sort_chars(s: Column, alphabet: str | None = None) -> Column:
    """Characters in alphabet order (code-point order when no alphabet is given)."""
    if alphabet is None:
        return F.array_join(F.array_sort(chars(s)), "")
    keyed = F.transform(chars(s), lambda c: F.struct(symbol_index(c, alphabet).alias("o"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda k: k["c"]), "")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in code-point order."""
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))
