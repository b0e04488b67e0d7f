"""Nearest smaller values along an order, in blocks.

In a block all rows are answered at once; what is left asks for the nearest block whose minimum is
small enough, which is the same question about a sequence shorter by the width of a block, and then
for a place inside that block. Equal questions are asked once, and no task holds more than a block's
values and the questions of some blocks, so neither a long text nor a steep one ends up in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.session import checkpointed

BLOCK = 1 << 16
#: Blocks whose questions one task answers together.
_SHARE = 16


def last_smaller(values: np.ndarray, end: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each question, the last place before `end` whose value is less than `below`; -1 without one."""
    tables, width = [values], 1
    while 2 * width <= len(values):
        held = tables[-1]
        least = held.copy()
        least[width:] = np.minimum(held[width:], held[:-width])
        tables.append(least)
        width *= 2
    at = end.astype(np.int64) - 1
    # Stretches without a smaller value are stepped over, long ones first.
    for level in reversed(range(len(tables))):
        fits = at >= (1 << level) - 1
        over = fits & (tables[level][np.where(fits, at, 0)] >= below)
        at = np.where(over, at - (1 << level), at)
    return at


def _left_and_right(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    left = last_smaller(values, np.arange(n), values)
    right = n - 1 - last_smaller(values[::-1], np.arange(n), values[::-1])[::-1]
    return left, right


def _inside(block: int):
    """Answer the rows of one block; a place outside of it is null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r", ignore_index=True)
        place, values = rows["r"].to_numpy(), rows["v"].to_numpy()
        left, right = _left_and_right(values)
        out = pd.DataFrame({"r": place, "v": values})
        for name, at, known in (("prev", left, left >= 0), ("next", right, right < len(values))):
            safe = np.where(known, at, 0)
            out[name] = pd.array(place[safe], dtype="Int64").copy()
            out[f"{name}_v"] = pd.array(values[safe], dtype="Int64").copy()
            out.loc[~known, [name, f"{name}_v"]] = pd.NA
        return out

    return run


def _answers(side: str):
    """The last (first) place of a block with a value less than asked for, for questions from after (before) it."""

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"q": [], "v": [], "at": [], "at_v": []})
        rows = rows.sort_values("r", ascending=side == "prev", ignore_index=True)
        place, values = rows["r"].to_numpy(), rows["w"].to_numpy()
        order = place if side == "prev" else -place
        until = asked["q"].to_numpy() if side == "prev" else -asked["q"].to_numpy()
        at = last_smaller(values, np.searchsorted(order, until), asked["v"].to_numpy())
        hit = at >= 0
        return pd.DataFrame({"q": asked["q"][hit], "v": asked["v"][hit], "at": place[at[hit]], "at_v": values[at[hit]]})

    return run


_FOUND = "q bigint, v bigint, at bigint, at_v bigint"


def _held(wanted: DataFrame, values: DataFrame, block: int):
    """The values of the blocks `(b, share)` that are asked for, grouped by both."""
    own = values.withColumn("_b", F.floor(F.col("r") / block))
    held = wanted.distinct().join(own, F.col("b") == F.col("_b")).select(F.col("b").alias("_of"), F.col("share").alias("_share"), "r", "w")
    return held.groupBy("_of", "_share")


def _search(asked: DataFrame, values: DataFrame, side: str, block: int, where) -> DataFrame:
    """Answer `(q, v)`, each in the block `where(q)` of `(r, w)`, blocks being shared out."""
    asked = asked.withColumn("b", where(F.col("q"))).withColumn("share", F.floor(F.col("q") / (_SHARE * block)))
    held = _held(asked.select("b", "share"), values, block)
    return asked.groupBy("b", "share").cogroup(held).applyInPandas(_answers(side), _FOUND)


def _resolve(asked: DataFrame, values: DataFrame, side: str, block: int, size: int) -> DataFrame:
    """Answers `(q, v, at, at_v)` to distinct questions `(q, v)`: the nearest `r` before (after) `q` whose
    value is below `v`. `values` is `(r, w)`, `r` below `size`."""
    here = checkpointed(_search(asked, values, side, block, lambda q: F.floor(q / block)))
    if size <= block:
        return here
    far = asked.join(here.select("q", "v"), ["q", "v"], "left_anti")
    return here.unionByName(_elsewhere(far, values, side, block, size))


def _elsewhere(far: DataFrame, values: DataFrame, side: str, block: int, size: int) -> DataFrame:
    """Answers to questions that their own block cannot answer."""
    far = checkpointed(far.withColumn("own", F.floor(F.col("q") / block)))
    if far.isEmpty():
        return far.select("q", "v", F.col("q").alias("at"), F.col("v").alias("at_v"))
    minima = checkpointed(values.groupBy(F.floor(F.col("r") / block).alias("r")).agg(F.min("w").alias("w")))
    blocks = _resolve(far.select(F.col("own").alias("q"), "v").distinct(), minima, side, block, -(-size // block))
    # A question goes on to the block found, from beyond its end.
    going = blocks.select(F.col("q").alias("own"), "v", F.col("at").alias("b"))
    beyond = F.lit(size + 1 if side == "prev" else -1).cast("bigint")
    asked = checkpointed(going.withColumn("share", F.floor(F.col("own") / _SHARE)).withColumn("q", beyond))
    held = _held(asked.select("b", "share"), values, block)
    found = asked.groupBy("b", "share").cogroup(held).applyInPandas(_answers_of(side), "own bigint, v bigint, at bigint, at_v bigint")
    return far.join(found, ["own", "v"]).select("q", "v", "at", "at_v")


def _answers_of(side: str):
    answer = _answers(side)

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"own": [], "v": [], "at": [], "at_v": []})
        found = answer(asked.reset_index(drop=True), rows)
        return pd.DataFrame({"own": asked["own"].to_numpy()[found.index], "v": found["v"], "at": found["at"], "at_v": found["at_v"]})

    return run


def nearest_smaller(df: DataFrame, pos: str, value: str, size: int, block: int = BLOCK) -> DataFrame:
    """Per row of `df` (`pos` unique, from 0 to less than `size`; `value` an integer): `(r, v, prev, prev_v, next,
    next_v)`, the nearest places on both sides that hold a smaller value, null where there is none."""
    rows = df.select(F.col(pos).cast("bigint").alias("r"), F.col(value).cast("bigint").alias("v"))
    shape = "r bigint, v bigint, prev bigint, prev_v bigint, next bigint, next_v bigint"
    near = rows.groupBy(F.floor(F.col("r") / block)).applyInPandas(_inside(block), shape)
    if size <= block:
        return near
    near = checkpointed(near)
    values = near.select("r", F.col("v").alias("w"))
    for side in ("prev", "next"):
        far = near.where(F.col(side).isNull()).select(F.col("r").alias("q"), "v")
        found = _elsewhere(far, values, side, block, size).select(F.col("q").alias("r"), F.col("at").alias("_at"), F.col("at_v").alias("_v"))
        near = near.join(found, "r", "left").withColumn(side, F.coalesce(side, "_at")).withColumn(f"{side}_v", F.coalesce(f"{side}_v", "_v")).drop("_at", "_v")
    return near


def nearest_below(df: DataFrame, pos: str, value: str, questions: DataFrame, place: str, below: str, side: str, size: int, block: int = BLOCK) -> DataFrame:
    """Answers to the questions: rows `(place, below, at, at_v)`, `at` being the nearest `pos` before
    (`side` "prev") or after ("next") `place` with a value less than `below`. Questions without one have no row."""
    values = df.select(F.col(pos).cast("bigint").alias("r"), F.col(value).cast("bigint").alias("w"))
    asked = questions.select(F.col(place).cast("bigint").alias("q"), F.col(below).cast("bigint").alias("v")).distinct()
    found = _resolve(asked, checkpointed(values), side, block, size)
    return found.select(F.col("q").alias(place), F.col("v").alias(below), "at", "at_v")
