"""Pairwise alignment of two string columns.

Spark distributes the pairs; one pair is a short dynamic program, run in Arrow batches with
one vector operation per row of the matrices of many pairs. Directions are kept only for a
band of rows at a time: score rows are stored at band borders and a band is recomputed when
the way back reaches it, so memory grows with one length times the root of the other.
Edits: `=` match, `X` mismatch, `I` insert, `D` delete.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.alphabet import chars, let


def edit_distance(x: Column, y: Column) -> Column:
    """Global penalty at unit weights, a built-in of Spark."""
    return F.levenshtein(x, y).cast("bigint")


_CELLS = 1 << 22  # stored scores per chunk of pairs


def _codes(texts: list[str], width: int, padding: int) -> np.ndarray:
    out = np.full((len(texts), width), padding, np.int32)
    for row, text in zip(out, texts):
        row[: len(text)] = np.fromiter(map(ord, text), np.int32, len(text))
    return out


def _align_chunk(x: list[str], y: list[str], gap: int, miss: int, score: int, fit: bool):
    """Per pair `(penalty, start, end, edits)` of y against all of x, or inside x if `fit`."""
    x_len, y_len = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    n, m, pairs = int(x_len.max()), int(y_len.max()), np.arange(len(x))
    xs, ys = _codes(x, n, -1), _codes(y, m, -2)
    slope = np.arange(m + 1, dtype=np.int64) * gap

    def advance(above: np.ndarray, i: int):
        """Scores of row i and how each was reached: 0 diagonal, 1 up, 2 left, in that priority."""
        diagonal = above[:, :-1] + np.where(ys == xs[:, i - 1, None], -score, miss)
        up = above[:, 1:] + gap
        row = np.empty_like(above)
        row[:, 0] = 0 if fit else i * gap
        row[:, 1:] = np.minimum(diagonal, up)
        # A run of lefts costs `gap` per step: a running minimum once that slope is removed.
        row = np.minimum.accumulate(row - slope, axis=1) + slope
        ways = np.where(row[:, 1:] == diagonal, 0, np.where(row[:, 1:] == up, 1, 2))
        return row, ways.astype(np.int8)

    band = max(1, math.isqrt(n))
    row = np.tile(slope, (len(x), 1))
    saved, best, end = [row], row[pairs, y_len].copy(), np.zeros_like(x_len)
    for i in range(1, n + 1):
        row, _ = advance(row, i)
        if i % band == 0:
            saved.append(row)
        here = row[pairs, y_len]
        better = (i <= x_len) & (here < best) if fit else i == x_len
        best[better], end[better] = here[better], i

    at_x, at_y = end.copy(), y_len.copy()
    script, used = np.zeros((len(x), n + m), np.uint8), np.zeros_like(x_len)
    for first in range((n - 1) // band * band + 1, 0, -band):
        row, ways = saved[(first - 1) // band], []
        for i in range(first, min(first + band, n + 1)):
            row, way = advance(row, i)
            ways.append(way)
        for i in range(first + len(ways) - 1, first - 1, -1):
            # Pairs whose way back is in this row; lefts keep them in it.
            while (now := np.flatnonzero((at_x == i) & (at_y > 0))).size:
                j = at_y[now]
                way = ways[i - first][now, j - 1]
                same = xs[now, i - 1] == ys[now, j - 1]
                script[now, used[now]] = np.where(way == 0, np.where(same, ord("="), ord("X")), np.where(way == 1, ord("D"), ord("I")))
                used[now] += 1
                at_x[now] -= way != 2
                at_y[now] -= way != 1
    for p in pairs:
        head = "I" * at_y[p] + ("" if fit else "D" * at_x[p])
        edits = head + script[p, : used[p]][::-1].tobytes().decode()
        yield int(best[p]), int(at_x[p]) if fit else 0, int(end[p]), edits


def _align_batch(x: pd.Series, y: pd.Series, *weights) -> list[tuple]:
    """Align an Arrow batch in chunks of pairs of like size."""
    out: list[tuple] = [(None,) * 4] * len(x)
    todo = sorted((p for p in range(len(x)) if x.iat[p] is not None and y.iat[p] is not None), key=lambda p: len(x.iat[p]))
    while todo:
        chunk, m = [], 0
        while todo:
            m = max(m, len(y.iat[todo[0]]))
            rows = math.isqrt(len(x.iat[todo[0]])) + 2
            if chunk and (len(chunk) + 1) * (m + 1) * rows > _CELLS:
                break
            chunk.append(todo.pop(0))
        done = _align_chunk([x.iat[p] for p in chunk], [y.iat[p] for p in chunk], *weights)
        for p, result in zip(chunk, done):
            out[p] = result
    return out


def global_alignment(x: Column, y: Column, gap: int = 1, mismatch: int = 1) -> Column:
    """Struct `(penalty, edits)`; of equally good ways back, diagonal before delete before insert."""

    @F.pandas_udf("penalty bigint, edits string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = _align_batch(a, b, gap, mismatch, 0, False)
        return pd.DataFrame([(r[0], r[3]) for r in found], columns=["penalty", "edits"])

    return run(x, y)


def fitting_alignment(x: Column, y: Column, gap: int = 1, mismatch: int = 1, match_score: int = 1) -> Column:
    """Struct `(penalty, start0, end0, edits)`: all of y inside x, the ends of x free.

    The end is the first one of lowest penalty; a match counts `-match_score`.
    """

    @F.pandas_udf("penalty bigint, start0 bigint, end0 bigint, edits string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = _align_batch(a, b, gap, mismatch, match_score, True)
        return pd.DataFrame(found, columns=["penalty", "start0", "end0", "edits"])

    return run(x, y)


def penalty_of_edits(edits: Column, gap: int = 1, mismatch: int = 1, match_score: int = 0) -> Column:
    def count(symbol: str) -> Column:
        return F.length(edits) - F.length(F.replace(edits, F.lit(symbol), F.lit("")))

    return ((count("I") + count("D")) * gap + count("X") * mismatch - count("=") * match_score).cast("bigint")


def is_edit(x: Column, y: Column, edits: Column) -> Column:
    """Whether the script turns x into y: it must consume both and tell match from mismatch."""

    def checked(xs: Column, ys: Column) -> Column:
        start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(True).alias("ok"))

        def step(at: Column, op: Column) -> Column:
            same = F.try_element_at(xs, at["i"]).eqNullSafe(F.try_element_at(ys, at["j"]))
            right = F.when(op == "=", same).when(op == "X", ~same).otherwise(op.isin("I", "D"))
            return F.struct(
                (at["i"] + F.when(op == "I", 0).otherwise(1)).alias("i"),
                (at["j"] + F.when(op == "D", 0).otherwise(1)).alias("j"),
                (at["ok"] & right).alias("ok"),
            )

        end = F.aggregate(chars(edits), start, step)
        return end["ok"] & (end["i"] == F.size(xs) + 1) & (end["j"] == F.size(ys) + 1)

    return let(chars(x), lambda xs: let(chars(y), lambda ys: checked(xs, ys)))
