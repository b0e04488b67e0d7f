"""Windows of characters at every position of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.strings import windows

BLOCK = 1 << 16  # characters cut into windows at a time


def text_pieces(df: DataFrame, key: str, text: str, width: int, beyond: int) -> DataFrame:
    """Texts cut into pieces of `width` characters, each with up to `beyond` more of the next: `(key, piece, chars)`,
    pieces numbered from 0."""
    many = -(-BLOCK // width)
    block = many * width
    last = F.floor((F.length(text) - 1) / block)
    blocks = df.where(F.length(text) > 0).select(
        key, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_b")
    )
    chunk = F.substring("_text", (F.col("_b") * block + 1).cast("int"), F.lit(block + beyond)).alias("_chunk")
    within = F.least(F.floor((F.length("_text") - 1 - F.col("_b") * block) / width), F.lit(many - 1).cast("bigint"))
    pieces = blocks.select(key, "_b", chunk, F.explode(F.sequence(F.lit(0).cast("bigint"), within)).alias("_p"))
    chars = F.substring("_chunk", (F.col("_p") * width + 1).cast("int"), F.lit(width + beyond))
    return pieces.select(key, (F.col("_b") * many + F.col("_p")).alias("piece"), chars.alias("chars"))


def text_windows(df: DataFrame, key: str, text: str, width: int, before: bool = False) -> DataFrame:
    """Up to `width` characters at every position: `(key, pos0, window)`, and with `before` also the
    character in front, null at the start.

    A text is cut into blocks first, so that only one block's windows are held as an array.
    """
    last = F.floor((F.length(text) - 1) / BLOCK)
    blocks = df.where(F.length(text) > 0).select(
        key, F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_b")
    )
    start = (F.col("_b") * BLOCK + 1).cast("int")
    chunk = F.substring(F.col("_text"), start, F.lit(BLOCK + width - 1))
    cut = F.slice(windows(chunk, width), F.lit(1), F.lit(BLOCK))
    if before:
        # The first of a block takes it from the text, the others from the window before.
        first = F.when(F.col("_b") > 0, F.substring(F.col("_text"), start - 1, F.lit(1)))
        heads = F.concat(F.array(first), F.transform(cut, lambda w: F.left(w, F.lit(1))))
        each = F.posexplode(F.arrays_zip(cut.alias("window"), F.slice(heads, F.lit(1), F.size(cut)).alias("before"))).alias("_p", "_w")
        at = (F.col("_b") * BLOCK + F.col("_p")).alias("pos0")
        return blocks.select(key, "_b", each).select(key, at, F.col("_w.window").alias("window"), F.col("_w.before").alias("before"))
    return (
        blocks.select(key, "_b", F.posexplode(cut).alias("_p", "window"))
        .select(key, (F.col("_b") * BLOCK + F.col("_p")).alias("pos0"), "window")
    )
