"""Arrow batches of texts as flat numpy arrays, for operators that run inside Spark tasks.

Everything works on the UTF-8 bytes of a whole batch at once: words are runs of bytes other
than space, tab, newline, vertical tab, form feed and carriage return, which never occur inside
a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Send at most `rows` rows at a time to Python in the jobs that run inside, as rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """`n` random odd 64-bit numbers; the same ones for the same seed."""
    start = np.uint64((seed * 0x632BE59BD9B4E019 + 0x1234567) % 2**64)
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + start) | np.uint64(1)


_BYTE = salts(256, 1)
_PLACE = np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, np.uint64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, null as empty, and where each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    begins = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def rebased(column: pa.Array) -> pa.Array:
    """The same strings, null as empty, with offsets from 0, as some kernels want them."""
    data, places = strings(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(places.tobytes()), pa.py_buffer(data))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of `column` have about `most` bytes; no row is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column].cast(pa.large_string())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all rows and the number of values per row."""
    places = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=places[1:])
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat, kind))


def gathered(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs `pool[begin : begin + length]`, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin - (ends - length), length) + np.arange(total)]


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... inside each of the consecutive groups of these sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@dataclass
class Words:
    """Words of a batch: `row` of each, first byte `begin`, byte `end` after the last, `count` per row."""

    data: np.ndarray
    places: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return _run_hashes(self.data, self.begin, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of `width` words inside one row, and the first word of each."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        factors = salts(width, 2)
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += hashes[i : i + n] * factors[i]
        first = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return mixed(total[first]), first


def _run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs follow one another and do not overlap."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    place = within(size)
    bytes_of = data[np.repeat(begin, size) + place]
    value = _BYTE[bytes_of] * _PLACE[place % len(_PLACE)]
    if place.size and place.max() >= len(_PLACE):
        value ^= mixed((place // len(_PLACE)).astype(np.uint64) * _GOLDEN)
    heads = np.cumsum(size) - size
    full = size > 0
    out = np.zeros(len(begin), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(value, heads[full])
    return mixed(out + size.astype(np.uint64) * _GOLDEN)


def words(column: pa.Array, fold: bool = False) -> Words:
    """The words of every string; `fold` lower-cases A to Z first."""
    data, places = strings(column)
    if fold:
        upper = (data >= 65) & (data <= 90)
        data = data + (upper.astype(np.uint8) << 5)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    border = np.zeros(len(data) + 1, bool)
    border[places] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    heads = np.searchsorted(begin, places)
    count = np.diff(heads)
    return Words(data, places, begin, end, np.repeat(np.arange(len(count)), count), count)


def line_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`\\n`-split lines of every string: row, first byte, byte after the last, hash of the bytes."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([places[:-1], breaks + 1]), kind="stable")
    # A break ends the line it follows, a row's end the last one; empty rows have one empty line.
    ends = np.sort(np.concatenate([breaks, places[1:]]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(len(places) - 1), np.searchsorted(places, breaks, "right") - 1]), kind="stable")
    return owner, begin, ends, _run_hashes(data, begin, ends)
