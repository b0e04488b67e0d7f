"""Product codes of vectors: one codebook per part position, fitted by Lloyd's rounds on integers.

Vectors become integers, are cut into equal parts, and every part becomes a row that lives with the
owner of its `(position, entry, salt)`: the entry it is assigned to, and one of many shares of that
entry, so that an entry that holds a third of all parts has as many owners as any shuffle has tasks. In
a round each owner sums up its resident parts (a few rows go on from each), the entries move to
their means, and owners assign their residents anew, in place. Parts that stay are written where
they are; only those that change their entry are shuffled to their new owners. Codebooks
(positions x entries x width numbers, whatever the number of rows) are all that the driver holds.

Everything is integer arithmetic, so results do not depend on the order of rows or on lost tasks.
Every round is a table in the shared folder, and the tables of the round before are dropped.

Rows whose vector is null or holds a null or non-finite component have no code and are left out.
Repeated rows and repeated keys are coded one by one. Initial entries are the vectors of the smallest
keys, null keys last, equal keys in the order of their vectors; with fewer rows than entries there are
fewer entries, which changes no code. An empty table gives an empty result. Labels are compared as
values, nulls together. All vectors need one length, a multiple of the number of parts, whatever it
is, and components of at most `sqrt(2^63 / length) / 2` after scaling, so that no sum of squares
leaves 64 bits; other vectors are an error. Only the three columns are read, so names of others cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.batches import lists
from strandloom.plans.session import checkpointed, dropped, shared_folder

_EXACT = 2**53


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def scaled(rows: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of every component; an error where squares might leave 64 bits."""
    out = np.floor(rows.astype(np.float64) * factor)
    limit = np.sqrt(2.0**63 / max(1, rows.shape[1])) / 2
    if rows.size and np.abs(out).max() >= limit:
        raise ValueError(f"components of at most {limit / factor:g} can be coded")
    return out.astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part, the first of equally near ones, and its squared distance."""
    most = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    if 4 * float(most) ** 2 * parts.shape[1] < _EXACT:  # whole numbers that doubles hold exactly
        parts, book = parts.astype(np.float64), book.astype(np.float64)
    far = (parts**2).sum(1)[:, None] - 2 * (parts @ book.T) + (book**2).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(parts)), at].astype(np.int64)


def assigned(position: np.ndarray, parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` for parts of several positions; `books` has one codebook per position."""
    at, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for p in np.unique(position):
        mine = np.flatnonzero(position == p)
        at[mine], far[mine] = nearest(parts[mine], books[p])
    return at, far


def _values(column: pa.Array, width: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width or not (pc.list_value_length(column).to_numpy(zero_copy_only=False) == width).all():
        raise ValueError(f"vectors of {width} components are needed")
    return flat.reshape(len(column), width)


def _cut(books: np.ndarray, factor: int):
    """Vectors to parts with their first entry. Key and label travel with the first part."""
    n, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = scaled(_values(batch["_vector"], n * width), factor).reshape(-1, width)
            position = np.tile(np.arange(n), batch.num_rows)
            entry, _ = assigned(position, parts, books)
            owner = np.repeat(np.arange(batch.num_rows), n)
            first = pa.array(np.where(position == 0, owner, 0), mask=position != 0)
            yield pa.RecordBatch.from_arrays(
                [batch["_row"].take(pa.array(owner)), pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)),
                 lists(parts.ravel(), np.full(len(parts), width), pa.int32()), batch["_of"].take(first)],
                ["_row", "position", "entry", "part", "_of"],
            )

    return run


def _judge(books: np.ndarray):
    """Add the nearest entry to the residents, and how far it is."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch["position"].to_numpy(zero_copy_only=False)
            now, far = assigned(position, _values(batch["part"], width).astype(np.int64), books)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(now.astype(np.int32)), pa.array(far)], [*batch.schema.names, "now", "far"]
            )

    return run


def _owned(parts: DataFrame, owners: int) -> DataFrame:
    """Send parts to the owners of their entry. An entry has as many shares as there are owners."""
    return parts.repartition(owners, "position", "entry", F.pmod(F.xxhash64("_row"), F.lit(owners)))


def _parted(judged: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Write the judged residents once: those that stay and those that leave, in folders of their own."""
    spark = judged.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    marked = judged.select("_row", "position", F.col("now").alias("entry"), "part", "_of", (F.col("now") != F.col("entry")).cast("int").alias("moved"))
    marked.write.partitionBy("moved").parquet(path)
    table = spark.read.schema(marked.schema).parquet(path)
    return table.where("moved = 0").drop("moved"), table.where("moved = 1").drop("moved"), path


def _means(residents: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of their members' mean; entries without members stay."""
    width = books.shape[2]
    sums = residents.groupBy("position", "entry").agg(
        F.count("*").alias("n"), *(F.sum(F.col("part")[i].cast("bigint")).alias(f"s{i}") for i in range(width))
    )
    moved = books.copy()
    for row in sums.collect():  # positions x entries rows at most
        moved[row.position, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return moved


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-separated."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(
    vectors: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096,
) -> tuple[DataFrame, np.ndarray]:
    """Codebooks `[part, entry, component]` and one row per usable vector: `(key, label, code, error)`,
    the code as two hexadecimal digits per part, the error as the sum of squared distances."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    first = np.array([r[0] for r in rows.orderBy(F.asc_nulls_last("_key"), "_vector").select("_vector").limit(entries).collect()])
    of = f"struct<_key:{rows.schema['_key'].dataType.simpleString()},_label:{rows.schema['_label'].dataType.simpleString()}>"
    if not len(first):
        empty = rows.select(F.col("_key").alias(key), F.col("_label").alias(label), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    if first.ndim != 2 or first.shape[1] % parts or not first.shape[1]:
        raise ValueError(f"vectors of one length, a multiple of {parts}, are needed")
    width = first.shape[1] // parts
    books = scaled(first, factor).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    shape = f"_row bigint, position int, entry int, part array<int>, _of {of}"
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), F.struct("_key", "_label").alias("_of"), "_vector")
    residents = checkpointed(_owned(numbered.mapInArrow(_cut(books, factor), shape), owners))
    old = [residents]
    for _ in range(rounds - 1):
        books = _means(residents, books)
        judged = residents.mapInArrow(_judge(books), f"{shape}, now int, far bigint")
        stay, leave, path = _parted(judged)
        arrived = checkpointed(_owned(leave, owners))
        for table in old:
            dropped(table)
        residents = stay.unionByName(arrived)
        stay._written_to = path
        old = [stay, arrived]
    if rounds:
        books = _means(residents, books)
    judged = residents.mapInArrow(_judge(books), f"{shape}, now int, far bigint").drop("part", "entry")
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("now"))))), 2, "0") for p in range(parts)]
    coded = judged.groupBy("_row").agg(F.max("_of").alias("_of"), F.concat(*digits).alias("code"), F.sum("far").alias("error"))
    out = checkpointed(coded.select(F.col("_of._key").alias(key), F.col("_of._label").alias(label), "code", "error"))
    for table in old:
        dropped(table)
    return out, books


def with_label_error(coded: DataFrame, label: str) -> DataFrame:
    """Add the error summed over all rows of the same label, nulls together."""
    sums = coded.groupBy(F.col(label).alias("_same")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_same"))).drop("_same")
