"""Token ids in binary shards, with a minimal perfect hash index from document keys to places.

Layout of a folder:

* `shard-NNNNNN.bin`: the raw ids of its documents one after the other, each with the end id,
  as little-endian unsigned 16-bit (vocabularies up to 65 536 ids) or 32-bit integers. Shards
  follow one another in ascending key order, null keys first.
* `index-NNNNNN.bin`: a perfect hash of the keys whose hash falls to this index, and one entry
  (shard, first id in it, number of ids, ids in all documents before, fingerprint) per key.

A key goes to its index by hash, through a few bit arrays to its entry, and from there to its
ids: constant time, whatever the number of documents. The hash maps any other key to some
entry too; the stored fingerprint of 32 bits tells it apart.

The perfect hash has levels: at each one a key gets a pseudo-random bit, keys alone on their bit
keep it, the others go on to the next level. An entry's number is the rank of its bit.

Files are written under a name of their own and renamed when complete, and their content
depends on the input only, so repeated or lost tasks do no harm. A key in several rows is written
with each of them and found at its first place; rows of equal keys are in the order of their texts. Null is a key like
others; a null text is empty, a very long one is encoded whole. An empty table has an index without keys. Only key
and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.batches import batches_of, lists, mixed, rebased, salts, slices
from strandloom.llm.bpe import Memo, shipped, tokenizer
from strandloom.plans.session import checkpointed

NULL_KEY = -(2**63)
_ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8"), ("start", "<u8")])
_PLACE = "key bigint, shard int, offset bigint, n_tokens bigint"
_FOUND = f"{_PLACE}, start bigint"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """Write a whole file under its final name, or nothing."""
    store, path = _opened(folder)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")


def _read(folder: str, name: str) -> bytes:
    store, path = _opened(folder)
    with store.open_input_file(f"{path}/{name}") as file:
        return file.read()


class WordMemo(Memo):
    """Ids of texts, from the ids of their words.

    For a vocabulary that lower-cases, drops white space and ends words by tokens of their own
    (`</w>`), a text's ids are those of its parts between blanks. Closing commas and stops after a
    letter are parts of their own, and A to Z is folded beforehand, which leaves the ids as they
    are and fewer different parts.
    """

    def __init__(self, definition: str, most: int = 200_000):
        super().__init__(definition, most)
        tokens = [self.made.id_to_token(i) or "" for i in range(self.made.get_vocab_size())]
        self.ends = np.array([t.endswith("</w>") for t in tokens])

    def _learn(self, new: list[str]) -> None:
        """Encode new parts, words of letters only many at a time: each ends with an end token."""
        letters = pc.match_substring_regex(pa.array(new, pa.large_string()), r"^\pL+$").to_pylist()
        plain = [w for w, x in zip(new, letters, strict=True) if x]
        other = [w for w, x in zip(new, letters, strict=True) if not x]
        for i in range(0, len(plain), 4096):
            group = plain[i : i + 4096]
            ids = np.array(self.made.encode(" ".join(group), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(group) and last[-1] == len(ids) - 1:
                self._add(group, ids, np.diff(last, prepend=-1))
            else:
                other += group
        self._singly(other)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each."""
        texts = rebased(texts)
        # Special tokens count as they are spelled, so texts that may have any are not folded.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([,.]+)(\s)", r"\1 \2\3"))
        return self.ids_of(parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py())


@lru_cache(2)
def _memo(definition: str) -> WordMemo:
    return WordMemo(definition)


def _shards(definition, folder: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, shard = _memo(definition.value), TaskContext.get().partitionId()
        places: list[tuple[np.ndarray, np.ndarray]] = []

        def payload() -> Iterator[bytes]:
            for part in slices(batches, "_text", 4 << 20):
                ids, length = memo(part["_text"])
                total = length + 1
                out = np.full(len(ids) + len(length), end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(length)), length)] = ids
                places.append((pc.fill_null(part["_key"], NULL_KEY).to_numpy(zero_copy_only=False), total))
                yield out.tobytes()

        _write(folder, f"shard-{shard:06d}.bin", payload())
        at = 0
        for keys, total in places:
            begin = at + np.cumsum(total) - total
            at = int(begin[-1] + total[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.full(len(keys), shard, np.int32)), pa.array(begin), pa.array(total)],
                ["key", "shard", "offset", "n_tokens"],
            )

    return run


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return mixed((keys.astype(np.int64).view(np.uint64) ^ salts(1, salt)[0]) * np.uint64(0x9E3779B97F4A7C15))


def build_hash(keys: np.ndarray, room: float = 2.0) -> list[np.ndarray]:
    """Bit arrays, one per level, that map the distinct `keys` one to one to 0 ... len(keys) - 1."""
    levels, left = [], keys
    while len(left):
        bits = max(64, -(-int(room * len(left)) // 64) * 64)
        place = (_hash(left, 16 + len(levels)) % np.uint64(bits)).astype(np.int64)
        hits = np.bincount(place, minlength=bits)
        levels.append(np.packbits(hits == 1, bitorder="little"))
        left = left[hits[place] != 1]
    return levels


def ranks_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key; -1 if no level holds it (such a key was not among the built ones)."""
    out = np.full(len(keys), -1, np.int64)
    open_, before = np.arange(len(keys)), 0
    for i, level in enumerate(levels):
        if not len(open_):
            break
        bits = np.unpackbits(level, bitorder="little")
        rank = np.cumsum(bits, dtype=np.int64) - 1
        place = (_hash(keys[open_], 16 + i) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place] == 1
        out[open_[hit]] = before + rank[place[hit]]
        open_, before = open_[~hit], before + int(rank[-1]) + 1
    return out


def _marks(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 7) >> np.uint64(32)).astype(np.uint32)


def _indexes(folder: str):
    def build(number: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "start"]).drop_duplicates("key")
        keys = rows["key"].to_numpy(np.int64)
        levels = build_hash(keys)
        entries = np.zeros(len(keys), _ENTRY)
        at = ranks_of(levels, keys)
        entries["mark"][at] = _marks(keys)
        for name in ("shard", "offset", "n_tokens", "start"):
            entries[name][at] = rows[name]
        head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", len(x)) for x in levels)
        _write(folder, f"index-{number[0]:06d}.bin", iter([head, *(x.tobytes() for x in levels), entries.tobytes()]))
        return pd.DataFrame({"number": [number[0]], "n_keys": [len(keys)]})

    return build


def _index_of(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def write(docs: DataFrame, key: str, text: str, path: str, end_id: int, folder: str, per_index: int = 1 << 16) -> dict:
    """Write the ids of every text and the index to `folder`, which every executor can reach.

    `key` is an integer column. Texts are shuffled once, by ranges of the key. Returns the
    description that is also written as `about.json`.
    """
    spark = docs.sparkSession
    definition = shipped(spark, path)
    kind = "<u2" if tokenizer(definition.value).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    store, at = _opened(folder)
    store.create_dir(at, recursive=True)
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "_key").sortWithinPartitions("_key", "_text")
    with batches_of(spark, 1000):
        places = checkpointed(ordered.mapInArrow(_shards(definition, folder, end_id, kind), _PLACE))
    # One row per shard.
    sums = places.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n_rows = places.count()
    about = {"dtype": kind, "end_id": end_id, "n_index": max(1, -(-n_rows // per_index)), "n_rows": n_rows}
    found = places.join(F.broadcast(starts), "shard").withColumn("start", F.col("_before") + F.col("offset"))
    indexed = found.groupBy(_index_of(F.col("key"), about["n_index"]).alias("number")).applyInPandas(
        _indexes(folder), "number int, n_keys bigint"
    )
    about["n_keys"] = checkpointed(indexed).agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    _write(folder, "about.json", iter([json.dumps(about).encode()]))
    return about


def lookup(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """`(key, shard, offset, n_tokens, start)` of every key that the folder holds, through its index."""
    about = json.loads(_read(folder, "about.json"))
    if not about["n_keys"]:
        return keys.sparkSession.createDataFrame([], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, levels, entries = -1, [], np.zeros(0, _ENTRY)
        for batch in batches:
            number, wanted = (batch[n].to_numpy(zero_copy_only=False) for n in ("number", "key"))
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if number[a] != held:
                    held, data = int(number[a]), _read(folder, f"index-{number[a]:06d}.bin")
                    (count,) = struct.unpack_from("<I", data)
                    sizes = struct.unpack_from(f"<{count}Q", data, 4)
                    at, levels = 4 + 8 * count, []
                    for size in sizes:
                        levels.append(np.frombuffer(data, np.uint8, size, at))
                        at += size
                    entries = np.frombuffer(data, _ENTRY, offset=at)
                mine = wanted[a:b]
                rank = ranks_of(levels, mine)
                hit = rank >= 0
                hit[hit] = entries["mark"][rank[hit]] == _marks(mine[hit])
                got = entries[rank[hit]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[hit]), pa.array(got["shard"].astype(np.int32)),
                     *(pa.array(got[n].astype(np.int64)) for n in ("offset", "n_tokens", "start"))],
                    ["key", "shard", "offset", "n_tokens", "start"],
                )

    asked = keys.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("key"))
    asked = asked.withColumn("number", _index_of(F.col("key"), about["n_index"]))
    # Hot indexes do not exist, as keys are hashed; repeated keys may share one.
    return asked.repartition("number").sortWithinPartitions("number").mapInArrow(run, _FOUND)


def payloads(found: DataFrame, folder: str, digest_only: bool = False) -> DataFrame:
    """Add `ids` to the rows of `lookup`, or only `ids_crc32`, the checksum of the ids as
    little-endian unsigned 32-bit integers. Rows are dealt by shard and stretch of the file."""
    about = json.loads(_read(folder, "about.json"))
    names = ["key", "shard", "offset", "n_tokens", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        width, held, file = np.dtype(about["dtype"]).itemsize, -1, None
        for batch in batches:
            out, sizes = [], []
            for shard, offset, n in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "n_tokens")), strict=True):
                if shard != held:
                    if file:
                        file.close()
                    held, file = shard, store.open_input_file(f"{base}/shard-{shard:06d}.bin")
                file.seek(offset * width)
                ids = np.frombuffer(file.read(n * width), about["dtype"]).astype("<u4")
                out.append(zlib.crc32(ids.tobytes()) if digest_only else ids)
                sizes.append(len(ids))
            rest = [pa.array(out, pa.int64())] if digest_only else [
                lists(np.concatenate(out or [np.zeros(0, "<u4")]).astype(np.int64), np.array(sizes, np.int64), pa.int64())
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *rest], [*names, "ids_crc32" if digest_only else "ids"])

    dealt = found.repartition("shard", F.shiftright("offset", 20)).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(run, f"{_FOUND}, " + ("ids_crc32 bigint" if digest_only else "ids array<bigint>"))


def written_and_read(spark: SparkSession, docs: DataFrame, key: str, text: str, path: str, end_id: int, folder: str) -> DataFrame:
    """Write all documents, find each by its key through the index, and read its ids back."""
    write(docs, key, text, path, end_id, folder)
    rows = payloads(lookup(docs, key, folder), folder, digest_only=True)
    return rows.select(
        F.nullif("key", F.lit(NULL_KEY)).alias(key), "start", "n_tokens", "ids_crc32"
    )
