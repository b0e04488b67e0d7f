"""Alignment of two tokenizations of the same texts, and how often id pairs are linked in the corpus.

A text is encoded with a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets at which
tokens of both end cut the tokens into groups; every A token is linked with every B token of its
group. The count of an id pair is the number of documents that hold it linked.

1. A first pass aligns all documents. A task counts its documents per pair, and sends one row per
   pair it met.
2. The distinct pairs are dealt to slices by hash. Each slice gets a minimal perfect hash, and its keys
   in the hash's order.
3. The rows of the tasks become dense count vectors of a slice, indexed by the hash, a bounded number
   of rows each; vectors are summed up as a tree, sixteen at a time.
4. A file per slice holds hash, keys and counts. A second pass aligns the documents again and looks the
   pairs of every different part of text up: the hash gives the place, the key there tells that it is
   the right one. A task holds a bounded number of slices at a time, however many pairs there are.
   The highest count of every A id is one array as long as the vocabulary.

Neither tokenizer joins anything across a blank after a letter, a digit or most signs, so the parts
between such places are aligned for themselves, each different one once while a worker remembers it.

Texts that are null or empty, or whose tokens of one vocabulary do not spell the text (characters that a
piece vocabulary takes for a blank) have no tokens: zeros and an empty digest. Very long texts are
rows like others; a part without blanks is aligned as a whole. Repeated rows count as documents of their own
and give equal rows; ties for the highest count all count as highest. An empty table gives an
empty result. Only key and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.batches import batches_of, gathered, mixed, slices, strings
from strandloom.llm.bpe import ranked, shipped, token_bytes
from strandloom.llm.tokenfile import _opened, _read, _write, build_hash, ranks_of
from strandloom.plans.session import checkpointed, dropped

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Pairs of a slice, about; rows that make one dense vector, about; vectors summed at a time.
SLICE, ROWS, FAN = 1 << 16, 1 << 20, 16
_SPACE = "▁"

# ASCII after which a blank always begins something new, in both vocabularies.
_BEFORE = np.zeros(256, bool)
_BEFORE[[c for c in range(33, 127) if chr(c) != "'"]] = True


@lru_cache(2)
def _plain(definition: str):
    """A tokenizer of its own that takes the strings of special tokens for text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    return made


def _distinct(x: np.ndarray, counted: bool = False):
    """The different values in order, and how often each occurs. Sorting is faster here than numpy's hashing."""
    x = np.sort(x)
    head = np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return (x[head], np.diff(np.append(head, len(x)))) if counted else x[head]


@lru_cache(2)
def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes that every piece stands for."""
    made = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if made.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]


class _Bytes:
    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.pool, self.begin[ids], self.size[ids])


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts behind a blank, cut into parts that begin with one, and the first part of each text
    (one more at the end). Null and empty texts have none."""
    texts = texts.cast(pa.large_string())
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    data, places = strings(pc.if_else(pc.equal(texts, ""), pa.scalar("", pa.large_string()), spaced))
    head = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before = _BEFORE[data]
        # Accented letters of two bytes, without the signs for times and divided by.
        before[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        head[1:-1] = (data[1:] == 32) & before[:-1]
    # A blank that ends a text stays with what is before, as pieces of nothing have no blank in front.
    head[places[1:] - 1] = False
    head[places] = True
    begin = np.flatnonzero(head[:-1])
    parts = pa.LargeStringArray.from_buffers(
        len(begin), pa.py_buffer(np.append(begin, len(data)).tobytes()), pa.py_buffer(np.ascontiguousarray(data))
    )
    return parts, np.searchsorted(begin, places)


class Alignments:
    """What is known of parts of texts, in the order in which they were first met: number of tokens,
    groups and links, the linked pairs with their numbers, and, if wanted, the groups as text. At most about
    `most` parts or `most_bytes` bytes of them are remembered; then those met once only are forgotten, or
    all, if that are few."""

    def __init__(self, definition: str, model: bytes, spelled: bool, counts: Counts | None = None, most: int = 300_000, most_bytes: int = 48 << 20):
        self.a, self.fast, self.b = _plain(definition), ranked(definition), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes, self.b_bytes = _Bytes(token_bytes(definition)), _Bytes(piece_bytes(model))
        if max(len(self.a_bytes.size), len(self.b_bytes.size)) > 1 << 16:
            raise ValueError("ids of 16 bits are needed")
        self.spelled, self.counts, self.most, self.most_bytes = spelled, counts, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.bytes = 0
        self.fields = {n: np.zeros(0, np.int64) for n in [*COLUMNS, "wrong", "begin", "pairs", "size", "met"]}
        self.codes = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Make room for new parts."""
        keep = self.fields["met"] > 1
        size = self.fields["size"][keep]
        if 2 * len(size) > self.most or 2 * size.sum() > self.most_bytes:
            self.clear()
            return
        names = [p for p, k in zip(self.index, keep.tolist(), strict=True) if k]
        self.index = dict(zip(names, range(len(names)), strict=True))
        self.fields = {n: v[keep] for n, v in self.fields.items()}
        if self.spelled:
            self.text = [t for t, k in zip(self.text, keep.tolist(), strict=True) if k]
        pairs = self.fields["pairs"]
        if self.counts is None:
            self.codes = gathered(self.codes, self.fields["begin"], pairs)
            self.fields["begin"] = np.cumsum(pairs) - pairs
        self.bytes = int(size.sum())

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of every part; new ones are aligned."""
        if len(self.index) > self.most or self.bytes > self.most_bytes:
            self.forget()
        coded = parts.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [p for p in different if p not in self.index]
        for i in range(0, len(new), 8192):
            self._learn(new[i : i + 8192])
        known = np.fromiter(map(self.index.__getitem__, different), np.int64, len(different))
        self.fields["met"][known] += 1
        return known[coded.indices.to_numpy(zero_copy_only=False)]

    def _encoded(self, new: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all parts one after the other and how many each has, for both vocabularies."""
        # What ends with a letter, digit or sign is split off whatever follows: as one text, it has fewer calls.
        joint = [p[-1].isascii() and bool(_BEFORE[ord(p[-1])]) for p in new]
        text = "".join(p for p, j in zip(new, joint, strict=True) if j)
        together = self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids
        together = np.array(together, np.int64)
        size = np.array([len(p.encode()) for p, j in zip(new, joint, strict=True) if j], np.int64)
        last = np.searchsorted(np.cumsum(self.a_bytes.size[together]), np.cumsum(size))
        single = [e.ids for e in self.a.encode_batch_fast([p for p, j in zip(new, joint, strict=True) if not j], add_special_tokens=False)]
        joint = np.array(joint, bool)
        length, ids = np.zeros(len(new), np.int64), [together, np.fromiter(chain.from_iterable(single), np.int64)]
        length[joint], length[~joint] = np.diff(last, prepend=-1), [len(x) for x in single]
        begin = np.zeros(len(new), np.int64)
        begin[joint] = last + 1 - length[joint]
        begin[~joint] = len(together) + np.cumsum(length[~joint]) - length[~joint]
        pieces = self.b.encode([p[1:] for p in new], num_threads=1)
        of_b = np.array([len(x) for x in pieces], np.int64)
        return [gathered(np.concatenate(ids), begin, length), np.fromiter(chain.from_iterable(pieces), np.int64, int(of_b.sum()))], [length, of_b]

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        size = np.array([len(r) for r in raw], np.int64)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        ids, length = self._encoded(new)
        right = np.ones(len(new), bool)
        for x, n, table in zip(ids, length, (self.a_bytes, self.b_bytes), strict=True):
            # An empty text has no pieces, although a blank is in front of it.
            ends = np.concatenate([[0], np.cumsum(table.size[x])])[np.concatenate([[0], np.cumsum(n)])]
            got, right = table.spelled(x), right & (np.diff(ends) == size)
            if not (len(got) == len(whole) and (got == whole).all()):
                right &= np.array([got[a:b].tobytes() == r for a, b, r in zip(ends, ends[1:], raw, strict=False)], bool)
        (a, b), (n_a, n_b) = [x[np.repeat(right, n)] for x, n in zip(ids, length, strict=True)], [np.where(right, n, 0) for n in length]
        end_a, end_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        borders = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(borders, end_a), np.searchsorted(borders, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(borders)), np.bincount(group_b, minlength=len(borders))
        # Wrong parts have no tokens here and no bytes.
        part_of = np.flatnonzero(right)[np.searchsorted(np.cumsum(size[right]), borders)]
        count = lambda weight=None: np.bincount(part_of, weight, len(new)).astype(np.int64)
        links = in_a * in_b
        # Equal tokens of a group are taken together before they meet the others.
        types_a, times_a = _distinct((group_a << 16) | a, counted=True)
        types_b, times_b = _distinct((group_b << 16) | b, counted=True)
        of_a, of_b = types_a >> 16, types_b >> 16
        width = np.bincount(of_b, minlength=len(borders))
        first = np.cumsum(width) - width
        meet = width[of_a]
        at_b = gathered(np.arange(len(types_b)), first[of_a], meet)
        at_a = np.repeat(np.arange(len(types_a)), meet)
        times = times_a[at_a] * times_b[at_b]
        key = (part_of[of_a[at_a]] << 32) | ((types_a[at_a] & 0xFFFF) << 16) | (types_b[at_b] & 0xFFFF)
        pair, where = np.unique(key, return_inverse=True)
        mult = np.bincount(where, times, len(pair)).astype(np.int64)
        owner, code = pair >> 32, pair & 0xFFFFFFFF
        pairs = np.bincount(owner, minlength=len(new))
        added = {
            "n_a": n_a, "n_b": n_b, "n_groups": count(), "n_links": count(links), "wrong": (~right).astype(np.int64),
            "begin": len(self.codes) + np.cumsum(pairs) - pairs, "pairs": pairs, "size": size + 8 * pairs, "met": np.zeros(len(new), np.int64),
            "n_best": np.zeros(len(new), np.int64), "count_sum": np.zeros(len(new), np.int64),
        }
        if self.counts is not None:
            seen, back = np.unique(code, return_inverse=True)
            n = self.counts.of(seen)[back]
            best = (n > 0) & (n == self.counts.top[code >> 16])
            np.add.at(added["n_best"], owner, mult * best)
            np.add.at(added["count_sum"], owner, mult * n)
        else:
            self.codes = np.concatenate([self.codes, code])
        for name, values in added.items():
            self.fields[name] = np.concatenate([self.fields[name], values])
        if self.spelled:
            self.text += self._texts(a, b, in_a, in_b, added["n_groups"])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.bytes += int(added["size"].sum())

    @staticmethod
    def _texts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: np.ndarray) -> list[str]:
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        out, i, j = [], 0, 0
        for n, m in zip(in_a.tolist(), in_b.tolist(), strict=True):
            out.append(f"{names_a[i] if n == 1 else ','.join(names_a[i : i + n])}|{names_b[j] if m == 1 else ','.join(names_b[j : j + m])}")
            i, j = i + n, j + m
        ends = np.cumsum(groups).tolist()
        return [";".join(out[e - g : e]) for e, g in zip(ends, groups.tolist(), strict=True)]


def _spread(codes: np.ndarray) -> np.ndarray:
    """A hash that deals pairs to slices."""
    return (mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


class Counts:
    """Counts of pairs from the files of a folder. At most `most_bytes` of slices are held at a time."""

    def __init__(self, folder: str, n_slices: int, top: np.ndarray, most_bytes: int = 96 << 20):
        self.folder, self.n, self.top, self.most_bytes = folder, n_slices, top, most_bytes
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def _slice(self, number: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, int]:
        if number in self.held:
            self.held.move_to_end(number)
            return self.held[number]
        data = _read(self.folder, f"slice-{number:06d}.bin")
        (n, levels) = struct.unpack_from("<QI", data)
        sizes = struct.unpack_from(f"<{levels}Q", data, 12)
        at, bits = 12 + 8 * levels, []
        for size in sizes:
            bits.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        made = bits, np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n), len(data)
        self.held[number] = made
        self.bytes += len(data)
        while self.bytes > self.most_bytes and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][3]
        return made

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The count of every pair; 0 for a pair that is not in the index."""
        out, number = np.zeros(len(codes), np.int64), _spread(codes) % self.n
        order = np.argsort(number, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
            levels, keys, counts, _ = self._slice(int(number[run[0]]))
            rank = ranks_of(levels, codes[run])
            hit = rank >= 0
            hit[hit] = keys[rank[hit]] == codes[run][hit]
            out[run[hit]] = counts[rank[hit]]
        return out


@lru_cache(1)
def _first_pass(definition: str, model: bytes) -> Alignments:
    return Alignments(definition, model, spelled=False)


@lru_cache(1)
def _second_pass(definition: str, model: bytes, folder: str, n_slices: int, top: bytes) -> Alignments:
    return Alignments(definition, model, spelled=True, counts=Counts(folder, n_slices, np.frombuffer(top, "<i8")))


def documents_per_pair(known: Alignments, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs linked in the texts, and how many of the texts hold each."""
    parts, first = parts_of(texts)
    number = known.numbers(parts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    wrong = np.bincount(row, known.fields["wrong"][number], len(texts)) > 0
    fine = ~wrong[row]
    held = _distinct((row[fine] << 32) | number[fine])
    row, number = held >> 32, held & 0xFFFFFFFF
    n = known.fields["pairs"][number]
    once = _distinct((np.repeat(row, n) << 32) | gathered(known.codes, known.fields["begin"][number], n))
    return _distinct(once & 0xFFFFFFFF, counted=True)


def _summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in pieces]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in pieces]), len(codes)).astype(np.int64)


def _counted(definition, model, text: str, most: int = 1 << 20):
    def rows(pieces: list, task: int) -> pa.RecordBatch:
        codes, n = _summed(pieces)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(codes), task, np.int32)), pa.array(codes), pa.array(_spread(codes)), pa.array(n)], ["task", "code", "spread", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces, task = _first_pass(definition.value, model.value), [], TaskContext.get().partitionId()
        for part in slices(batches, text, 4 << 20):
            pieces.append(documents_per_pair(known, part[text]))
            if sum(len(c) for c, _ in pieces) > most:
                pieces = [_summed(pieces)]
                if len(pieces[0][0]) > most // 2:
                    yield rows(pieces, task)
                    pieces = []
        if pieces:
            yield rows(pieces, task)

    return run


def _hashes(number: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The perfect hash of one slice and its keys in the hash's order."""
    keys = np.sort(rows["code"].to_numpy(np.int64))
    levels = build_hash(keys)
    placed = np.zeros(len(keys), "<i8")
    placed[ranks_of(levels, keys)] = keys
    return pd.DataFrame({"slice": [number[0]], "levels": [[x.tobytes() for x in levels]], "keys": [placed.tobytes()]})


def _dense(number: tuple, rows: pd.DataFrame, hashed: pd.DataFrame) -> pd.DataFrame:
    """The counts of some rows of a slice as a vector in the hash's order."""
    if not len(rows):
        return pd.DataFrame({"slice": [], "share": [], "counts": []})
    levels = [np.frombuffer(x, np.uint8) for x in hashed["levels"].iloc[0]]
    at = ranks_of(levels, rows["code"].to_numpy(np.int64))
    counts = np.bincount(at, rows["n"].to_numpy(np.float64), len(hashed["keys"].iloc[0]) // 8).astype("<i8")
    return pd.DataFrame({"slice": [number[0]], "share": [number[1]], "counts": [counts.tobytes()]})


def _sum(number: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<i8") for x in rows["counts"]], axis=0)
    return pd.DataFrame({"slice": [number[0]], "share": [number[1]], "counts": [total.astype("<i8").tobytes()]})


def _filed(folder: str):
    """Write the file of each slice; send on the highest count of every A id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, levels, keys, counts in zip(*(batch[c].to_pylist() for c in ("slice", "levels", "keys", "counts")), strict=True):
                head = struct.pack("<QI", len(keys) // 8, len(levels)) + struct.pack(f"<{len(levels)}Q", *map(len, levels))
                _write(folder, f"slice-{number:06d}.bin", iter([head, *levels, keys, counts]))
                of, n = np.frombuffer(keys, "<i8") >> 16, np.frombuffer(counts, "<i8")
                order = np.lexsort((n, of))
                last = np.append(np.flatnonzero(np.diff(of[order])), len(of) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(of[order][last]), pa.array(n[order][last])], ["a", "n"])

    return run


def build_index(docs: DataFrame, text: str, definition, model, folder: str) -> tuple[int, np.ndarray]:
    """Count the linked pairs of all documents into the files of `folder`. Returns the number of slices
    and the highest count of every A id."""
    spark = docs.sparkSession
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)
    with batches_of(spark, 1000):
        met = docs.select(F.col(text).alias("_text")).mapInArrow(
            _counted(definition, model, "_text"), "task int, code bigint, spread bigint, n bigint"
        )
        met = checkpointed(met)
    pairs = checkpointed(met.select("code", "spread").distinct())
    n_pairs, n_met = pairs.count(), met.count()
    n_slices, top = max(1, -(-n_pairs // SLICE)), np.zeros(len(token_bytes(definition.value)), "<i8")
    if not n_pairs:
        return n_slices, top
    shares = max(1, -(-n_met // (n_slices * ROWS)))
    in_slice = F.pmod("spread", F.lit(n_slices)).cast("int").alias("slice")
    hashed = checkpointed(
        pairs.select(in_slice, "code").groupBy("slice").applyInPandas(_hashes, "slice int, levels array<binary>, keys binary")
    )
    dealt = met.select(in_slice, F.pmod("task", F.lit(shares)).cast("int").alias("share"), "code", "n").groupBy("slice", "share")
    each = hashed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).groupBy("slice", "share")
    shape = "slice int, share int, counts binary"
    vectors = dealt.cogroup(each).applyInPandas(_dense, shape)
    while shares > 1:
        shares = -(-shares // FAN)
        vectors = vectors.groupBy("slice", F.floor(F.col("share") / FAN).cast("int").alias("share")).applyInPandas(_sum, shape)
    most = checkpointed(hashed.join(vectors, "slice").select("slice", "levels", "keys", "counts").mapInArrow(_filed(folder), "a bigint, n bigint"))
    for row in most.groupBy("a").agg(F.max("n").alias("n")).collect():  # as many rows as A has ids, at most
        top[row.a] = row.n
    for table in (met, pairs, hashed, most):
        dropped(table)
    return n_slices, top


def _judged(definition, model, folder: str, n_slices: int, top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _second_pass(definition.value, model.value, folder, n_slices, top.value)
        for part in slices(batches, "_text", 4 << 20):
            parts, first = parts_of(part["_text"])
            number = known.numbers(parts)

            def total(name: str, number=number, first=first) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(known.fields[name][number])])[first])

            fine = (total("wrong") == 0) & (np.diff(first) > 0)
            places = number.tolist()
            digests = [
                hashlib.sha256(";".join(map(known.text.__getitem__, places[a:b])).encode()).hexdigest() if ok else ""
                for a, b, ok in zip(first.tolist(), first[1:].tolist(), fine.tolist(), strict=False)
            ]
            sums = [pa.array(np.where(fine, total(c), 0)) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([part["_key"], *sums, pa.array(digests, pa.string())], ["_key", *COLUMNS, "groups_sha256"])

    return run


def alignments(spark: SparkSession, docs: DataFrame, key: str, text: str, a_path: str, b_path: str, folder: str) -> DataFrame:
    """Per row: numbers of A and B tokens, groups and links; links whose pair has its A id's highest
    count; the counts summed over all links; a digest of the groups. `folder` is one that all executors reach."""
    definition = shipped(spark, a_path)
    with open(b_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())
    n_slices, top = build_index(docs, text, definition, model, folder)
    best = spark.sparkContext.broadcast(top.tobytes())
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shape = f"_key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", groups_sha256 string"
    with batches_of(spark, 1000):
        judged = checkpointed(rows.mapInArrow(_judged(definition, model, folder, n_slices, best), shape))
    return judged.withColumnRenamed("_key", key)
