"""Byte-level BPE of whole texts, long ones as a tree of pieces.

A text of up to `leaf` characters is encoded in one go. A longer one is cut into leaves that are
encoded in parallel on all executors; then neighbours are joined pair by pair. A join encodes a
window around the border anew. It stands if, on both sides, the window and the piece share

* a place where every text is split before merging, whatever stands around it, or
* a whole token inside the same unsplit run of characters, at least `GUARD` characters from both
  the border and the window's edge: a sequence of tokens is the encoding of its run exactly if
  every two neighbours are, so it can go from one encoding to the other inside a shared token.

Otherwise the window grows, at the end to the two pieces themselves. The result equals the
encoding of the whole text in one go.

Null is an empty text, which has no tokens. Repeated rows are encoded one by one. Other columns
than key and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.batches import SEPARATOR, batches_of, gathered, lists, rebased, slices, strings
from strandloom.plans.session import checkpointed

#: Characters of the longest special token at least; no split reaches further.
GUARD = 16
#: Places that are split in any surroundings. A blank may belong to what follows, an apostrophe
#: to a contraction, so neither decides.
_SPLIT = regex.compile(
    r"(?<=[\p{L}\p{N}!-&(-/:-@\[-`{-~])(?=[ \n])|(?<=\p{L})(?=[0-9!-&(-/:-@\[-`{-~])|(?<=\p{N})(?=[A-Za-z!-&(-/:-@\[-`{-~])"
)


@lru_cache(4)
def tokenizer(definition: str):
    """The tokenizer of a definition in JSON, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def shipped(spark: SparkSession, path: str):
    """The definition at `path` on the driver, sent to the tasks (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(4)
def token_bytes(definition: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in shown]
    byte_of |= {chr(256 + i): b for i, b in enumerate(hidden)}
    made = tokenizer(definition)
    out = []
    for i in range(made.get_vocab_size()):
        token = made.id_to_token(i) or ""
        out.append(bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
    return out


#: How byte-level vocabularies of this kind split texts before they merge. A fixed value of the tokenizer files.
_PATTERN = public_tokenizers.PATTERN


@lru_cache(2)
def ranked(definition: str):
    """The same encoding, special tokens aside, from the ranks of tokens, which is faster; None for a vocabulary
    whose ids are not in the order of its merges, or that does more than byte-level splitting and merging."""
    about = json.loads(definition)
    shape = about.get("pre_tokenizer") or {}
    bare = shape.get("type") == "ByteLevel" and shape.get("use_regex", True) and not shape.get("add_prefix_space") and not about.get("normalizer")
    vocabulary = about["model"].get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in about["model"].get("merges", [])]
    made = [vocabulary.get("".join(m), -1) for m in merges]
    if not bare or made != sorted(set(made)) or -1 in made[:1] or about["model"].get("ignore_merges"):
        return None
    added = {t["id"] for t in about.get("added_tokens", [])}
    ranks = {t: i for i, t in enumerate(token_bytes(definition)) if i not in added}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _sizes(definition: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(definition)], np.int64)


class Memo:
    """Ids of parts of texts, each different part encoded once while a worker remembers it. At most
    about `most` parts are remembered; then those met in one batch only are forgotten, or all, if that are few."""

    def __init__(self, definition: str, most: int = 200_000):
        self.made, self.most = tokenizer(definition), most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.begin, self.length, self.pool, self.met = (np.zeros(0, np.int64) for _ in range(4))

    def _forget(self) -> None:
        keep = self.met > 1
        if 2 * keep.sum() > self.most:
            self._clear()
            return
        names = [p for p, k in zip(self.index, keep.tolist(), strict=True) if k]
        self.index = dict(zip(names, range(len(names)), strict=True))
        self.pool, self.length, self.met = gathered(self.pool, self.begin[keep], self.length[keep]), self.length[keep], self.met[keep]
        self.begin = np.cumsum(self.length) - self.length

    def _add(self, new: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.met = np.concatenate([self.met, np.zeros(len(length), np.int64)])
        self.pool = np.concatenate([self.pool, ids])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    def _singly(self, new: list[str]) -> None:
        found = [e.ids for e in self.made.encode_batch_fast(new, add_special_tokens=False)]
        length = np.array([len(f) for f in found], np.int64)
        self._add(new, np.fromiter(chain.from_iterable(found), np.int64, int(length.sum())), length)

    def _learn(self, new: list[str]) -> None:
        self._singly(new)

    def ids_of(self, parts: pa.Array, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and the number of ids between `borders`, numbers of parts."""
        if len(self.index) > self.most:
            self._forget()
        coded = parts.dictionary_encode()
        different = coded.dictionary.to_pylist()
        places = [self.index.get(p, -1) for p in different]
        number = np.array(places, np.int64)
        if len(unknown := np.flatnonzero(number < 0)):
            new = [different[i] for i in unknown.tolist()]
            self._learn(new)
            number[unknown] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        self.met[number] += 1
        number = number[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.length[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        return gathered(self.pool, self.begin[number], size), np.diff(ends[borders])


#: Blanks that are not ASCII, separators some engines take for blanks, and special tokens.
_ODD = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]|<\|"


class ByteMemo(Memo):
    """Texts are always split before a blank that follows something else, so the parts between
    such places are encoded for themselves. Texts with odd blanks are encoded whole."""

    def __init__(self, definition: str, most: int = 120_000):
        super().__init__(definition, most)
        self.sizes, self.fast = _sizes(definition), ranked(definition)

    def _learn(self, new: list[str]) -> None:
        """Parts that begin with a blank and end with none are split off each other, too."""
        joint = [p for p in new if p[0] in " \t\n\r\x0b\x0c" and p[-1] not in " \t\n\r\x0b\x0c"]
        self._singly([p for p in new if p[0] not in " \t\n\r\x0b\x0c" or p[-1] in " \t\n\r\x0b\x0c"])
        for i in range(0, len(joint), 4096):
            group = joint[i : i + 4096]
            text = "".join(group)  # without special tokens, see `_ODD`
            ids = np.array(self.fast.encode_ordinary(text) if self.fast else self.made.encode(text, add_special_tokens=False).ids, np.int64)
            ends = np.cumsum([len(p.encode()) for p in group])
            last = np.searchsorted(np.cumsum(self.sizes[ids]), ends)
            self._add(group, ids, np.diff(last, prepend=-1))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each."""
        texts = rebased(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        data, places = strings(pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts)
        blank = SEPARATOR[data]
        head = np.zeros(len(data) + 1, bool)
        head[1:-1] = blank[1:] & ~blank[:-1]
        head[places] = True
        begin = np.flatnonzero(head[:-1])
        parts = pa.LargeStringArray.from_buffers(
            len(begin), pa.py_buffer(np.append(begin, len(data)).tobytes()), pa.py_buffer(np.ascontiguousarray(data))
        )
        ids, length = self.ids_of(parts, np.searchsorted(begin, places))
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            whole = self.made.encode_batch_fast([texts[int(r)].as_py() for r in rows], add_special_tokens=False)
            ends, pieces, at = np.concatenate([[0], np.cumsum(length)]), [], 0
            for r, e in zip(rows, whole, strict=True):
                pieces += [ids[at : ends[r]], np.array(e.ids, np.int64)]
                at, length[r] = ends[r], len(e.ids)
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, length


@lru_cache(2)
def _memo(definition: str) -> ByteMemo:
    return ByteMemo(definition)


def _encoded(definition: str, text: str) -> np.ndarray:
    return np.array(tokenizer(definition).encode(text, add_special_tokens=False).ids, np.int32)


def _agreed(piece: np.ndarray, window: np.ndarray, words: np.ndarray, sizes: np.ndarray, text: str, side: str,
            border: int, added: list[str]) -> tuple[int, int] | None:
    """How many tokens of the piece stay and how many of the window go (left), or the mirror
    image (right); None without an agreement. `border` is the border's byte in the window."""
    ends = np.cumsum(sizes[window])
    total = int(ends[-1]) if len(ends) else 0
    byte_at = np.zeros(len(text) + 1, np.int64)
    np.cumsum([len(c.encode()) for c in text], out=byte_at[1:])
    char_of = {int(b): i for i, b in enumerate(byte_at)}
    low, high = (0, border) if side == "left" else (border, total)
    if side == "left":
        tail = piece[-len(window) * 4 - 64 :]
        marks = border - np.concatenate([[0], np.cumsum(sizes[tail[::-1]])])[::-1]
        index = np.arange(len(piece) - len(tail), len(piece) + 1)
    else:
        head = piece[: len(window) * 4 + 64]
        marks = border + np.concatenate([[0], np.cumsum(sizes[head])])
        index = np.arange(len(head) + 1)
    of_piece = dict(zip(marks.tolist(), index.tolist(), strict=True))
    of_window = {0: 0} | {int(e): i + 1 for i, e in enumerate(ends)}
    common = sorted(set(of_piece) & set(of_window))
    near = char_of[border]
    splits = {m.start() for m in _SPLIT.finditer(text)}
    specials = [(m.start(), m.end()) for a in added for m in regex.finditer(regex.escape(a), text)]
    first, last = (words[0], words[-1]) if len(words) else (None, None)
    for place in common if side == "right" else reversed(common):
        c = char_of.get(place)
        if c is None or not low <= place <= high:
            continue
        if abs(c - near) < GUARD or c < GUARD or c > len(text) - GUARD or any(a < c < b for a, b in specials):
            continue
        i, j = of_piece[place], of_window[place]
        if c in splits and 0 < j < len(words) and words[j - 1] != words[j]:
            return i, j
        run, other = (first, slice(0, j + 1)) if side == "left" else (last, slice(j - 1, None))
        if run is None or not 0 < j < len(window) or set(words[other].tolist()) != {run}:
            continue
        k = -1 if side == "left" else 0
        if 0 <= i + k < len(piece) and 0 <= j + k < len(window) and piece[i + k] == window[j + k]:
            return i, j
    return None


def joined(definition: str, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], reach: int = 96) -> np.ndarray:
    """The ids of the two neighbouring texts together, from the ids of each."""
    (lt, li), (rt, ri) = left, right
    sizes, made = _sizes(definition), tokenizer(definition)
    added = [str(a) for a in (t.content for t in made.get_added_tokens_decoder().values())]
    while True:
        a, b = min(reach, len(lt)), min(reach, len(rt))
        text = lt[len(lt) - a :] + rt[:b]
        seen = made.encode(text, add_special_tokens=False)
        window = np.array(seen.ids, np.int32)
        words = np.array([-1 - i if w is None else w for i, w in enumerate(seen.word_ids)], np.int64)
        border = len(lt[len(lt) - a :].encode())
        before = (0, 0) if a == len(lt) else _agreed(li, window, words, sizes, text, "left", border, added)
        after = (len(ri), len(window)) if b == len(rt) else _agreed(ri, window, words, sizes, text, "right", border, added)
        if before and after and before[1] <= after[1]:
            return np.concatenate([li[: before[0]], window[before[1] : after[1]], ri[after[0] :]])
        reach *= 4


def _leaves(definition, text: str, names: list[str]):
    """Encode the text of every row; the text is kept only if it is among `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(definition.value)
        for part in slices(batches, text):
            ids = lists(*memo(part[text]), pa.int32())
            yield pa.RecordBatch.from_arrays([*(part[n] for n in names), ids], [*names, "ids"])

    return run


def _cut(text: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            for row, key, whole in zip(*(part[n].to_pylist() for n in ("_row", "_key", text)), strict=True):
                for i, at in enumerate(range(0, len(whole), leaf)):
                    # The key, which may be large, travels with the first piece.
                    yield pa.RecordBatch.from_pydict(
                        {"_row": pa.array([row], pa.int64()), "_key": pa.array([None if i else key], part["_key"].type),
                         "_node": pa.array([i], pa.int64()), "_text": pa.array([whole[at : at + leaf]])}
                    )

    return run


def _joins(definition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch["_pair"][i].as_py()
                sides = [(p["_text"], np.array(p["ids"], np.int32)) for p in pair]
                ids = joined(definition.value, *sides) if len(sides) == 2 else sides[0][1]
                yield pa.RecordBatch.from_pydict(
                    {"_row": batch["_row"].slice(i, 1), "_key": batch["_key"].slice(i, 1), "_node": batch["_node"].slice(i, 1),
                     "_text": pa.array(["".join(s[0] for s in sides)]), "ids": lists(ids, np.array([len(ids)]), pa.int32())}
                )

    return run


def _encodings(docs: DataFrame, key: str, text: str, definition, leaf: int) -> list[tuple[DataFrame, Callable, str]]:
    """Rows of short texts, and those of the last joins of long ones if there are any, each with the function from
    their batches to batches with `_key` and `ids`, and the type of the result. What comes after the ids can so run
    in the same Python worker: a second one for each task would hold the vocabulary again.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    short = rows.where(F.coalesce(F.length("_text"), F.lit(0)) <= leaf)
    steps = [(short, _leaves(definition, "_text", ["_key"]), f"_key {kind}, ids array<int>")]
    shape = f"_row bigint, _key {kind}, _node bigint, _text string"
    long = rows.where(F.length("_text") > leaf).withColumn("_row", F.monotonically_increasing_id())
    nodes = checkpointed(long.mapInArrow(_cut("_text", leaf), shape))
    most = nodes.agg(F.max("_node")).first()[0]
    if most is None:
        return steps
    nodes = nodes.repartition("_row", "_node").mapInArrow(
        _leaves(definition, "_text", ["_row", "_key", "_node", "_text"]), f"{shape}, ids array<int>"
    )
    while most > 0:  # half as many pieces each round
        pairs = nodes.groupBy("_row", F.shiftright("_node", 1).alias("_half")).agg(
            F.first("_key", ignorenulls=True).alias("_key"), F.sort_array(F.collect_list(F.struct("_node", "_text", "ids"))).alias("_pair")
        )
        pairs, most = pairs.withColumnRenamed("_half", "_node"), most >> 1
        if most > 0:
            nodes = pairs.mapInArrow(_joins(definition), f"{shape}, ids array<int>")
    return [*steps, (pairs, _joins(definition), f"{shape}, ids array<int>")]


def encode(docs: DataFrame, key: str, text: str, definition, leaf: int = 1 << 15) -> DataFrame:
    """`(key, ids)` of every row; `definition` comes from `shipped`.

    Only texts longer than `leaf` characters are shuffled. Their leaves are written once, so that
    a repeated task cannot number them differently.
    """
    found = [rows.mapInArrow(run, kind).select("_key", "ids") for rows, run, kind in _encodings(docs, key, text, definition, leaf)]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)


class Vocabulary:
    """Bytes of all ids as one array, and where each id's bytes are."""

    def __init__(self, definition: str):
        tokens = [*token_bytes(definition), b""]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other; unknown ids have none."""
        known = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)
        return gathered(self.pool, self.begin[known], self.size[known])

    def texts(self, ids: np.ndarray, length: np.ndarray) -> pa.Array:
        """The text of each row of `length` ids; bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)
        ends = np.concatenate([[0], np.cumsum(self.size[known])])
        places = ends[np.concatenate([[0], np.cumsum(length)])]
        data = self.bytes_of(ids)
        heads = places[:-1][places[:-1] < len(data)]
        try:
            if ((data[heads] & 0xC0) == 0x80).any():
                raise UnicodeError
            bytes(data).decode()
            return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(places.tobytes()), pa.py_buffer(data))
        except UnicodeError:
            rows = [bytes(data[a:b]).decode(errors="replace") for a, b in zip(places, places[1:], strict=False)]
            return pa.array(rows, pa.large_string())


@lru_cache(2)
def vocabulary(definition: str) -> Vocabulary:
    return Vocabulary(definition)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the number of values per row, 0 for null."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), length


_PORTION = 1 << 18  # ids decoded together


def _decoded(definition, ids: str):
    """Batches of `_key`, ids and the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(definition.value)
        for batch in batches:
            ends, at = np.cumsum(flat_lists(batch[ids])[1]), 0
            while at < batch.num_rows:  # about a MB of text at a time, or one row
                base = ends[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(ends, base + _PORTION, "right")) - at))
                at += part.num_rows
                texts = table.texts(*flat_lists(part[ids])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part["_key"], part[ids], texts], ["_key", ids, "decoded"])

    return run


def decode(encoded: DataFrame, key: str, ids: str, definition) -> DataFrame:
    """Add `decoded`, the text of the ids, special tokens included; null ids give an empty text."""
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    out = rows.mapInArrow(_decoded(definition, "_ids"), f"_key {kind}, _ids array<int>, decoded string")
    return out.withColumnsRenamed({"_key": key, "_ids": ids})


def encoded_and_decoded(docs: DataFrame, key: str, text: str, definition, leaf: int = 1 << 15) -> DataFrame:
    """`(key, ids, decoded)` of every row: `decode` of `encode`, in one Python worker a task."""
    kind = docs.schema[key].dataType.simpleString()

    def both(run):
        then = _decoded(definition, "ids")
        return lambda batches: then(run(batches))

    shape = f"_key {kind}, ids array<int>, decoded string"
    found = [rows.mapInArrow(both(run), shape) for rows, run, _ in _encodings(docs, key, text, definition, leaf)]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)


def digests(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Encode and decode every text: number of ids, digest of the ids, digest of the decoded text.
    The small result is written, so that the texts can go to Python a thousand at a time."""
    definition = shipped(docs.sparkSession, path)
    both = encoded_and_decoded(docs, key, text, definition)
    with batches_of(docs.sparkSession, 1000):
        return checkpointed(
            both.select(
                key,
                F.size("ids").cast("bigint").alias("n_tokens"),
                F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                F.sha2("decoded", 256).alias("decoded_sha256"),
            )
        )
