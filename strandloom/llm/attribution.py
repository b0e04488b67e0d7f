"""Token counts of fields or sections, from one encoding of the whole document.

Encoding each section alone gives other tokens than the document has. Here documents are encoded
once, each token's characters are known from its bytes, and the sorted token spans are joined
with the sorted section spans. A token that touches several sections is allocated by a rule:

* `start`, `end`: to the section of its first or last character
* `majority`: to the section that has most of its characters, the first of several
* `split`: to each section by its share of the characters (counts are fractions)

Characters outside all sections belong to section -1, which is listed if it has tokens. Null and empty texts have
no tokens; their sections are listed with 0, without given sections one line. Very long texts are encoded in
pieces on many tasks, with the ids of the whole. Repeated rows and repeated keys, null ones too, are counted
one by one: a row's sections travel with it. Of equally large shares of a token the first section gets it. An empty
table gives an empty result. Only key, text and sections are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.batches import batches_of, lists
from strandloom.llm.bpe import Vocabulary, encode, shipped, vocabulary
from strandloom.plans.session import checkpointed

RULES = ("start", "end", "majority", "split")


def line_spans(chars: np.ndarray) -> np.ndarray:
    """First characters of `\\n`-split lines; a break belongs to the line that it ends."""
    return np.concatenate([[0], np.flatnonzero(chars == 10) + 1])


def counts(ids: np.ndarray, table: Vocabulary, spans: list[tuple[int, int]] | None, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections and tokens per section of one document; `spans` are (first, after last)
    characters in ascending order without overlap, None for lines."""
    size = table.size[ids]
    data = table.bytes_of(ids)
    # A character belongs to the token of its first byte.
    first = (data & 0xC0) != 0x80
    owner = np.repeat(np.arange(len(ids)), size)[first]
    if spans is None:
        begin = line_spans(data[first])
        section_of = np.searchsorted(begin, np.arange(len(owner)), "right") - 1
        n = len(begin)
    else:
        n = len(spans)
        begin, end = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        at = np.searchsorted(begin, np.arange(len(owner)), "right") - 1
        inside = (at >= 0) & (np.arange(len(owner)) < end[at] if n else False)
        section_of = np.where(inside, at, -1)
    total = np.zeros(n + 1, np.float64)  # the last one is section -1
    if len(owner):
        place = np.where(section_of < 0, n, section_of)
        # Runs of characters that share token and section.
        head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])
        starts = np.flatnonzero(head)
        token, section = owner[starts], place[starts]
        run = np.diff(np.append(starts, len(owner)))
        opens = np.concatenate([[True], token[1:] != token[:-1]])
        if opens.all():  # no token touches two sections
            total += np.bincount(section, minlength=n + 1)
        elif rule == "split":
            whole = np.bincount(token, weights=run, minlength=len(ids))
            total += np.bincount(section, run / whole[token], n + 1)
        else:
            lead = np.flatnonzero(opens)
            if rule == "end":
                lead = np.append(lead[1:], len(token)) - 1
            elif rule == "majority":
                # What lies between sections may be several runs of one token.
                _, first, of = np.unique(token * (n + 1) + section, return_index=True, return_inverse=True)
                most = np.bincount(of, run)
                token, section = token[first], section[first]
                order = np.lexsort((first, -most, token))
                lead = order[np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))]
            total += np.bincount(section[lead], minlength=n + 1)
    # A token of inner bytes of a character goes where that character went.
    bare = np.flatnonzero(np.bincount(owner, minlength=len(ids)) == 0) if len(ids) else np.zeros(0, np.int64)
    if len(bare) and len(owner):
        at = np.maximum(np.searchsorted(owner, bare) - 1, 0)
        total += np.bincount(place[at], minlength=n + 1)
    keep = np.append(np.ones(n, bool), total[n] > 0)
    return np.append(np.arange(n), -1)[keep], total[keep]


def token_counts(docs: DataFrame, key: str, text: str, path: str, sections: str | None = None, rule: str = "majority") -> DataFrame:
    """`(key, section, n_tokens)` for every section of every row.

    `sections` is a column of arrays of structs `(begin, end)` in characters, sorted and without
    overlap; without it, the sections are the lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    definition = shipped(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()
    both = [F.col(key).alias("key")]
    if sections:
        both.append(F.transform(sections, lambda s: F.array(s["begin"], s["end"])).alias("spans"))
    rows = docs.select(F.struct(*both).alias("_row_of"), F.col(text).alias("_whole"))
    ids = encode(rows, "_row_of", "_whole", definition).select("_row_of.*", "ids")
    ids = ids.select(F.col("key").alias("_key"), "ids", *([F.col("spans").alias("_spans")] if sections else []))
    number = "double" if rule == "split" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(definition.value)
        for batch in batches:
            column = batch["ids"]
            flat, places = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            given = batch["_spans"].to_pylist() if sections else [None] * batch.num_rows
            each = [
                counts(flat[a:b], table, (s or []) if sections else None, rule)
                for a, b, s in zip(places, places[1:], given, strict=False)
            ]
            sizes = np.array([len(x[0]) for x in each], np.int64)
            for name, i, to in (("section", 0, pa.int64()), ("n_tokens", 1, pa.float64() if rule == "split" else pa.int64())):
                values = np.concatenate([x[i] for x in each]) if each else np.zeros(0)
                column = lists(values.astype(np.int64 if to == pa.int64() else np.float64), sizes, to)
                section = column if name == "section" else section
            yield pa.RecordBatch.from_arrays([batch["_key"], section, column], ["_key", "section", "n_tokens"])

    with batches_of(docs.sparkSession, 1000):
        out = checkpointed(ids.mapInArrow(run, f"_key {kind}, section array<bigint>, n_tokens array<{number}>"))
    pairs = out.select(F.col("_key").alias(key), F.explode(F.arrays_zip("section", "n_tokens")).alias("_pair"))
    return pairs.select(key, "_pair.section", "_pair.n_tokens")
