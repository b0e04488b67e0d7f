"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct 5-word shingles (64-bit hashes of lower-cased words).
Documents with the same set form a class, known by its size and 128 bits; classes are numbered and compared.

A sketch has `REGISTERS` buckets. Every bucket hashes all shingles with its own salt, so short
documents fill it too, and keeps the smallest hash compressed to 16 bits: the number of leading
zeros and the 10 bits after the first one. Equal registers happen by chance as well; the estimate
of the Jaccard similarity subtracts what is expected of sets of these sizes.

Candidates share one of `BANDS` bands of `ROWS` registers: a pair at the threshold of 0.75 misses
all of them with a probability of 1e-5, one at 0.8 with 1e-7. A pair goes on if its sizes
allow the threshold, if its one-bit signatures differ in no more places, and if its estimate is
no lower, than six standard deviations allow at the threshold. What goes on is verified on the
full sets.

A bucket of m documents does not emit m squared pairs. First each document is compared with the most
similar of the leaders, two of each of its buckets, then components are formed, and only buckets that hold several
components are compared in full, block by block, on the full sets. No candidate is capped or left out, as a pair inside
a component adds no link that could change the result.

Nulls, texts without words: empty sets, linked with nothing. A null key: not linked, kept. Rows of one key are
one document: what any of its texts is linked with, all are. Of a group the smallest key is kept, so there
are no ties. Very long texts are rows like others, hashed whole. An empty table gives an empty result. Only key
and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.batches import Words, batches_of, lists, mixed, salts, slices, words
from strandloom.operators.components import connected_components
from strandloom.plans.session import checkpointed

WIDTH = 5
BANDS, ROWS = 30, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
BLOCK_BYTES = 1 << 19
_BITS = 1 << 26  # of the filter in front of a join, 8 MB
_SALTS = salts(2 * REGISTERS, 3).reshape(2, REGISTERS)
#: Fixed value: expected share of chance collisions, times 2^mantissa, of sets of one size.
COLLISIONS = 0.169919487159739


def shingle_sets(text: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending inside it, and how many each row has."""
    hashes = text.hashes()
    rolled, first = text.windows(hashes, WIDTH)
    row = text.row[first]
    few = np.flatnonzero((text.count > 0) & (text.count < WIDTH))
    if len(few):  # the whole sequence is one shingle
        head = np.cumsum(text.count) - text.count
        value = np.zeros(len(few), np.uint64)
        for i in range(WIDTH - 1):
            has = text.count[few] > i
            value[has] += hashes[head[few[has]] + i] * salts(WIDTH, 4)[i]
        rolled = np.concatenate([rolled, mixed(value + text.count[few].astype(np.uint64))])
        row = np.concatenate([row, few])
    order = np.lexsort((rolled, row))
    rolled, row = rolled[order], row[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (rolled[1:] != rolled[:-1]) | (row[1:] != row[:-1])
    return rolled[keep], np.bincount(row[keep], minlength=len(text.count))


def registers(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of compressed registers for every set; zeros for empty sets."""
    out = np.zeros((len(size), REGISTERS), np.uint16)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    heads = (np.cumsum(size) - size)[full]
    for k in range(REGISTERS):
        low = np.minimum.reduceat((shingles ^ _SALTS[0, k]) * _SALTS[1, k], heads)
        # The exponent of a double is the place of the first one, its mantissa what follows.
        parts = (low >> np.uint64(11)).astype(np.float64).view(np.uint64)
        zeros = np.where(low >> np.uint64(11) == 0, 63, 1075 - (parts >> np.uint64(52)).astype(np.int64))
        mantissa = (parts >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        out[full, k] = ((zeros & 63) << MANTISSA) | mantissa.astype(np.int64)
    return out


def _digests(sets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits that name every set; zeros for empty ones."""
    sums = np.zeros((2, len(size)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        heads = (np.cumsum(size) - size)[full]
        for i in range(2):
            sums[i, full] = np.add.reduceat(mixed(sets ^ _SALTS[i, 0]), heads)
    return sums.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        sets, size = shingle_sets(words(part["_text"], fold=True))
        found = registers(sets, size)
        bits = np.packbits((found & 1).astype(np.uint8), axis=1, bitorder="little")
        bits = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).copy().view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part["_key"], pa.array(size.astype(np.int64)), *map(pa.array, _digests(sets, size)),
             *(pa.array(bits[:, i]) for i in range(2)),
             pa.array([r.tobytes() for r in found], pa.binary())],
            ["_key", "_n", "_h1", "_h2", "_s1", "_s2", "_sketch"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.frombuffer(b"".join(batch["_sketch"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        value = mixed(found.astype(np.uint64) @ np.uint64(1 << 16) ** np.arange(ROWS, dtype=np.uint64))
        value = mixed(value + salts(BANDS, 5)[None, :])
        flat = lists(value.ravel().view(np.int64), np.full(batch.num_rows, BANDS), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("_key", "_n", "_s1", "_s2")), flat], ["_key", "_n", "_s1", "_s2", "_bands"])


def _may_link(threshold: float, a: str, b: str) -> Column:
    """What sizes and one-bit signatures of a pair allow. A register's last bit agrees if the
    registers do, else every other time."""
    differ = F.bit_count(F.col(f"{a}_s1").bitwiseXOR(F.col(f"{b}_s1"))) + F.bit_count(F.col(f"{a}_s2").bitwiseXOR(F.col(f"{b}_s2")))
    share = (1 - threshold) / 2
    most = REGISTERS * share + 6 * (REGISTERS * share * (1 - share)) ** 0.5
    sizes = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * round(100 * threshold)
    return sizes & (differ <= int(most))


def _estimated(threshold: float):
    """Keep pairs whose collision-corrected estimate allows the threshold."""
    lowest = threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("_sketch", "_other"))
            n, m = (batch[c].to_numpy().astype(np.float64) for c in ("_n", "_m"))
            chance = COLLISIONS / 2**MANTISSA * 4 * (n / m) / (1 + n / m) ** 2
            estimate = ((a == b).mean(1) - chance) / (1 - chance)
            keep = pa.array(estimate >= lowest)
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(estimate)], ["a", "b", "estimate"])
            yield out.filter(keep)

    return run


def _estimates(pairs: DataFrame, sketches: DataFrame, threshold: float, kind: str) -> DataFrame:
    """`(a, b, estimate)` of the pairs whose estimate allows the threshold."""
    left = sketches.select(F.col("_key").alias("a"), "_sketch", "_n")
    right = sketches.select(F.col("_key").alias("b"), F.col("_sketch").alias("_other"), F.col("_n").alias("_m"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.mapInArrow(_estimated(threshold), f"a {kind}, b {kind}, estimate double")


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: type = np.uint64) -> DataFrame:
    """Shingle sets of the wanted classes, as numbers of this width. A bitmap of fixed size keeps texts of other
    keys from being hashed and shuffled; the name of the set decides, as a key may have several texts."""
    wanted = classes.join(wanted.select("_key").distinct(), "_key", "left_semi")
    place = F.pmod(F.xxhash64(F.col("_of").cast("string")), F.lit(_BITS))
    marks = wanted.select(place.alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_map")
    )
    maps = np.zeros((_BITS // 32768 + 1, 4096), np.uint8)
    for row in marks.collect():  # 8 MB at most
        maps[row["_b"]] = np.frombuffer(bytes(row["_map"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            bucket, bit = batch["_bucket"].to_numpy(), batch["_bit"].to_numpy()
            hit = (table[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            for part in slices(iter([batch.filter(pa.array(hit.astype(bool)))]), "_text"):
                sets, size = shingle_sets(words(part["_text"], fold=True))
                ends = np.cumsum(size)
                cells = [sets[e - s : e].astype(width).tobytes() for e, s in zip(ends, size, strict=True)]
                names = [part["_of"], pa.array(size.astype(np.int64)), *map(pa.array, _digests(sets, size))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(cells, pa.binary())], ["_of", "_n", "_h1", "_h2", "_set"])

    placed = docs.withColumnRenamed("_key", "_of").withColumn("_p", place).withColumns(
        {"_bucket": F.expr("bitmap_bucket_number(_p)"), "_bit": F.expr("bitmap_bit_position(_p)")}
    )
    kind = docs.schema["_key"].dataType.simpleString()
    found = placed.mapInArrow(run, f"_of {kind}, _n bigint, _h1 bigint, _h2 bigint, _set binary")
    with batches_of(docs.sparkSession, 1000):
        named = found.join(wanted.select("_of", "_n", "_h1", "_h2", "_key"), ["_of", "_n", "_h1", "_h2"])
        return checkpointed(named.select("_key", "_set").dropDuplicates(["_key"]))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["_set"], batch["_other"], strict=True):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= round(100 * threshold) * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The pairs whose full sets reach the threshold, written to a table."""
    left = sets.select(F.col("_key").alias("a"), "_set")
    right = sets.select(F.col("_key").alias("b"), F.col("_set").alias("_other"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    with batches_of(sets.sparkSession, 200):
        return checkpointed(both.mapInArrow(_verified(threshold), f"a {kind}, b {kind}"))


def _block_links(threshold: float, width: type):
    """Compare the documents of one or two blocks on shingles of this width. Shingles of one set may fall together
    when cut, so two sets can share as many more as the one with fewer such has; no pair at the threshold is
    missed. For every two components, the most similar pair that may reach it is a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch["_rows"].type.value_type.field("_key").type
            for i in range(batch.num_rows):
                block = batch["_rows"][i].as_py()
                sets = [np.unique(np.frombuffer(x["_set"], width)) for x in block]
                size, part = (np.array([x[c] for x in block]) for c in ("_n", "component"))
                first = np.array([x["_block"] for x in block]) == min(x["_block"] for x in block)
                owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
                shingle, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                # Only shingles of several documents matter; as products of 0/1 matrices.
                number = np.cumsum(times > 1) - 1
                use = times[at] > 1
                owner, at = owner[use], number[at[use]]
                rows, columns = np.flatnonzero(first), np.arange(len(sets)) if first.all() else np.flatnonzero(~first)
                both = np.zeros((len(rows), len(columns)), np.float32)
                for low in range(0, int((times > 1).sum()), 4096):
                    pick = (at >= low) & (at < low + 4096)
                    matrix = np.zeros((len(sets), 4096), np.float32)
                    matrix[owner[pick], at[pick] - low] = 1
                    both += matrix[rows] @ matrix[columns].T
                fallen = size - np.array([len(v) for v in sets])
                if fallen.any():
                    both += np.minimum(fallen[rows][:, None], fallen[columns][None, :])
                union = size[rows][:, None] + size[columns][None, :] - both
                hit = (100 * both >= round(100 * threshold) * union) & (part[rows][:, None] != part[columns][None, :])
                best: dict[tuple, tuple] = {}
                for r, c in zip(*np.nonzero(hit), strict=True):
                    x, y = block[rows[r]], block[columns[c]]
                    pair = tuple(sorted((x["component"], y["component"])))
                    best[pair] = max(best.get(pair, (0.0,)), (float(both[r, c] / union[r, c]), *sorted((x["_key"], y["_key"]))))
                ends = [pa.array([v[k] for v in best.values()], kind) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return run


def _across(placed: DataFrame, sets: DataFrame, threshold: float, kind: str, width: type = np.uint64) -> DataFrame:
    """Candidates between documents of one bucket in different components. A bucket is dealt into
    blocks of about `BLOCK_BYTES`, and every two blocks are compared as a whole, so that no pairs are
    emitted. A row goes to each pair of blocks that its own is in: once in most buckets."""
    block = F.pmod(F.xxhash64(F.col("_key").cast("string")), F.col("_blocks")).cast("int")
    dealt = placed.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    pair = F.struct(F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"))
    one = F.struct("_key", "component", "_n", "_block", "_set")
    groups = dealt.withColumn("_pair", pair).join(sets, "_key").groupBy("_band", "_pair").agg(F.collect_list(one).alias("_rows"))
    with batches_of(sets.sparkSession, 4):
        return checkpointed(groups.select("_rows").mapInArrow(_block_links(threshold, width), f"a {kind}, b {kind}")).distinct()


def _confirmed(rows: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    return _links(pairs, _sets_of(rows, classes, ends), threshold, "bigint")


def components(docs: DataFrame, key: str, text: str, threshold: float = 0.75) -> DataFrame:
    """`(key, n_shingles, component_id, kept)` for every row."""
    kind = "bigint"  # of the number of a class, which is the `_key` of all that follows the classes
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shape = f"_key {docs.schema[key].dataType.simpleString()}, _n bigint, _h1 bigint, _h2 bigint, _s1 bigint, _s2 bigint, _sketch binary"
    with batches_of(docs.sparkSession, 1000):
        sketches = checkpointed(rows.mapInArrow(_sketches, shape))
    full = sketches.where((F.col("_n") > 0) & F.col("_key").isNotNull())
    name = ["_n", "_h1", "_h2"]
    classes = full.groupBy(*name).agg(F.min("_key").alias("_of"))
    classes = checkpointed(classes.withColumn("_key", F.monotonically_increasing_id()))
    first = full.withColumnRenamed("_key", "_of").join(classes, ["_of", *name])
    reps = checkpointed(first.select("_key", "_n", "_s1", "_s2", "_sketch").dropDuplicates(["_key"]))
    banded = reps.mapInArrow(_bands, f"_key {kind}, _n bigint, _s1 bigint, _s2 bigint, _bands array<bigint>").select(
        "_key", "_n", "_s1", "_s2", F.explode("_bands").alias("_band")
    )
    # Most bands have one document; they are dropped by counts alone.
    several = banded.groupBy("_band").agg(F.count("*").alias("_count")).where("_count > 1").select("_band")
    banded = checkpointed(banded.join(several, "_band", "left_semi"))
    one = F.struct("_key", "_n", "_s1", "_s2")
    leaders = banded.groupBy("_band").agg(F.min(one).alias("_low"), F.max(one).alias("_high")).where("_low._key <> _high._key")
    led = banded.join(checkpointed(leaders), "_band").select(
        F.col("_key").alias("b"), F.col("_n").alias("b_n"), F.col("_s1").alias("b_s1"), F.col("_s2").alias("b_s2"),
        F.explode(F.array("_low", "_high")).alias("_l"),
    )
    led = led.select("*", *(F.col(f"_l._{c}").alias(f"a_{c}") for c in ("n", "s1", "s2")), F.col("_l._key").alias("a"))
    led = led.where((F.col("a") != F.col("b")) & _may_link(threshold, "a", "b"))
    stars = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = checkpointed(_estimates(stars, reps, threshold, kind))

    def joined_up(links: DataFrame) -> DataFrame:
        return checkpointed(connected_components(reps.select(F.col("_key").alias("node")), links, "node", "a", "b"))

    # The most similar leader of each document first: most components are found with those.
    ends = stars.select("a", "b", "estimate", F.explode(F.array("a", "b")).alias("_end"))
    best = ends.groupBy("_end").agg(F.max(F.struct("estimate", "a", "b")).alias("_best")).select("_best.a", "_best.b").distinct()
    best = checkpointed(best)
    members = best.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    links = _links(best, _sets_of(rows, classes, members), threshold, kind)
    # Several texts of one key are one document.
    ids = full.select("_key", *name).distinct().groupBy("_key").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_key")
    texts = full.join(ids, "_key", "left_semi").withColumnRenamed("_key", "_same").join(classes, name).select("_same", "_key").distinct()
    least = texts.groupBy("_same").agg(F.min("_key").alias("a"))
    links = links.unionByName(checkpointed(texts.join(least, "_same").where("a <> _key").select("a", F.col("_key").alias("b"))))
    parts = joined_up(links)

    # Then everything else that shares a bucket across components.
    placed = banded.select("_band", "_key", "_n").join(parts.withColumnRenamed("node", "_key"), "_key")
    size = F.ceil(F.sum("_n") / (BLOCK_BYTES // 8)).alias("_blocks")
    mixed_bands = placed.groupBy("_band").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), size)
    mixed_bands = mixed_bands.where("_x <> _y").select("_band", "_blocks")
    placed = checkpointed(placed.join(mixed_bands, "_band"))
    if not placed.isEmpty():
        few = _sets_of(rows, classes, placed.select("_key"), np.uint32)
        more = checkpointed(_across(placed, few, threshold, kind, np.uint32))
        if not more.isEmpty():
            found = _confirmed(rows, classes, more, threshold)
            links = links.union(found)
            parts = joined_up(links)
            # Where the most similar pair on cut shingles failed, another of the same components may
            # not; those components are compared anew on whole shingles, where none can fail.
            ends = more.join(found, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
            again = checkpointed(parts.join(ends, "node", "left_semi").select("component").distinct())
            if not again.isEmpty():
                placed = placed.drop("component").join(parts.withColumnRenamed("node", "_key"), "_key")
                placed = checkpointed(placed.join(again, "component", "left_semi"))
                more = checkpointed(_across(placed, _sets_of(rows, classes, placed.select("_key")), threshold, kind))
                links = links.union(_confirmed(rows, classes, more, threshold))
                parts = joined_up(links)
    found = classes.join(parts.withColumnRenamed("node", "_key"), "_key")
    least = found.groupBy("component").agg(F.min("_of").alias("_c"))
    found = found.join(least, "component").select(*name, "_c")
    out = sketches.select("_key", *name).join(found, name, "left")
    # A text without words may be one of several of its key.
    several = checkpointed(out.where("_n = 0 AND _key IS NOT NULL").select("_key").distinct().join(
        full.select("_key", *name).join(found, name).select("_key", F.col("_c").alias("_other")).distinct(), "_key"
    ))
    out = out.join(several.groupBy("_key").agg(F.min("_other").alias("_other")), "_key", "left")
    component = F.when(F.col("_key").isNotNull(), F.coalesce("_c", "_other", "_key"))
    return out.select(
        F.col("_key").alias(key), F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"),
    )
