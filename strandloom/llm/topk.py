"""Exact top-k search by inner product with the threshold algorithm.

Candidates are dealt into blocks, queries too, and every pair of blocks is one piece of work.
A candidate block keeps, for every dimension, its vectors sorted by that component. For a query,
lists are read from the end that its sign favours, all to the same depth. Every vector met is
scored in full. The components at the present depth bound what any vector not yet met can have;
the search stops when that bound is below the k-th score (an equal score could still win by
its smaller id). The depth doubles each time; once most of a block has been met, the rest is
scored in one product, as reading on would meet it anyway.

Each block's k best per query are merged by a window over the query; Spark limits groups before it
shuffles them. Scores are integers and exact.

Vectors that are null, or hold a null or non-finite component, and rows with a null id take no
part; shorter vectors count as filled up with zeros. Of rows that share an id, the smallest vector
counts. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.batches import lists
from strandloom.plans.session import checkpointed

BLOCK, QUERIES = 8192, 1024


def scaled(vector: str, factor: int) -> Column:
    """floor(factor * x) of every component; null if the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def product(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).sum())
    if most < 2**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    return vectors @ query


class Block:
    """Candidates with a sorted list of rows per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = vectors.astype(np.float64)
        self.most = float(np.abs(vectors).max(initial=0))
        self.lists = np.argsort(vectors.T, axis=1, kind="stable")  # ascending
        self.values = np.take_along_axis(vectors.T, self.lists, axis=1)

    def _scores(self, rows: np.ndarray | None, query: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(query).sum()) < 2**53:
            chosen = self.exact if rows is None else self.exact[rows]
            return (chosen @ query.astype(np.float64)).astype(np.int64)
        return product(self.vectors if rows is None else self.vectors[rows], query)

    def search(self, own: int, query: np.ndarray, k: int, depth: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, best first, and how many candidates were scored."""
        n = len(self.ids)
        use = np.flatnonzero(query)
        down = query[use] > 0
        met = np.zeros(n, bool)
        score = np.full(n, np.iinfo(np.int64).min)
        before, seen = 0, 0
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            if len(use) and seen * 2 < n:
                reads = [self.lists[j, n - depth : n - before] if d else self.lists[j, before:depth] for j, d in zip(use, down, strict=True)]
                fresh[np.concatenate(reads)] = True
                fresh &= ~met
            else:
                fresh, depth = ~met, n
            rows = np.flatnonzero(fresh)
            score[rows] = self._scores(rows if len(rows) < n else None, query)
            met |= fresh
            seen += len(rows)
            chosen = np.flatnonzero(met & (self.ids != own))
            if depth == n or len(chosen) >= k:
                kth = np.partition(score[chosen], len(chosen) - k)[len(chosen) - k] if len(chosen) > k else np.iinfo(np.int64).min
                edge = self.values[use, np.where(down, n - depth, depth - 1)]
                bound = float(edge.astype(np.float64) @ query[use].astype(np.float64)) if len(use) else 0.0
                if depth == n or (len(chosen) > k and bound < float(kth)):
                    chosen = chosen[score[chosen] >= kth]
                    best = chosen[np.lexsort((self.ids[chosen], -score[chosen]))][:k]
                    return self.ids[best], score[best], seen
            before, depth = depth, depth * 2


def _packed(rows: DataFrame, size: int, block: str) -> DataFrame:
    """One row per block: ids and vectors as arrays. Blocks are cut from what each task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []

        def packed() -> pa.RecordBatch:
            width = max(map(len, vectors))
            full = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                full[i, : len(v)] = v
            return pa.RecordBatch.from_pydict(
                {"ids": pa.array([np.array(ids, np.int64).tobytes()]), "vectors": pa.array([full.tobytes()]), "width": pa.array([width], pa.int64())}
            )

        for batch in batches:
            for id_, vector in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                ids.append(id_)
                vectors.append(vector)
                if len(ids) == size:
                    yield packed()
                    ids, vectors = [], []
        if ids:
            yield packed()

    packed = rows.mapInArrow(run, "ids binary, vectors binary, width bigint")
    return checkpointed(packed.withColumn(block, F.monotonically_increasing_id()))


def _unpacked(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch[f"{side}_ids"][i].as_py(), np.int64)
    return ids, np.frombuffer(batch[f"{side}_vectors"][i].as_py(), np.int64).reshape(len(ids), batch[f"{side}_width"][i].as_py())


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["block"][i].as_py() != held:
                    held, block = batch["block"][i].as_py(), Block(*_unpacked(batch, i, "c"))
                width = block.vectors.shape[1]
                ids, queries = _unpacked(batch, i, "q")
                queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
                found = [block.search(int(own), query, k) for own, query in zip(ids, queries, strict=True)]
                sizes = np.array([len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), *(lists(np.concatenate([f[j] for f in found]), sizes, pa.int64()) for j in (0, 1))],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(rows: DataFrame, id_: str, vector: str, is_query: Column, k: int = 20, factor: int = 64) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best other rows for every row of `is_query`."""
    whole = rows.select(F.col(id_).cast("bigint").alias("id"), is_query.alias("query"), scaled(vector, factor).alias("vector"))
    whole = checkpointed(whole.where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"), F.first("query").alias("query")))
    candidates = _packed(whole, BLOCK, "block").select("block", *(F.col(c).alias(f"c_{c}") for c in ("ids", "vectors", "width")))
    queries = _packed(whole.where("query"), QUERIES, "part").select("part", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "width")))
    parts = queries.select("part").agg(F.collect_set("part")).first()[0]  # one number per 1024 queries at most
    work = candidates.withColumn("part", F.explode(F.lit(parts) if parts else F.array().cast("array<bigint>"))).join(queries, "part")
    found = work.repartition("block", "part").sortWithinPartitions("block").mapInArrow(
        _searched(k), "query_id bigint, vec_id array<bigint>, score array<bigint>"
    )
    pairs = found.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("p")).select("query_id", "p.vec_id", "p.score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
