"""Exact top-k inner-product search with KD-trees, one a shard of the vectors.

A tree splits at the median of the widest dimension and keeps the tight bounding box of
each node; no vector in a box can score more than the sum over dimensions of the larger
of query times low and query times high. A query visits nodes best bound first and ends
when the bound is below the k-th score found so far. That score is carried from shard
to shard within a task and starts from a first look at a few vectors of the table.

Queries travel in blocks of a fixed number of rows; each block is one pass over the
vectors, and only the k best of a shard and query leave their task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import stage, to_batch

SCALE = 64
BLOCK_QUERIES = 4096
SHARD_ROWS = 32_768
LEAF_ROWS = 512
FIRST_LOOK = 2000
EXACT = 2.0**53


class Tree:
    """A KD-tree in arrays: boxes by node, children 2i+1 and 2i+2, leaves as row ranges of the sorted vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF_ROWS))))
        order = np.arange(len(ids))
        ranges = [(0, len(ids))]
        for _ in range(depth):
            halves = []
            for start, end in ranges:
                part = vectors[order[start:end]]
                middle = (end - start) // 2
                wide = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
                order[start:end] = order[start:end][np.argpartition(part[:, wide], middle)] if len(part) > 1 else order[start:end]
                halves += [(start, start + middle), (start + middle, end)]
            ranges = halves
        self.ids, self.vectors, self.ranges, self.first_leaf = ids[order], vectors[order], ranges, 2**depth - 1
        low = [self.vectors[a:b].min(axis=0) for a, b in ranges]
        high = [self.vectors[a:b].max(axis=0) for a, b in ranges]
        levels = [(np.array(low), np.array(high))]
        while len(levels[0][0]) > 1:
            low, high = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.low = np.concatenate([level[0] for level in levels])
        self.high = np.concatenate([level[1] for level in levels])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score each query can find in each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: "Best") -> None:
        """Best-first descent; a node that could only tie is visited, as ties go to smaller ids."""
        waiting = [(-bounds[0], 0)]
        while waiting and -waiting[0][0] >= best.least:
            _, node = heapq.heappop(waiting)
            if node >= self.first_leaf:
                start, end = self.ranges[node - self.first_leaf]
                best.add(self.vectors[start:end] @ query, self.ids[start:end], own)
                continue
            for child in (2 * node + 1, 2 * node + 2):
                if bounds[child] >= best.least:
                    heapq.heappush(waiting, (-bounds[child], child))


class Best:
    """The k best (score, id) of a query so far; ``least`` is what a new one must reach."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        keep = (scores >= self.least) & (ids != own)
        if not keep.any():
            return
        scores, ids = np.concatenate((self.scores, scores[keep])), np.concatenate((self.ids, ids[keep]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec): components floor(64 x); without null ids and null, empty or non-finite vectors."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("vec"))
    )


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def search_block(vectors: DataFrame, shared, k: int, size: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task for a block of queries of ``size`` components."""
    parsed = StructType.fromDDL("query_id long, vec_id long, score long")
    target = to_arrow_schema(parsed)

    def run(batches):
        query_ids, queries, least = shared.value
        found = [Best(k, value) for value in least]

        def shard(ids, parts):
            data = np.concatenate(parts)
            if np.abs(data).max() * np.abs(queries).max() * size >= EXACT:
                data, asked = data.astype(np.int64), queries.astype(np.int64)
            else:
                asked = queries
            tree = Tree(np.concatenate(ids), data)
            for start in range(0, len(asked), 256):
                bounds = tree.bounds(asked[start : start + 256])
                for row in range(len(bounds)):
                    at = start + row
                    tree.search(asked[at], query_ids[at], bounds[row], found[at])

        ids, parts, rows = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                parts.append(matrix(batch.column(1), size))
                rows += batch.num_rows
            if rows >= SHARD_ROWS:
                shard(ids, parts)
                ids, parts, rows = [], [], 0
        if rows:
            shard(ids, parts)
        for start in range(0, len(found), 500):
            part = found[start : start + 500]
            yield to_batch(
                {
                    "query_id": np.repeat(query_ids[start : start + 500], [len(b.ids) for b in part]),
                    "vec_id": np.concatenate([b.ids for b in part]),
                    "score": np.concatenate([b.scores for b in part]).astype(np.int64),
                },
                target,
            )

    return vectors.filter(F.size("vec") == size).mapInArrow(run, parsed)


def first_look(sample: np.ndarray, sample_ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among a few vectors: a lower bound of its k-th score among all."""
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    scores = queries @ sample.T
    scores[query_ids[:, None] == sample_ids[None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k]


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with rows of ``df``.

    A row with the query's own id is no candidate; ties go to the smaller id. Repeated
    rows are candidates each; of queries with the same id the smallest vector counts.
    Null ids and vectors that are null, empty or hold null or non-finite components take
    no part, and vectors of different lengths never meet. Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, key, vector)
    asked = stage(whole_vectors(queries, key, vector).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    sizes = [(r["size"], r["count"]) for r in asked.groupBy(F.size("vec").alias("size")).count().orderBy("size").collect()]
    made = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for size, count in sizes:
        look = vectors.filter(F.size("vec") == size).limit(FIRST_LOOK).toArrow()
        blocks = -(-count // BLOCK_QUERIES)
        for block in range(blocks):
            part = asked.filter((F.size("vec") == size) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).toArrow()
            if not part.num_rows:
                continue
            ids, rows = part["vec_id"].to_numpy(), matrix(part["vec"].combine_chunks(), size)
            sample = matrix(look["vec"].combine_chunks(), size)
            sample_ids = look["vec_id"].to_numpy()
            _, once = np.unique(sample_ids, return_index=True)
            least = first_look(sample[once], sample_ids[once], ids, rows, k)
            shared = spark.sparkContext.broadcast((ids, rows, least))
            made = made.unionByName(search_block(vectors, shared, k, size))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return made.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
