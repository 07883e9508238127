"""Cosine top-k over stored vectors: one query, or a batch of them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import hard_cut
from ..functions.vectors import cosine
from ..sources.staging import small_side

# Query vectors shipped to the tasks at a time; larger batches go in more passes.
BLOCK_BYTES = 64 * 1024 * 1024
# Similarities are compared at this many digits, so equal vectors tie and the
# smaller id wins wherever they are stored.
SCORE_DIGITS = 9
# Partial results a task keeps before it passes them on.
KEPT_GROUPS = 10_000
# Scores a task holds at a time.
TILE_SCORES = 4_000_000
# A block that keeps its size through this many halvings holds one repeated id.
MOST_SPLITS = 40


def nearest(
    chunks: DataFrame, query: Sequence[float], k: int = 5, id_col: str = "chunk_id", vector_col: str = "vector"
) -> DataFrame:
    """The ``k`` rows most like one query vector: an expression and a heap per task."""
    literal = F.from_json(F.lit(json.dumps([float(x) for x in query])), "array<double>")
    score = F.round(cosine(F.col(vector_col), literal), SCORE_DIGITS)
    return chunks.withColumn("score", score).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def _in_phases(chunks: DataFrame, phases: Sequence[str] | None, phase_col: str) -> DataFrame:
    if phases is None:
        return chunks
    return chunks.filter(F.col(phase_col).isin(*phases))


def search_text(
    chunks: DataFrame,
    text: str,
    embedder,
    k: int = 5,
    phases: Sequence[str] | None = None,
    phase_col: str = "phase",
) -> DataFrame:
    """Embed a question and search all phases, or those given (partition-pruned).

    The question's vector is one constant row; it is folded into the scoring
    expression, so scoring stays in the JVM.
    """
    vector = chunks.sparkSession.range(0, 1, 1, 1).select(embedder(F.lit(text)).alias("v")).first()["v"]
    return nearest(_in_phases(chunks, phases, phase_col), vector, k)


def _query_blocks(queries: DataFrame, id_col: str, vector_col: str, block_bytes: int):
    """The queries as frames that each fit a block: (frame, most rows) pairs."""
    size = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_col)), F.lit(0)).alias("d")
    ).first()
    fit = max(1, block_bytes // (8 * max(1, size["d"])))
    if size["n"] <= fit:
        return [(queries, fit)]
    # Hashing spreads the ids unevenly; blocks aim at half their limit and one
    # that still came out too large is split again where it is read.
    count = math.ceil(2 * size["n"] / fit)
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(count))
    return [(queries.filter(block == i), fit) for i in range(count)]


class _Best:
    """The best k rows per query of what a task has seen, as flat arrays."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.key = None

    def add(self, keys: np.ndarray, scores: np.ndarray, first: int) -> None:
        """Rows that can still place, from a (queries x rows) tile that starts at ``first``."""
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] > self.k:
            cut = scores.shape[1] - self.k
            floor = np.maximum(floor, np.partition(scores, cut, axis=1)[:, cut])
        query, row = np.nonzero(scores >= floor[:, None])
        self.query = np.concatenate([self.query, query + first])
        self.score = np.concatenate([self.score, scores[query, row]])
        self.key = keys[row] if self.key is None else np.concatenate([self.key, keys[row]])

    def trim(self) -> None:
        """Keep k per query, by score and then by id, and raise the floors."""
        order = np.lexsort((self.key, -self.score, self.query))
        query, score = self.query[order], self.score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        kept = order[rank < self.k]
        self.query, self.score, self.key = self.query[kept], self.score[kept], self.key[kept]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[query[last]] = score[last]


def _score_batches(ids, matrix: np.ndarray, lengths: np.ndarray, k: int, groups: bool, schema: pa.Schema):
    """A task function: score each Arrow batch against the block, keep the best k."""
    dim = matrix.shape[1]

    def vectors_of(column: pa.Array) -> np.ndarray:
        """Rows of the block's dimension; others, which are not comparable, as zeros."""
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(sizes == dim)
        values = np.zeros((len(column), dim))
        if len(fits):
            flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            values[fits] = np.nan_to_num(flat.astype(np.float64)).reshape(-1, dim)
        return values

    def plain(column: pa.Array) -> np.ndarray:
        values = column.to_numpy(zero_copy_only=False)
        return values.astype(str) if values.dtype == object else values

    def rows_of(label, best: _Best) -> Iterator[pa.RecordBatch]:
        if best.key is not None and len(best.key):
            out = [pa.array(ids, schema.field(0).type).take(pa.array(best.query))]
            out += [pa.array(best.key, schema.field(1).type), pa.array(best.score, pa.float64())]
            if groups:
                out.append(pa.array([label] * len(best.key), schema.field(3).type))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = plain(batch.column(0)), vectors_of(batch.column(1))
            norms = np.linalg.norm(values, axis=1)
            labels = plain(batch.column(2)) if groups else np.zeros(len(keys), dtype=np.int64)
            for label in np.unique(labels):
                rows = np.flatnonzero(labels == label)
                best = kept.setdefault(label.item(), _Best(len(ids), k))
                step = max(1, TILE_SCORES // len(rows))
                for first in range(0, len(ids), step):
                    part = slice(first, first + step)
                    scale = np.outer(lengths[part], norms[rows])
                    scores = matrix[part] @ values[rows].T
                    scores = np.divide(scores, scale, out=np.zeros_like(scale), where=scale > 0)
                    best.add(keys[rows], np.round(scores, SCORE_DIGITS), first)
                best.trim()
            if groups and len(kept) * len(ids) > KEPT_GROUPS:
                for label, best in kept.items():
                    yield from rows_of(label, best)
                kept = {}
        for label, best in kept.items():
            yield from rows_of(label, best)

    return run


def nearest_batch(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "chunk_id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    group_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best rows for every query, or for every query and group; exact.

    A block of query vectors of bounded size goes to the tasks, each task scores its
    own vectors with one matrix product per Arrow batch and keeps k rows per query,
    and only those are shuffled. Vectors are never moved or paired up in a join.
    """
    groups = group_col is not None
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")]
    if groups:
        columns.append(F.col(group_col).alias("group"))
    scan = chunks.select(*columns)
    fields = [
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField("id", chunks.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    if groups:
        fields.append(T.StructField("group", chunks.schema[group_col].dataType))
    schema = T.StructType(fields)
    arrow_schema = to_arrow_schema(schema)
    parts: list[DataFrame] = []
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))
    waiting = [(frame, fit, 0) for frame, fit in _query_blocks(wanted, "query_id", "query_vector", block_bytes)]
    while waiting:
        frame, fit, splits = waiting.pop()
        rows = frame.limit(fit + 1).collect()
        if len(rows) > fit:
            if splits > MOST_SPLITS:
                raise ValueError("query ids must be unique")
            half = F.pmod(F.hash(F.col("query_id"), F.lit(splits)), F.lit(2))
            waiting += [(frame.filter(half == i), fit, splits + 1) for i in (0, 1)]
            continue
        by_size: dict[int, list] = {}
        for row in rows:
            if row["query_vector"] is not None:
                by_size.setdefault(len(row["query_vector"]), []).append(row)
        for same in by_size.values():
            ids = [row["query_id"] for row in same]
            matrix = np.array([row["query_vector"] for row in same], dtype=np.float64)
            run = _score_batches(ids, matrix, np.linalg.norm(matrix, axis=1), k, groups, arrow_schema)
            parts.append(scan.mapInArrow(run, schema))
    if not parts:
        return chunks.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    keys = ["query_id", "group"] if groups else ["query_id"]
    ranked = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def group_centroids(df: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """Mean vector of each group; sums are made per task before the shuffle."""
    means = (
        df.select(F.col(group_col).alias("group"), F.posexplode(vector_col).alias("pos", "x"))
        .groupBy("group", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("group").agg(F.transform(ordered, lambda p: p["mean"]).alias("centroid"))


# How the best chunk of a phase is announced.
PHASE_TITLES = {
    "phase1": "Phase 1 - Schema Analysis: ",
    "phase2": "Phase 2 - Business Logic: ",
    "phase3": "Phase 3 - Business Description: ",
}


def relevant_knowledge(chunks: DataFrame, queries: DataFrame, limit: int = 500) -> DataFrame:
    """For each query, the best chunk of each of three phases, cut and titled, as one text.

    ``chunks`` are store rows, ``queries`` have ``query_id`` and ``query_vector``. A
    query keeps at most one chunk per phase, so its text is made of three rows.
    """
    searched = chunks.filter(F.col("phase").isin(*PHASE_TITLES))
    hits = nearest_batch(searched, queries, 1, group_col="phase").withColumnRenamed("id", "chunk_id")
    title = F.create_map(*[F.lit(x) for pair in PHASE_TITLES.items() for x in pair])
    # An id, a phase and two numbers a row; contents stay where they are while that is small.
    found = small_side(hits.select("query_id", "chunk_id", "group"), F.lit(128))
    texts = searched.select("chunk_id", "content").join(found, "chunk_id").select(
        "query_id",
        F.struct(
            F.col("group").alias("phase"),
            F.concat(title[F.col("group")], hard_cut(F.col("content"), limit)).alias("text"),
        ).alias("part"),
    )
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"])
    return texts.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("knowledge"))
