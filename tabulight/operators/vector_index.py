"""An inverted-list index over vectors: k-means cells as folders of a Parquet store.

Vectors are compared by cosine. The index keeps each row in the folder of its nearest
centre, with the cell's size and radius (the largest angle to its centre). A search
probes the cells whose centres are nearest to the query. In exact mode the k-th score so
found rules out other cells: no vector of a cell is nearer to the query than the angle to
the centre less the radius, and only cells that could still place are read as well.

How many cells to probe is measured when the index is built: for a few hundred of its own
rows the true neighbours are found by a scan, and as many cells are probed as held the
wanted share of them.

Layout under the index path: ``centres`` (cell, centre), ``sizes`` (cell, n_rows, radius;
rows are added with every append), ``rows/cell=…`` (id, vector), ``settings`` (probe, types).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.staging import small_side, stage
from .search import SCORE_DIGITS, TILE_SCORES, _Best, nearest_batch

# Centres are fitted on a sample of about this many rows; every row is indexed.
SAMPLE_ROWS = 100_000
FIT_ROUNDS = 6
MOST_CELLS = 4096
ROWS_PER_FILE = 1_000_000
# A task holds at most this many queries at a time and reads about this many rows of a cell.
QUERIES_AT_ONCE, ROWS_PER_PART = 8192, 131_072
OUTSIDE = -1  # the cell of vectors that have no direction, or another length
# Probes are set for this share of the true neighbours of this many rows, so that recall stays above 0.9.
RECALL, RECALL_ROWS, RECALL_K = 0.96, 400, 10
SLACK = 1e-6  # angles are kept to about seven digits


@dataclass
class Centres:
    """Unit centres and, by cell, rows and radius; at most MOST_CELLS rows."""

    matrix: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    outside: int = 0
    probe: int = 1


def directions(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms) of a batch as doubles; rows of another length, or with a null or non-finite part, as zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dims)
    values = np.zeros((len(column), dims))
    if len(fits):
        flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        values[fits] = flat.astype(np.float64).reshape(-1, dims)
        values[~np.isfinite(values).all(axis=1)] = 0
    return values, np.linalg.norm(values, axis=1)


def unit(values: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return values / np.where(norms > 0, norms, 1)[:, None]


def cell_sums(sample: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell: the sum of its unit vectors and their number; each task gives one row a cell."""
    schema = T.StructType.fromDDL("cell int, n long, total array<double>")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            values, norms = directions(batch.column(0), centres.shape[1])
            values, near = unit(values, norms)[norms > 0], None
            if len(values):
                near = np.argmax(values @ centres.T, axis=1)
                np.add.at(totals, near, values)
                counts += np.bincount(near, minlength=len(centres))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(counts[seen]), pa.array(list(totals[seen]), target.field("total").type)], schema=target
        )

    made = sample.mapInArrow(run, schema).toArrow()
    totals, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
    for cell, n, total in zip(made["cell"].to_pylist(), made["n"].to_pylist(), made["total"].to_pylist(), strict=True):
        totals[cell] += total
        counts[cell] += n
    return totals, counts


def fit_centres(vectors: DataFrame, id_col: str, vector_col: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit centres by k-means on directions, over a sample of about ``sample_rows`` rows chosen by the hash of their id.

    The length of most vectors sets the dimension. Without ``cells`` there are about as
    many as the square root of the rows. Cells that lose all rows keep their centre.
    """
    usable = vectors.filter(F.size(vector_col) > 0)
    facts = usable.groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if facts is None:
        return np.zeros((0, 0))
    dims, count = facts
    cells = min(MOST_CELLS, cells or max(1, round(math.sqrt(count))))
    part = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample_rows / count))
    sample = stage(usable.filter(part & (F.size(vector_col) == dims)).select(F.col(vector_col).alias("vector")))
    first = sample.distinct().orderBy(F.xxhash64("vector")).limit(cells).toArrow()["vector"].combine_chunks()
    values, norms = directions(first, dims)
    centres = unit(values, norms)[norms > 0]
    for _ in range(FIT_ROUNDS):
        if not len(centres):
            break
        totals, counts = cell_sums(sample, centres)
        lengths = np.linalg.norm(totals, axis=1)
        moved = (counts > 0) & (lengths > 0)
        centres[moved] = totals[moved] / lengths[moved][:, None]
    return centres


def placed(vectors: DataFrame, id_col: str, vector_col: str, centres: np.ndarray) -> DataFrame:
    """(id, vector, cell, angle) of every row; cell OUTSIDE and no angle where there is no direction."""
    schema = T.StructType(
        [
            T.StructField("id", vectors.schema[id_col].dataType), T.StructField("vector", vectors.schema[vector_col].dataType),
            T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()),
        ]
    )
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, OUTSIDE, np.int32), np.zeros(batch.num_rows)
            if len(centres):
                values, norms = directions(batch.column(1), centres.shape[1])
                step = max(1, TILE_SCORES // len(centres))
                for at in range(0, len(values), step):
                    some = slice(at, at + step)
                    scores = unit(values[some], norms[some]) @ centres.T
                    cell[some] = np.where(norms[some] > 0, np.argmax(scores, axis=1), OUTSIDE)
                    angle[some] = np.arccos(np.clip(scores.max(axis=1), -1, 1))
            columns = [batch.column(0).cast(target.field(0).type), batch.column(1).cast(target.field(1).type)]
            none = pa.array(cell == OUTSIDE)
            angles = pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(angle))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell), angles], schema=target)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, schema)


def add_rows(vectors: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "vector", centres: np.ndarray | None = None) -> DataFrame:
    """Place rows into the cells of the index at ``path`` and append them.

    A cell's rows are written by several tasks where they are many. Sizes go in last; a
    job lost before that has written nothing a search reads, as both are read together.
    Gives the rows with their cells.
    """
    centres = read_centres(vectors.sparkSession, path).matrix if centres is None else centres
    rows = stage(placed(vectors, id_col, vector_col, centres))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max("angle"), F.lit(0.0)).alias("radius"))
    (
        rows.drop("angle").hint("rebalance", "cell").write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("cell").parquet(f"{path}/rows")
    )
    sizes.coalesce(1).write.mode("append").parquet(f"{path}/sizes")
    return rows


def measured_probe(rows: DataFrame, centres: np.ndarray) -> int:
    """Cells to probe for RECALL of the true neighbours of a few rows, found by a scan.

    RECALL_ROWS queries and their RECALL_K neighbours are all that reaches the driver.
    """
    some = rows.filter(F.col("cell") != OUTSIDE).orderBy(F.xxhash64("id"), "id").limit(RECALL_ROWS)
    asked = stage(some.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).dropDuplicates(["query_id"]))
    near = nearest_batch(rows, asked, RECALL_K + 1, "id", "vector").filter(F.col("query_id") != F.col("id"))
    cells = rows.select(F.col("id").alias("hit"), "cell").join(small_side(near.select("query_id", "id"), F.lit(128)), F.col("hit") == F.col("id"))
    held = cells.filter(F.col("cell") != OUTSIDE).groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(asked, "query_id").toArrow()
    if not held.num_rows:
        return 1
    values, norms = directions(held["query_vector"].combine_chunks(), centres.shape[1])
    order = np.argsort(-(unit(values, norms) @ centres.T), axis=1, kind="stable")
    places = np.argsort(order, axis=1)
    at = np.sort(np.concatenate([places[i, own] for i, own in enumerate(held["cells"].to_pylist())]))
    return int(at[math.ceil(RECALL * len(at)) - 1]) + 1


def build_index(vectors: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "vector", cells: int | None = None) -> None:
    """Fit centres and write all rows; ``path`` must not hold an index yet."""
    centres = fit_centres(vectors, id_col, vector_col, cells)
    spark = vectors.sparkSession
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.coalesce(1).write.parquet(f"{path}/centres")
    rows = add_rows(vectors, path, id_col, vector_col, centres)
    probe = measured_probe(rows, centres) if len(centres) else 1
    kinds = [F.lit(rows.schema[n].dataType.simpleString()).alias(f"{n}_type") for n in ("id", "vector")]
    spark.range(0, 1, 1, 1).select(F.lit(probe).alias("probe"), *kinds).write.parquet(f"{path}/settings")


def read_centres(spark: SparkSession, path: str) -> Centres:
    known = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    matrix = np.array([r["centre"] for r in known]) if known else np.zeros((0, 0))
    out = Centres(matrix, np.zeros(len(known), np.int64), np.zeros(len(known)))
    sizes = spark.read.schema("cell int, n_rows long, radius double").parquet(f"{path}/sizes")
    for r in sizes.groupBy("cell").agg(F.sum("n_rows").alias("n"), F.max("radius").alias("r")).collect():
        if r["cell"] == OUTSIDE:
            out.outside = r["n"]
        else:
            out.rows[r["cell"]], out.radius[r["cell"]] = r["n"], r["r"]
    out.probe = spark.read.schema("probe int").parquet(f"{path}/settings").first()["probe"]
    return out


def probes(queries: DataFrame, centres: Centres, first: int, last: int | None, known: bool) -> DataFrame:
    """(query_id, query_vector, cell): cells to search, by nearness of their centre.

    Cells at places ``first`` to ``last`` of a query; if ``known``, the query has the
    k-th score found so far in ``least`` (null: fewer found), and only cells come that
    could hold a row of that score or more, and OUTSIDE where a score of 0 could place.
    """
    fields = [queries.schema["query_id"], queries.schema["query_vector"], T.StructField("cell", T.IntegerType())]
    schema = T.StructType(fields)
    target = to_arrow_schema(schema)
    filled = np.flatnonzero(centres.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = centres.matrix.shape[1]
            values, norms = directions(batch.column(1), dims)
            step = max(1, TILE_SCORES // max(1, len(filled)))
            for at in range(0, len(values), step):
                some = slice(at, at + step)
                angles = np.arccos(np.clip(unit(values[some], norms[some]) @ centres.matrix[filled].T, -1, 1))
                order = np.argsort(angles, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(filled))[None, :], axis=1)
                take = (place >= first) & (norms[some] > 0)[:, None]
                if last is not None:
                    take &= place < last
                else:
                    least = np.nan_to_num(batch.column(2).slice(at, step).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    best = np.cos(np.maximum(0, angles - centres.radius[filled] - SLACK)) + SLACK
                    take &= best >= least[:, None]
                query, cell = np.nonzero(take)
                cells = filled[cell]
                if last is None and centres.outside:
                    # a row without direction scores 0, and so does every row for a query without one
                    open_ = np.flatnonzero(least <= 0)
                    query, cells = np.concatenate((query, open_)), np.concatenate((cells, np.full(len(open_), OUTSIDE)))
                if last is None and (norms[some] == 0).any():
                    flat = np.flatnonzero(norms[some] == 0)
                    query = np.concatenate((query, np.repeat(flat, len(filled))))
                    cells = np.concatenate((cells, np.tile(filled, len(flat))))
                rows = pa.array(query + at)
                ids, asked = batch.column(0).take(rows), batch.column(1).take(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(target.field(0).type), asked.cast(target.field(1).type), pa.array(cells, pa.int32())], schema=target
                )

    columns = ["query_id", "query_vector"] + (["least"] if known else [])
    return queries.select(*columns).mapInArrow(run, schema)


def by_cell(numbers: dict[int, int]):
    """A constant array with a number a cell, at the cell's place; OUTSIDE comes first."""
    size = max(numbers, default=OUTSIDE) + 2
    values = [max(1, numbers.get(cell + OUTSIDE, 1)) for cell in range(size)]
    return lambda cell: F.coalesce(F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), cell - OUTSIDE), F.lit(1))


def search_cells(rows: DataFrame, asked: DataFrame, centres: Centres, k: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each query in each part of its cells.

    Queries and rows of a cell meet by a shuffle on (cell, block of queries, part of the
    rows). Queries come first and are held, rows stream by; large cells and cells asked
    by many queries have several blocks and parts.
    """
    asked = stage(asked)
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {OUTSIDE: centres.outside} | {i: int(n) for i, n in enumerate(centres.rows)}
    blocks = by_cell({c: -(-n // QUERIES_AT_ONCE) for c, n in wanted.items()})
    parts = by_cell({c: -(-sizes.get(c, 1) // ROWS_PER_PART) for c in wanted})
    none = F.lit(None)
    id_type, key_type = asked.schema["query_id"].dataType, rows.schema["id"].dataType
    cell = F.col("cell")
    held = asked.select(
        "cell", F.pmod(F.xxhash64("query_id"), blocks(cell)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), parts(cell) - 1)).alias("part"), F.lit(0).alias("side"),
        "query_id", none.cast(key_type).alias("id"), F.col("query_vector").cast("array<double>").alias("vector"),
    )
    # Folders of cells that no query asks for are not read.
    passing = rows.filter(cell.isin(*wanted) if wanted else F.lit(False)).select(
        "cell", F.explode(F.sequence(F.lit(0), blocks(cell) - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(1)), parts(cell)).cast("int").alias("part"), F.lit(1).alias("side"),
        none.cast(id_type).alias("query_id"), "id", F.col("vector").cast("array<double>").alias("vector"),
    )
    keys = ["cell", "block", "part"]
    dealt = held.unionByName(passing).repartition(*keys).sortWithinPartitions(*keys, "side")
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("id", key_type), T.StructField("score", T.DoubleType())]
    )
    target = to_arrow_schema(schema)
    # a query of another length still scores 0 against every row, as in an exact scan
    width = centres.matrix.shape[1] if len(centres.matrix) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, vectors, best, matrix, lengths = None, [], [], None, None, None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None and best.key is not None and len(best.key):
                best.trim()
                owners = pa.concat_arrays([pa.array(i, target.field(0).type) for i in ids]).take(pa.array(best.query))
                yield pa.RecordBatch.from_arrays(
                    [owners, pa.array(best.key, target.field(1).type), pa.array(best.score, pa.float64())], schema=target
                )

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)] if len(at) else [0]
            for start, end in zip(edges[:-1], edges[1:]):
                own = tuple(at[start, :3].tolist())
                if own != name:
                    yield from found()
                    name, ids, vectors, best = own, [], [], None
                values, norms = directions(batch.column(6).slice(start, end - start), width)
                if at[start, 3] == 0:
                    ids.append(batch.column(4).slice(start, end - start).to_pylist())
                    vectors.append(values)
                    continue
                if not ids:
                    continue
                if best is None:
                    matrix = np.concatenate(vectors)
                    lengths, best = np.linalg.norm(matrix, axis=1), _Best(len(matrix), k)
                labels = batch.column(5).slice(start, end - start).to_numpy(zero_copy_only=False)
                labels = labels.astype(str) if labels.dtype == object else labels
                step = max(1, TILE_SCORES // len(labels))
                for first in range(0, len(matrix), step):
                    some = slice(first, first + step)
                    scale = np.outer(lengths[some], norms)
                    scores = np.divide(matrix[some] @ values.T, scale, out=np.zeros_like(scale), where=scale > 0)
                    best.add(labels, np.round(scores, SCORE_DIGITS), first)
                best.trim()
        yield from found()

    return dealt.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probe: int | None = None, exact: bool = False,
    query_id: str = "query_id", query_vector: str = "query_vector",
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows most like each query, ties to the smaller id.

    ``probe`` cells are searched (if not given, as many as the index was measured to need). With ``exact``, cells
    that the scores so found do not rule out are searched too, and the result is that of
    a scan of all rows. Query ids must be unique. A query or row that is null, of another
    length, zero or not finite scores 0; such rows and queries come up in exact mode only.
    """
    centres = read_centres(spark, path)
    rows = stored_rows(spark, path)
    asked = stage(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector")))
    probe = probe or centres.probe
    near = ranked(search_cells(rows, probes(asked, centres, 0, probe, False), centres, k), k)
    if not exact:
        return near
    near = stage(near)
    least = near.filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
    open_ = asked.join(least, F.col("query_id") == F.col("q"), "left").drop("q")
    more = search_cells(rows, probes(open_, centres, probe, None, True), centres, k)
    return ranked(near.drop("rank").unionByName(more), k)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, cell) of all rows, with the types they came with."""
    kinds = spark.read.schema("id_type string, vector_type string").parquet(f"{path}/settings").first()
    return spark.read.schema(f"id {kinds['id_type']}, vector {kinds['vector_type']}, cell int").parquet(f"{path}/rows")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: how many of the exact result's rows were found, of how many."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("n_found"), F.count(F.lit(1)).alias("n_exact"))
