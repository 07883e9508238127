"""Shared helpers: staged tables, Arrow batches, bounded id filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row_batches = Iterator[pa.RecordBatch]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one where that is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and root.startswith("/"):
        local = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
        root = f"file://{root}" if local else root
    return f"{root}/llm-{uuid.uuid4().hex}"


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 15 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs inside move Arrow batches of about ``size`` bytes, whatever their rows hold.

    A batch of 10,000 rows of packed windows or texts is several times a slice, and both the
    executor and its Python worker hold it.
    """
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside drop their shuffle files when they end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: one computation, short lineage, pruned reads."""
    return stage_at(df)[0]


def stage_at(df: DataFrame, batch_bytes: int = BATCH_BYTES, **options) -> tuple[DataFrame, str]:
    """As ``stage``, with the folder, for ``release``; ``options`` are those of the Parquet writer."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with small_batches(spark, batch_bytes), own_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(df: DataFrame, path: str) -> None:
    """Empty the folder of a staged table that no frame reads any more."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the id (as long, named ``id``) and the text's UTF-8 bytes (named ``body``)."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))


SLICE_BYTES = 4 << 20


def slices(batches: Row_batches, size: int | None = SLICE_BYTES) -> Row_batches:
    """Batches in slices of about ``size`` bytes, so that what is made of one stays small."""
    for batch in batches:
        rows = batch.num_rows
        step = rows if size is None else max(1, rows * size // max(1, batch.nbytes))
        for start in range(0, rows, step or 1):
            yield batch.slice(start, step)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[dict], dict | None]], schema: str, size: int | None = SLICE_BYTES
) -> DataFrame:
    """Run a batch function over slices of Arrow batches.

    ``make`` is called once a task and returns the batch function; that gets Python
    lists by column and returns lists or arrays by output column (None: no rows).
    """
    parsed = StructType.fromDDL(schema)
    target = to_arrow_schema(parsed)

    def run(batches: Row_batches) -> Row_batches:
        work = make()
        for batch in slices(batches, size):
            out = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield to_batch(out, target)

    return df.mapInArrow(run, parsed)


def arrow_filter(df: DataFrame, text: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which a function of their texts' bytes says true.

    A text travels once: its bytes are read where the column lies.
    """
    names = df.columns
    place = names.index(text) if text in names else [n.lower() for n in names].index(text.lower())

    def run(batches: Row_batches) -> Row_batches:
        keep = make()
        for batch in slices(batches):
            mask = keep(batch.column(place).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(np.asarray(mask, bool)))

    return df.mapInArrow(run, df.schema)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        value = columns[field.name]
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame, slot: Column) -> np.ndarray:
    """A bitmap of FILTER_BITS bits (8 MB at any input size) with the bit at each row's ``slot`` set.

    It only thins rows before an exact join, so collisions cost work, never results.
    """
    words = (
        ids.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    found = words.toArrow()
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bitmap


def in_filter(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which filter positions are set."""
    slots = slots.astype(np.uint64)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def filter_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
