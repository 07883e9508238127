"""Keep a knowledge store up to date with files that arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import chunk_documents
from ..sources.knowledge import append_chunks, build_store_rows, update_index


def index_arrivals(
    spark: SparkSession,
    arrivals: DataFrame,
    text: str,
    source: Column,
    phase: Column,
    store: str,
    checkpoint: str,
    embedder="tfidf",
    size: int = 1000,
    overlap: int = 200,
) -> StreamingQuery:
    """Chunk each batch of a streaming frame and append what the store lacks.

    A batch that is run again after a failure finds its chunks stored and adds none.
    """

    def add(batch: DataFrame, _: int) -> None:
        update_index(spark, chunk_documents(batch, text, source, phase, size, overlap), store, embedder)

    return (
        arrivals.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def empty_store(spark: SparkSession, path: str, embedder="tfidf") -> None:
    """An empty store to start from."""
    schema = "phase string, source string, chunk_no int, content string, kind string, table_name string"
    append_chunks(build_store_rows(spark.createDataFrame([], schema), embedder), path)
