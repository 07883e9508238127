"""Materialise a frame in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's, else a temporary one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabulight-checkpoint-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where a frame is read twice and must be the same both times, or where
    an iterative plan would grow; the copy survives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A join side up to this measured size is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` staged and, if the sum of ``row_bytes`` is within the bound, marked for a broadcast."""
    staged = stage(df)
    size = staged.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(staged) if size <= BROADCAST_BYTES else staged


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that costs much per row on a table with fewer splits than cores.

    A Parquet file with one row group is one task, however much work a row makes. Only the
    number of splits of the plan counts: a table with enough of them is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
