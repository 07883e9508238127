"""Running totals and neighbours that survive a key with a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    total: str = "running_total",
    previous: str = "previous_total",
    slices: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` within ``keys`` by ``order``, and the sum before the row.

    ``order`` must be unique within a key. Rows are range-partitioned on keys and order,
    which cuts a large key into even slices; each slice is summed on its own, and the
    sums of earlier slices are added. Only a key that crosses a slice border needs an
    addition, so there is at most one such row per slice. Sums of doubles depend on the
    order of addition; cast to a decimal where they must be exact.
    """
    return _sliced_total(df, keys, order, value, total, previous, slices)


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None) -> DataFrame:
    """Rows range-partitioned on keys and order, with their slice number, written once.

    They are read more than once below, so slice numbers must not change between reads.
    """
    ranged = df.repartitionByRange(*([slices] if slices else []), *keys, *order)
    return stage(ranged.withColumn("_slice", F.spark_partition_id()))


def _spanning(per_slice: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (key, slice) rows of keys in more than one slice.

    Such keys share slice borders, so there are at most twice as many rows as slices.
    """
    spans = per_slice.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    return per_slice.join(spans, list(keys), "left_semi")


def _sliced_total(df, keys, order, value, total, previous, slices) -> DataFrame:
    sliced = _slices(df, keys, order, slices)
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn("_local", F.sum(value).over(local))
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        _spanning(sums, keys)
        .withColumn("_carry", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .select(*keys, "_slice", "_carry")
    )
    return (
        summed.join(F.broadcast(carry), [*keys, "_slice"], "left")
        .withColumn(total, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .withColumn(previous, F.col(total) - F.col(value))
        .select(*df.columns, total, previous)
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "previous",
    slices: int | None = None,
) -> DataFrame:
    """``value`` of the row ahead within ``keys`` by ``order``, in slices as above.

    The first row of a key takes the last value of the slice before.
    """
    sliced = _slices(df, keys, order, slices)
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    seen = sliced.withColumn("_row", F.row_number().over(local)).withColumn("_local", F.lag(value).over(local))
    # A wrapped value keeps a null last value apart from no value at all.
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    ends = sliced.groupBy(*keys, "_slice").agg(last)
    carry = (
        _spanning(ends, keys)
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")))
        .select(*keys, "_slice", "_carry")
    )
    first = F.col("_row") == 1
    return seen.join(F.broadcast(carry), [*keys, "_slice"], "left").select(
        *df.columns, F.when(first, F.col("_carry.v")).otherwise(F.col("_local")).alias(name)
    )


def continuity(
    df: DataFrame, keys: Sequence[str], before: str, change: str, after: str
) -> DataFrame:
    """Rows whose stored ``before`` plus ``change`` is not their stored ``after``."""
    return df.filter(~(F.col(before) + F.col(change)).eqNullSafe(F.col(after))).select(
        *keys, before, change, after
    )


def chain_breaks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: str, after: str, **sizes
) -> DataFrame:
    """Rows whose ``before`` is not the ``after`` of the row ahead of them in their key."""
    chained = previous_value(df, keys, order, after, "expected", **sizes)
    return chained.filter(F.col("expected").isNotNull() & (F.col("expected") != F.col(before)))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top rows of each key with ``row_number``; cut to n per key before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_number", F.row_number().over(ranked)).filter(F.col("row_number") <= n)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``: a minimum, so no key is sorted or gathered."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)
