"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small_side
from .frames import stage


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("long").cast("string").cast("binary")), F.lit(parts))


def held_out(key: str, parts: int) -> Column:
    """True for rows nothing is learned from: remainder 1, or no id."""
    return F.coalesce(fold(key, parts) == 1, F.lit(True))


LEVELS, LEVEL_BITS = 2, 10


def bounded_sample(rows: DataFrame, label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(id, label) of at most ``most_rows`` rows a label, and as many as fit in ``most_bytes``.

    ``rows`` has id, label and size, none null. Rows are taken by the hash of their id, so the sample
    follows the ids alone. Counts by the leading bits of the hash, in LEVELS rounds of
    LEVEL_BITS bits, tell in which range of hashes each label's sample ends: rows before that
    range are taken and those after it dropped without meeting in a task, and only rows of
    that one range, 2**-(LEVELS * LEVEL_BITS) of a label's rows, are put in order.
    """
    left = stage(rows.select("id", label, "size", F.xxhash64("id").alias("hash")))
    left = left.withColumns({"rows_before": F.lit(0).cast("long"), "size_before": F.lit(0).cast("long")})
    taken = []
    for level in range(1, LEVELS + 1):
        below = 64 - level * LEVEL_BITS
        part = F.shiftright("hash", below)  # signed, so that parts are in the order of hashes
        left = left.withColumn("part", part if level == 1 else part.bitwiseAND((1 << LEVEL_BITS) - 1))
        ended = ends(left, label, most_rows, most_bytes)
        joined = left.drop("rows_before", "size_before").join(ended, label, "left")
        taken.append(joined.filter(F.col("end").isNull() | (F.col("part") < F.col("end"))).select("id", label))
        left = joined.filter(F.col("part") == F.col("end")).drop("end", "part")
    by = Window.partitionBy(label).orderBy("hash", "id")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        left.withColumn("place", F.row_number().over(by) + F.col("rows_before"))
        .withColumn("so_far", F.sum("size").over(so_far) + F.col("size_before"))
        .filter((F.col("place") <= most_rows) & (F.col("so_far") <= most_bytes)).select("id", label)
    )
    return reduce(DataFrame.unionAll, [*taken, last]).distinct()


def ends(rows: DataFrame, label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """(label, end, rows_before, size_before) of labels whose rows pass a bound: in which part, and what lies before it."""
    parts = rows.groupBy(label, "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"),
        F.min("rows_before").alias("rows_before"), F.min("size_before").alias("size_before"),
    )
    by = Window.partitionBy(label).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = (
        parts.withColumns({"rows_to": F.sum("n").over(by) + F.col("rows_before"), "size_to": F.sum("size").over(by) + F.col("size_before")})
        .filter((F.col("rows_to") > most_rows) | (F.col("size_to") > most_bytes))
        .withColumns({"rows_before": F.col("rows_to") - F.col("n"), "size_before": F.col("size_to") - F.col("size")})
    )
    found = passed.groupBy(label).agg(F.min_by(F.struct("part", "rows_before", "size_before"), "part").alias("at"))
    return small_side(
        found.select(label, F.col("at.part").alias("end"), "at.rows_before", "at.size_before"),
        F.coalesce(F.octet_length(F.col(label).cast("string")), F.lit(0)) + 64,
    )
