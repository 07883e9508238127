"""Value lists of columns: histograms, options with examples, collection items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import collection_items
from ..sources.staging import stage


def unpivot_values(df: DataFrame, columns: Sequence[str], position: Column | None = None) -> DataFrame:
    """(column_name, value[, position]) rows of the non-empty values, one scan."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    keep = [F.explode(pairs).alias("pair")]
    out = ["pair.column_name", "pair.value"]
    if position is not None:
        keep.insert(0, position.alias("position"))
        out.append("position")
    return df.select(*keep).select(*out).filter("value IS NOT NULL AND value <> ''")


def enum_values(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Value counts of each column; hot values collapse before the shuffle."""
    return (
        unpivot_values(df, columns)
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("value_count"))
        .select(F.lit(table).alias("table_name"), "column_name", "value", "value_count")
    )


def value_options(
    df: DataFrame, table: str, columns: Sequence[str], position: Column, examples: int = 10
) -> DataFrame:
    """Value counts, the first ``examples`` values by position, distinct total per column.

    The first examples come from a window rank that Spark cuts to the top rows in
    each task before the shuffle, so no column's values meet in one task. The counts
    are read three times and so are written once, in place of three table scans.
    """
    counted = stage(
        unpivot_values(df, columns, position)
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("value_count"), F.min("position").alias("first_position"))
    )
    totals = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("total_unique"))
    first = Window.partitionBy("column_name").orderBy("first_position", "value")
    leading = (
        counted.withColumn("example_rank", F.row_number().over(first))
        .filter(F.col("example_rank") <= examples)
        .select("column_name", "value", "example_rank")
    )
    return (
        counted.join(leading, ["column_name", "value"], "left")
        .join(totals, "column_name")
        .select(
            F.lit(table).alias("table_name"), "column_name", "value", "value_count",
            "example_rank", "total_unique",
        )
    )


def items_of(df: DataFrame, column: str) -> Column:
    """Items of a collection column: an array's own, or those a text is split into; none blank."""
    c = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return collection_items(c)
    return F.filter(F.transform(c, lambda item: item.cast("string")), lambda item: item != "")


def collection_item_counts(df: DataFrame, table: str, column: str) -> DataFrame:
    """How often each item of a collection column occurs."""
    return (
        df.select(F.explode(items_of(df, column)).alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("item_count"))
        .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "item", "item_count")
    )


def collection_examples(df: DataFrame, column: str, position: Column, n: int = 5) -> DataFrame:
    """The first ``n`` raw values of a collection column."""
    c = F.col(f"`{column}`")
    filled = F.size(c) > 0 if isinstance(df.schema[column].dataType, T.ArrayType) else c != ""
    return (
        df.filter(c.isNotNull() & filled)
        .select(position.alias("position"), c.alias("example"))
        .orderBy("position", "example")
        .limit(n)
    )


def collection_child_table(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One row per item: parent key, position from 0, item. Narrow, no shuffle."""
    return df.select(*key, F.posexplode(items_of(df, column)).alias("item_position", "item"))


def value_lookup_table(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of a column with their counts."""
    c = F.col(f"`{column}`").cast("string")
    return (
        df.filter(c.isNotNull() & (c != ""))
        .groupBy(c.alias("value"))
        .agg(F.count(F.lit(1)).alias("value_count"))
    )
