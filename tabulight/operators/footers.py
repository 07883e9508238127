"""Counts and ranges of Parquet tables from their footers alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import name_of, quoted, union_all
from .stored_profiles import table_files

# Parquet keeps trustworthy ends of these types in every footer.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster that reads Parquet through the reader that can answer from footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_stats(spark: SparkSession, tables: Mapping[str, tuple[str, T.StructType]]) -> DataFrame:
    """(table_name, ordinal, column_name, row_count, null_count, min_value, max_value) without reading a data page.

    ``tables`` has a path and a schema by name. Each task reads the footers of its files
    and gives their sums; ends are given for whole numbers and dates, as numbers (dates
    as days since 1970), and columns that are nested or arrays are left out. A table
    without rows has counts of 0.
    """
    session = footer_session(spark)
    frames = []
    # Spark counts a file without row groups as -1, so only files with rows are asked. Which
    # those are is in the footers too; their names are on the driver in any case, for planning.
    each = [
        table_files(spark.read.schema(schema).parquet(path)).select(F.lit(table).alias("table_name"), "file_path")
        for table, (path, schema) in sorted(tables.items())
    ]
    files: dict[str, list[str]] = {}
    for row in union_all(each).collect():
        files.setdefault(row["table_name"], []).append(row["file_path"])
    for table, (_, schema) in sorted(tables.items()):
        plain = [(i, f) for i, f in enumerate(schema.fields, 1) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        aggregates = ["count(*) AS n"]
        for i, field in plain:
            c = name_of(field.name)
            aggregates.append(f"count({c}) AS c{i}")
            if isinstance(field.dataType, RANGED):
                aggregates += [f"min({c}) AS l{i}", f"max({c}) AS h{i}"]
        if table in files:
            found = session.read.schema(schema).parquet(*sorted(files[table])).selectExpr(*aggregates)
        else:
            found = session.createDataFrame([], schema).selectExpr(*aggregates)
        structs = []
        for i, field in plain:
            ends = ["CAST(NULL AS BIGINT)"] * 2
            if isinstance(field.dataType, T.DateType):
                ends = [f"CAST(unix_date({end}{i}) AS BIGINT)" for end in "lh"]
            elif isinstance(field.dataType, RANGED):
                ends = [f"CAST({end}{i} AS BIGINT)" for end in "lh"]
            structs.append(
                f"named_struct('table_name', {quoted(table)}, 'ordinal', {i}, 'column_name', {quoted(field.name)}, 'row_count', n, "
                f"'null_count', n - c{i}, 'min_value', {ends[0]}, 'max_value', {ends[1]})"
            )
        frames.append(found.select(F.inline(F.expr(f"array({', '.join(structs)})"))))
    return union_all(frames)
