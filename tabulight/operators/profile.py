"""Row counts, samples, column profiles and whole-catalog reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.catalog import Catalog, column_descriptors, type_family

# The time columns a recent-first sample looks for, in order.
RECENT_COLUMNS = ("updated_at", "created_at")
# Usage bands by row count.
LOW_BELOW, HIGH_ABOVE = 10, 10_000
# Marks that hint at several values in one text.
COLLECTION_MARKS = r"[,;\[{|]"
DIGEST_FROM = 64


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(catalog: Catalog) -> DataFrame:
    """Rows of every table, in one job."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in sorted(catalog.tables.items())
    )


def table_stats(catalog: Catalog) -> DataFrame:
    """Rows, files and stored bytes of every file-backed table, in one job.

    Each file is first reduced to one row map-side, so only file names and
    sizes are shuffled. Files count if they hold rows; a table without rows has zeros.
    """
    frames = []
    for name, df in sorted(catalog.tables.items()):
        per_file = df.groupBy(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
        ).agg(F.count(F.lit(1)).alias("n"))
        frames.append(per_file.select(F.lit(name).alias("table_name"), "file", "size", "n"))
    found = (
        union_all(frames)
        .groupBy("table_name")
        .agg(
            F.sum("n").alias("row_count"),
            F.count("file").alias("file_count"),
            F.sum("size").alias("stored_bytes"),
        )
    )
    spark = found.sparkSession
    names = spark.createDataFrame([(name,) for name in catalog.names], "table_name string")
    return names.join(found, "table_name", "left").fillna(0)


def usage_bands(counts: DataFrame) -> DataFrame:
    """empty, low (1-9) and high (over 10000) tables; null between."""
    n = F.col("row_count")
    band = F.when(n == 0, "empty").when(n < LOW_BELOW, "low").when(n > HIGH_ABOVE, "high")
    return counts.withColumn("usage_band", band)


def sample_recent(
    df: DataFrame,
    n: int = 5,
    recent: Iterable[str] = RECENT_COLUMNS,
    tiebreak: Iterable[str] = (),
    offset: int = 0,
) -> DataFrame:
    """The newest ``n`` rows past ``offset``; a top-n heap per partition, no full sort."""
    present = [F.col(c) for c in recent if c in df.columns]
    order = [F.coalesce(*present).desc_nulls_first()] if present else []
    order += [F.col(name_of(c)).asc() for c in tiebreak]
    ordered = df.orderBy(*order) if order else df
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


PROFILE_COLUMNS = (
    "table_name", "ordinal", "column_name", "data_type", "family", "nullable", "row_count",
    "null_count", "empty_count", "marked_count", "distinct_count", "min_number", "max_number",
    "avg_number", "min_text", "max_text", "min_time", "max_time",
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(column: str) -> str:
    """A SQL identifier."""
    return "`" + column.replace("`", "``") + "`"


def value_text(column: str, data_type: T.DataType) -> str:
    """SQL for a value as text that is equal for equal values only.

    Texts of 64 characters or more go as their digest, which has exactly 64, so a
    value never weighs more than that in a shuffle.
    """
    c = name_of(column)
    if isinstance(data_type, T.TimestampType):
        return f"CAST(unix_micros({c}) AS STRING)"  # a clock change gives two instants one text
    if type_family(data_type) in ("number", "time", "bool"):
        return f"CAST({c} AS STRING)"
    text = c if type_family(data_type) == "text" else f"CAST({c} AS STRING)"
    return f"CASE WHEN length({text}) >= {DIGEST_FROM} THEN sha2({text}, 256) ELSE {text} END"


def typed_value(column: str, data_type: T.DataType) -> dict[str, str]:
    """The value under one of ``n`` (whole numbers), ``d`` (floats) and ``s`` (the rest).

    Numbers are grouped as numbers, which is far cheaper than as text.
    """
    if isinstance(data_type, T.IntegralType):
        return {"n": f"CAST({name_of(column)} AS BIGINT)"}
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return {"d": f"CAST({name_of(column)} AS DOUBLE)"}
    return {"s": value_text(column, data_type)}


def hashed_value(column: str, data_type: T.DataType) -> dict[str, str]:
    """The value's hash, for sketches: whole numbers, however long the value is."""
    return {"n": f"CASE WHEN {name_of(column)} IS NOT NULL THEN xxhash64({name_of(column)}) END"}


VALUE_TYPES = {"n": "BIGINT", "d": "DOUBLE", "s": "STRING"}


def tagged_values(
    tables: dict[str, DataFrame], wanted: dict[str, list[tuple[int, dict[str, str]]]]
) -> DataFrame:
    """``(tag, n, d, s)`` rows: per table, (tag, typed value) pairs; one scan a table."""
    sides = []
    for table, entries in wanted.items():
        structs = []
        for tag, value in entries:
            parts = [
                f"'{slot}', {value.get(slot, f'CAST(NULL AS {kind})')}" for slot, kind in VALUE_TYPES.items()
            ]
            structs.append(f"named_struct('tag', {tag}, {', '.join(parts)})")
        sides.append(tables[table].selectExpr(f"inline(array({', '.join(structs)}))"))
    return union_all(sides).filter("n IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")


def distinct_counts(
    tables: dict[str, DataFrame], wanted: dict[str, list[tuple[int, dict[str, str]]]]
) -> DataFrame:
    """Per tag: distinct values and rows that have one.

    All columns of all tables share one shuffle. Equal values are counted in their
    own tasks first, so a value that fills a third of a table is one row there.
    """
    return (
        tagged_values(tables, wanted)
        .groupBy("tag", *VALUE_TYPES)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n_rows").alias("present"))
    )


PARTIAL_SCHEMA = (
    "table_name string, ordinal int, row_count long, null_count long, empty_count long, marked_count long, "
    "min_number double, max_number double, sum_number double, nan_count long, min_text string, max_text string, "
    "min_wall timestamp_ntz, max_wall timestamp_ntz, min_instant long, max_instant long"
)
DESCRIBED = ("column_name string", "data_type string", "family string", "nullable boolean")


def _number_stats(values: pa.Array) -> dict:
    known = values.drop_null().to_numpy(zero_copy_only=False)
    real = known[~np.isnan(known)]
    ends = {"min_number": real.min(), "max_number": real.max()} if len(real) else {}
    return ends | {"sum_number": known.sum() if len(known) else None, "nan_count": len(known) - len(real)}


def _text_stats(values: pa.Array) -> dict:
    low = pc.min_max(values)
    return {
        "min_text": low["min"].as_py(), "max_text": low["max"].as_py(),
        "empty_count": pc.sum(pc.equal(values, "")).as_py() or 0,
        "marked_count": pc.sum(pc.match_substring_regex(values, COLLECTION_MARKS)).as_py() or 0,
    }


def _time_stats(values: pa.Array) -> dict:
    low = pc.min_max(values)
    if values.type.tz is None:
        return {"min_wall": low["min"], "max_wall": low["max"]}
    return {"min_instant": low["min"].value, "max_instant": low["max"].value}


def partial_stats(table: str, df: DataFrame) -> DataFrame:
    """Counts, ranges and sums of every column: one scan of the table, one row a task and column."""
    target = to_arrow_schema(T.StructType.fromDDL(PARTIAL_SCHEMA))
    columns, kinds = [], []
    for number, field in enumerate(df.schema.fields):
        c, kind = F.col(name_of(field.name)), type_family(field.dataType)
        # Only what the statistics read goes to the Arrow batches; of other types that is where the nulls are.
        value = {"number": c.cast("double"), "text": c, "time": c}.get(kind, F.when(c.isNotNull(), F.lit(True)))
        if isinstance(field.dataType, T.DateType):
            value = c.cast("timestamp_ntz")
        columns.append(value.alias(f"c{number}"))
        kinds.append({"number": _number_stats, "text": _text_stats, "time": _time_stats}.get(kind))

    # How two batches' statistics become one.
    add = lambda a, b: b if a is None else a if b is None else a + b
    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    most = lambda a, b: b if a is None else a if b is None else max(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{} for _ in kinds]
        for batch in batches:
            for stats, values, kind in zip(held, batch.columns, kinds, strict=True):
                found = {"row_count": len(values), "null_count": values.null_count}
                if kind is not None and values.null_count < len(values):
                    found |= kind(values)
                for name, value in found.items():
                    value = value.as_py() if isinstance(value, pa.Scalar) else value
                    merge = least if name.startswith("min") else most if name.startswith("max") else add
                    stats[name] = merge(stats.get(name), value)
        rows = [{"table_name": table, "ordinal": i, **stats} for i, stats in enumerate(held, 1) if stats]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.select(*columns).mapInArrow(run, PARTIAL_SCHEMA)


def merged_stats(partials: DataFrame) -> DataFrame:
    """One row a column from partial statistics of any number of tasks or files."""
    nan = F.lit(float("nan"))
    present = F.sum("row_count") - F.sum("null_count")

    def moment(end) -> Column:
        wall, instant = end("min_wall" if end is F.min else "max_wall"), end("min_instant" if end is F.min else "max_instant")
        return F.coalesce(wall.cast("string"), F.timestamp_micros(instant).cast("timestamp_ntz").cast("string"))

    zero = F.lit(0).cast("bigint")
    found = partials.groupBy("table_name", "ordinal").agg(
        *[F.max(name).alias(name) for name, _ in (d.split(" ") for d in DESCRIBED)],
        *[F.coalesce(F.sum(n), zero).alias(n) for n in ("row_count", "null_count", "empty_count", "marked_count")],
        F.when((F.sum("nan_count") > 0) & F.min("min_number").isNull(), nan).otherwise(F.min("min_number")).alias("min_number"),
        F.when(F.sum("nan_count") > 0, nan).otherwise(F.max("max_number")).alias("max_number"),
        F.when(present > 0, F.sum("sum_number") / present).alias("avg_number"),
        F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        moment(F.min).alias("min_time"), moment(F.max).alias("max_time"),
    )
    return found.withColumn("distinct_count", F.lit(None).cast("bigint")).select(*PROFILE_COLUMNS)


def described(catalog: Catalog) -> DataFrame:
    """A partial row without counts for every column, so that tables without rows have a profile too."""
    spark = next(iter(catalog.tables.values())).sparkSession
    return column_descriptors(spark, catalog).select("table_name", "ordinal", *[d.split(" ")[0] for d in DESCRIBED])


# A theta sketch is exact up to this many values; its error has 1.6 percent standard deviation beyond.
EXACT_VALUES, SKETCH_BITS = 4096, 12


def sketch_counts(tables: dict[str, DataFrame], wanted: dict[str, list[tuple[int, dict[str, str]]]]) -> DataFrame:
    """Per tag: estimated distinct hashed values and rows that have one; exact up to EXACT_VALUES.

    A task keeps a sketch of bounded size a tag, and those are all that is shuffled.
    """
    estimate = f"CAST(theta_sketch_estimate(theta_sketch_agg(n, {SKETCH_BITS})) AS BIGINT)"
    return tagged_values(tables, wanted).groupBy("tag").agg(
        F.expr(estimate).alias("distinct_count"), F.count(F.lit(1)).alias("present")
    )


def profile_catalog(
    catalog: Catalog, distinct: str = "exact", distinct_for: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per column of every table, in one job.

    Each table is scanned once for counts and ranges, of which only a row per task and
    column is shuffled. ``distinct`` is "exact", "approx" or "none"; exact counts shuffle
    distinct values, approximate ones a sketch a task, exact up to EXACT_VALUES values.
    ``distinct_for`` limits them to the columns that need one.
    """
    partials = union_all([partial_stats(t, df) for t, df in sorted(catalog.tables.items())])
    profile = merged_stats(partials.unionByName(described(catalog), allowMissingColumns=True))
    wanted: dict[str, list] = {}
    columns = []
    for table, df in sorted(catalog.tables.items()):
        for ordinal, field in enumerate(df.schema.fields, start=1):
            needed = distinct_for is None or field.name in distinct_for.get(table, ())
            if distinct != "none" and needed and type_family(field.dataType) != "other":
                value = typed_value if distinct == "exact" else hashed_value
                wanted.setdefault(table, []).append((len(columns), value(field.name, field.dataType)))
                columns.append((table, ordinal))
    if not wanted:
        return profile
    places = ", ".join(f"named_struct('table_name', {quoted(t)}, 'ordinal', {o})" for t, o in columns)
    count = distinct_counts if distinct == "exact" else sketch_counts
    counts = count(catalog.tables, wanted).select(
        F.expr(f"array({places})")[F.col("tag")].alias("at"), F.col("distinct_count").alias("found")
    ).select("at.*", "found")
    asked = F.concat_ws(".", "table_name", F.col("ordinal").cast("string")).isin(
        *[f"{t}.{o}" for t, o in columns]
    )
    # A column of nulls only has no value to count: 0, not null.
    known = F.when(asked, F.coalesce("found", F.lit(0).cast("bigint")))
    return (
        profile.join(counts, ["table_name", "ordinal"], "left")
        .withColumn("distinct_count", known)
        .select(*PROFILE_COLUMNS)
    )


def column_profile(df: DataFrame, table: str, distinct: str = "exact", distinct_for=None) -> DataFrame:
    """The profile of one table; see ``profile_catalog``."""
    limits = None if distinct_for is None else {table: list(distinct_for)}
    return profile_catalog(Catalog({table: df}), distinct, limits)


def profile_database(catalog: Catalog) -> DataFrame:
    """One row per table: rows, columns and declared keys, with the table count."""
    frames = []
    for name in catalog.names:
        keys = catalog.keys_of(name)
        frames.append(
            catalog[name]
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(
                F.lit(catalog.database).alias("database"),
                F.lit(len(catalog.names)).cast("bigint").alias("tables_count"),
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(catalog[name].columns)).cast("bigint").alias("column_count"),
                F.lit(",".join(keys.primary)).alias("primary_key"),
                F.lit(len(keys.foreign)).cast("bigint").alias("foreign_key_count"),
            )
        )
    return union_all(frames)


def orderable(df: DataFrame) -> list[str]:
    """The columns that can stand in for a key where rows must have one order."""
    return [f.name for f in df.schema.fields if type_family(f.dataType) in ("number", "text", "time", "bool")]


def table_report(
    catalog: Catalog, n: int = 5, recent: Iterable[str] = RECENT_COLUMNS, tiebreak: dict | None = None
) -> DataFrame:
    """Schema, keys, newest rows (as JSON) and row count of each table; one row per table.

    Ties between newest rows go by ``tiebreak``, the primary key, or all columns of a table without one.
    """
    shape = (
        "struct<schema:array<struct<name:string,type:string,nullable:boolean>>,constraints:struct<"
        "primary_keys:array<string>,foreign_keys:array<string>,unique_keys:array<string>>>"
    )
    frames = []
    for name in catalog.names:
        df, keys = catalog[name], catalog.keys_of(name)
        known = {
            "schema": [
                {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable}
                for f in df.schema.fields
            ],
            "constraints": {
                "primary_keys": list(keys.primary),
                "foreign_keys": [
                    f"{','.join(k.columns)} -> {k.ref_table}.{','.join(k.ref_columns)}" for k in keys.foreign
                ],
                "unique_keys": [",".join(u) for u in keys.unique],
            },
        }
        described = F.from_json(F.lit(json.dumps(known)), shape)
        rows = sample_recent(df, n, recent, (tiebreak or {}).get(name, keys.primary or orderable(df)))
        samples = rows.agg(
            F.collect_list(F.to_json(F.struct("*"))).alias("samples")
        )
        frames.append(
            samples.select(
                F.lit(name).alias("table_name"),
                described["schema"].alias("schema"),
                described["constraints"].alias("constraints"),
                "samples",
                F.lit(len(df.columns)).alias("column_count"),
                F.size("samples").alias("sample_count"),
                F.lit(bool(keys.primary or keys.foreign or keys.unique)).alias("has_constraints"),
                F.lit(bool(keys.primary or keys.unique)).alias("has_indexes"),
            )
        )
    return union_all(frames).join(row_counts(catalog), "table_name").select(
        "table_name", "schema", "constraints", "samples", "row_count", "column_count", "sample_count",
        "has_constraints", "has_indexes",
    )


def database_report(
    catalog: Catalog, n: int = 5, recent: Iterable[str] = RECENT_COLUMNS, tiebreak: dict | None = None
) -> DataFrame:
    """The whole first stage as one row: database, its type, time, number of tables, and every table's report by name.

    It holds an entry a table of the catalog and at most ``n`` rows of each.
    """
    report = table_report(catalog, n, recent, tiebreak)
    listed = F.array_sort(F.collect_list(F.struct(*report.columns)))
    return report.agg(
        F.lit(catalog.database).alias("database"), F.lit(catalog.database_type).alias("database_type"),
        F.count(F.lit(1)).alias("tables_count"), F.current_timestamp().alias("generated_at"), listed.alias("tables"),
    )


def database_overview(report: DataFrame) -> DataFrame:
    """Totals over table reports."""
    return report.agg(
        F.count(F.lit(1)).alias("tables_count"),
        F.sum(F.col("column_count").cast("bigint")).alias("total_columns"),
        F.sum(F.col("sample_count").cast("bigint")).alias("total_samples"),
        F.count_if("has_constraints").alias("tables_with_constraints"),
        F.count_if("has_indexes").alias("tables_with_indexes"),
    )
