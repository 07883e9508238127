"""Tables, declared keys and the readers that make a catalog."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of a table refer to ``ref_columns`` of ``ref_table``."""

    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableKeys:
    """Declared keys of one table; Spark keeps none, so callers pass them in."""

    primary: tuple[str, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


@dataclass
class Catalog:
    """Named tables with their declared keys."""

    tables: dict[str, DataFrame]
    keys: dict[str, TableKeys] = field(default_factory=dict)
    database: str = "lake"
    database_type: str = "parquet"

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def names(self) -> list[str]:
        return sorted(self.tables)

    def keys_of(self, name: str) -> TableKeys:
        return self.keys.get(name, TableKeys())

    def with_table(self, name: str, df: DataFrame) -> "Catalog":
        return Catalog({**self.tables, name: df}, self.keys, self.database, self.database_type)

    def register(self) -> "Catalog":
        """Expose every table as a temporary view."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self


def read_catalog(
    spark: SparkSession,
    root: str,
    names: Iterable[str],
    keys: Mapping[str, TableKeys] | None = None,
    suffix: str = ".parquet",
    schemas: Mapping[str, T.StructType] | None = None,
    database: str = "lake",
) -> Catalog:
    """One Parquet folder or file per table; a given schema skips footer reads."""
    tables = {}
    for name in names:
        reader = spark.read
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        tables[name] = reader.parquet(f"{root.rstrip('/')}/{name}{suffix}")
    return Catalog(tables, dict(keys or {}), database)


def jdbc_options(
    db_type: str,
    host: str,
    port: int,
    database: str,
    table: str,
    user: str,
    password: str,
    partition_column: str | None = None,
    lower_bound: str | int | None = None,
    upper_bound: str | int | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for a partitioned JDBC read of PostgreSQL or MySQL."""
    schemes = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql"}
    drivers = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}
    if db_type not in schemes:
        raise ValueError(f"unsupported database type: {db_type}")
    scheme = schemes[db_type]
    options = {
        "url": f"jdbc:{scheme}://{host}:{port}/{database}",
        "dbtable": table,
        "user": user,
        "password": password,
        "driver": drivers[scheme],
        "fetchsize": str(fetch_size),
    }
    bounds = (lower_bound, upper_bound, num_partitions)
    if partition_column:
        if any(value is None for value in bounds):
            raise ValueError("a partitioned read needs lower_bound, upper_bound and num_partitions")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    """A relational table; split on a column so executors read it in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def type_family(data_type: T.DataType) -> str:
    """number, text, time, bool, array or other."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.ArrayType):
        return "array"
    return "other"


def literal_rows(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few rows of metadata as a one-partition frame, from one constant."""
    shape = "array<struct<" + ",".join(":".join(f.split(" ", 1)) for f in fields.split(", ")) + ">>"
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))


def column_descriptors(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """One row per column of the catalog, from the schemas alone."""
    rows = []
    for name in catalog.names:
        for ordinal, column in enumerate(catalog[name].schema.fields, start=1):
            decimal = isinstance(column.dataType, T.DecimalType)
            rows.append(
                {
                    "table_name": name,
                    "ordinal": ordinal,
                    "column_name": column.name,
                    "data_type": column.dataType.simpleString(),
                    "family": type_family(column.dataType),
                    "nullable": column.nullable,
                    "precision": column.dataType.precision if decimal else 0,
                    "scale": column.dataType.scale if decimal else 0,
                }
            )
    return literal_rows(
        spark,
        rows,
        "table_name string, ordinal int, column_name string, data_type string, family string, "
        "nullable boolean, precision int, scale int",
    )


def declared_constraints(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Declared keys as rows: table, kind, name, columns, referenced table and columns."""
    rows = []

    def add(table, kind, label, columns, ref_table=None, ref_columns=None):
        rows.append(
            {
                "table_name": table,
                "kind": kind,
                "constraint_name": label,
                "columns": list(columns),
                "ref_table": ref_table,
                "ref_columns": ref_columns,
            }
        )

    for name in catalog.names:
        keys = catalog.keys_of(name)
        if keys.primary:
            add(name, "primary", f"{name}_pkey", keys.primary)
        for fk in keys.foreign:
            label = f"{name}_{'_'.join(fk.columns)}_fkey"
            add(name, "foreign", label, fk.columns, fk.ref_table, list(fk.ref_columns))
        for columns in keys.unique:
            add(name, "unique", f"{name}_{'_'.join(columns)}_key", columns)
    return literal_rows(
        spark,
        rows,
        "table_name string, kind string, constraint_name string, columns array<string>, "
        "ref_table string, ref_columns array<string>",
    )


def decoded(df: DataFrame) -> DataFrame:
    """Binary columns as UTF-8 text, the rest unchanged."""
    return df.select(
        *[
            F.decode(F.col(f"`{c.name}`"), "UTF-8").alias(c.name)
            if isinstance(c.dataType, T.BinaryType)
            else F.col(f"`{c.name}`")
            for c in df.schema.fields
        ]
    )
