"""A catalog from a relational database: its base tables with their declared keys, each read in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog, ForeignKey, TableKeys, read_jdbc

PARTITIONS = 64
KINDS = "('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')"


def is_mysql(db_type: str) -> bool:
    return db_type == "mysql"


def quoted_name(db_type: str, name: str) -> str:
    mark = "`" if is_mysql(db_type) else '"'
    return mark + name.replace(mark, mark * 2) + mark


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tables_sql(schema: str) -> str:
    """Names of the base tables; views are left out."""
    return (
        "SELECT table_name AS table_name FROM information_schema.tables "
        f"WHERE table_schema = {literal(schema)} AND table_type = 'BASE TABLE'"
    )


def constraints_sql(db_type: str, schema: str) -> str:
    """A row per column of each key: table, constraint, kind, place, column, referenced table and column."""
    listed = (
        "SELECT k.table_name AS table_name, k.constraint_name AS constraint_name, c.constraint_type AS kind, "
        "k.ordinal_position AS place, k.column_name AS column_name, {table} AS ref_table, {column} AS ref_column "
        "FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name"
    )
    where = f" WHERE c.table_schema = {literal(schema)} AND c.constraint_type IN {KINDS}"
    if is_mysql(db_type):
        return listed.format(table="k.referenced_table_name", column="k.referenced_column_name") + where
    return (
        listed.format(table="u.table_name", column="u.column_name")
        + " LEFT JOIN information_schema.referential_constraints r "
        "ON r.constraint_schema = c.constraint_schema AND r.constraint_name = c.constraint_name "
        "LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema "
        "AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint" + where
    )


def declared_keys(rows: Iterable[dict]) -> dict[str, TableKeys]:
    """Keys by table from the rows of ``constraints_sql``; columns in their declared order."""
    groups: dict[tuple, list] = {}
    for row in rows:
        groups.setdefault((row["table_name"], row["kind"], row["constraint_name"]), []).append(row)
    found: dict[str, dict[str, list]] = {}
    for (table, kind, _), parts in sorted(groups.items(), key=itemgetter(0)):
        parts.sort(key=itemgetter("place"))
        columns = tuple(p["column_name"] for p in parts)
        entry = columns
        if kind == "FOREIGN KEY":
            entry = ForeignKey(columns, parts[0]["ref_table"], tuple(p["ref_column"] for p in parts))
        found.setdefault(table, {}).setdefault(kind, []).append(entry)
    return {
        table: TableKeys(
            (kinds.get("PRIMARY KEY") or [()])[0], tuple(kinds.get("FOREIGN KEY", ())), tuple(kinds.get("UNIQUE", ()))
        )
        for table, kinds in found.items()
    }


def read_jdbc_catalog(
    spark: SparkSession, schema: str | None = None, partitions: int = PARTITIONS,
    read: Callable[..., DataFrame] = read_jdbc, **connection,
) -> Catalog:
    """All base tables of a schema with their declared keys, read lazily.

    ``schema`` is "public", or the database itself in MySQL. A table with a whole-number
    primary key of one column is read in ``partitions`` ranges of it; the range ends are the
    only rows fetched here besides the names of tables and key columns. Other tables come
    in one part, as the database gives no other way to cut them.
    """
    db_type, database = connection["db_type"], connection["database"]
    schema = schema or (database if is_mysql(db_type) else "public")

    def ask(text: str) -> list[dict]:
        return [row.asDict() for row in read(spark, table=f"({text}) asked", **connection).collect()]

    names = sorted(row["table_name"] for row in ask(tables_sql(schema)))
    keys = {t: k for t, k in declared_keys(ask(constraints_sql(db_type, schema))).items() if t in names}
    tables = {}
    for name in names:
        full = f"{quoted_name(db_type, schema)}.{quoted_name(db_type, name)}"
        whole = read(spark, table=full, **connection)
        primary = keys.get(name, TableKeys()).primary
        if len(primary) == 1 and isinstance(whole.schema[primary[0]].dataType, T.IntegralType):
            column = quoted_name(db_type, primary[0])
            (ends,) = ask(f"SELECT min({column}) AS low, max({column}) AS high FROM {full}")
            if ends["low"] is not None and ends["low"] < ends["high"]:
                whole = read(
                    spark, table=full, partition_column=primary[0], lower_bound=ends["low"], upper_bound=ends["high"] + 1,
                    num_partitions=partitions, **connection,
                )
        tables[name] = whole
    return Catalog(tables, keys, database, db_type)
