"""Compare registered queries with their SQL: python tests/oracle_check.py [sf dir] [name ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tabulight.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def kind(name):
    low = name.lower()
    for part, label in (("int", "int"), ("long", "int"), ("double", "double"), ("float", "double"),
                        ("varchar", "text"), ("string", "text"), ("bool", "bool")):
        if part in low:
            return label
    return low


def compare(spark, connection, name, query, sql, root):
    started = time.time()
    df = query(spark, root)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return f"rows-only {len(rows):>7} {took:6.2f}s"
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) if c in names else None for c in columns]
    if sorted(names) != columns:
        return f"COLUMNS {columns} != {sorted(names)}"
    types = {d[0]: kind(str(d[1])) for d in found.description}
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
             if kind(f.dataType.typeName()) != types[f.name]}
    expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    left, right = sorted(map(repr, rows)), sorted(map(repr, expected))
    note = f" TYPES {wrong}" if wrong else ""
    if left == right:
        return f"ok {len(rows):>7} {took:6.2f}s{note}"
    only = [x for x in left if x not in set(right)][:2], [x for x in right if x not in set(left)][:2]
    return f"DIFF {len(rows)} vs {len(expected)} {note}\n   {columns}\n   {str(only)[:1500]}"


def main():
    args = sys.argv[1:]
    root = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        try:
            outcome = compare(spark, connection, name, queries[name], oracle.get(name), root)
        except Exception as error:  # noqa: BLE001
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1200]}"
        bad += not outcome.startswith(("ok", "rows-only"))
        print(f"{name:28} {outcome}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
