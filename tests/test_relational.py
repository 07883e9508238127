"""A catalog from a relational database, with a reader that answers in its place; references in one job; stage reports."""

from pyspark.sql import functions as F

from tabulight.operators import profile, validate
from tabulight.sources import reports
from tabulight.sources.catalog import Catalog, ForeignKey, TableKeys
from tabulight.sources.knowledge import chunk_counts
from tabulight.sources.relational import constraints_sql, declared_keys, quoted_name, read_jdbc_catalog, tables_sql

KEY_ROWS = "table_name string, constraint_name string, kind string, place int, column_name string, ref_table string, ref_column string"


def test_a_catalog_with_keys_and_split_reads(spark):
    asked = []
    people = spark.createDataFrame([(3, "a", 1), (90, "b", 2)], "id bigint, name string, town int")
    towns = spark.createDataFrame([("x", 1)], "code string, no int")
    keys = [
        ("people", "pk", "PRIMARY KEY", 1, "id", None, None), ("towns", "pk", "PRIMARY KEY", 1, "code", None, None),
        ("people", "fk", "FOREIGN KEY", 2, "town", "towns", "no"), ("people", "fk", "FOREIGN KEY", 1, "name", "towns", "code"),
        ("towns", "once", "UNIQUE", 1, "no", None, None), ("gone", "pk", "PRIMARY KEY", 1, "id", None, None),
    ]

    def read(session, table, **options):
        asked.append((table, options))
        if "information_schema.tables" in table:
            return session.createDataFrame([("towns",), ("people",)], "table_name string")
        if "table_constraints" in table:
            return session.createDataFrame(keys, KEY_ROWS)
        if "min(" in table:
            return people.agg(F.min("id").alias("low"), F.max("id").alias("high"))
        return people if "people" in table else towns

    lake = read_jdbc_catalog(spark, read=read, partitions=8, db_type="postgres", host="h", port=1, database="shop", user="u", password="p")
    assert lake.names == ["people", "towns"] and lake.database == "shop" and lake.database_type == "postgres"
    assert lake.keys == {
        "people": TableKeys(("id",), (ForeignKey(("name", "town"), "towns", ("code", "no")),)),
        "towns": TableKeys(("code",), (), (("no",),)),
    }
    split = [(t, o) for t, o in asked if "partition_column" in o]
    assert [(t, o["partition_column"], o["lower_bound"], o["upper_bound"], o["num_partitions"]) for t, o in split] == [
        ('"public"."people"', "id", 3, 91, 8)
    ]
    assert validate.constraint_violations(lake, [validate.ReferenceRule("people", "town", "towns", "no")]).first()["violations"] == 1


def test_names_and_statements():
    assert quoted_name("mysql", "a`b") == "`a``b`" and quoted_name("postgres", 'a"b') == '"a""b"'
    assert "'o''clock'" in tables_sql("o'clock") and "BASE TABLE" in tables_sql("x")
    assert "referenced_table_name" in constraints_sql("mysql", "shop")
    assert "position_in_unique_constraint" in constraints_sql("postgresql", "public")
    assert declared_keys([]) == {}


def test_references_of_many_rules_in_one_shuffle(spark):
    parent = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (2, None, None)], "k bigint, s string, d double")
    rows = [(1, "a", 1.0), (5, "z" * 80, 2.5), (5, "z" * 80, -1.0), (None, None, None), (2, "b", float("nan"))]
    child = spark.createDataFrame(rows, "k int, s string, d double")
    lake = Catalog({"p": parent, "c": child, "e": parent.limit(0)})
    rules = [validate.ReferenceRule("c", x, t, x) for t in ("p", "e") for x in "ksd"] + [validate.ReferenceRule("e", "k", "p", "k")]
    found = validate.constraint_violations(lake, rules)
    got = {(r["table_name"], r["rule"]): r["violations"] for r in found.collect()}
    assert got == {
        ("c", "k in p.k"): 2, ("c", "s in p.s"): 2, ("c", "d in p.d"): 2,
        ("c", "k in e.k"): 4, ("c", "s in e.s"): 4, ("c", "d in e.d"): 4, ("e", "k in p.k"): 0,
    }


def test_stage_report_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "id int, name string")
    lake = Catalog({"b": a.limit(0), "a": a}, {"a": TableKeys(("id",))}, "db")
    path = str(tmp_path / "stage")
    reports.write_report(profile.database_report(lake, 3), path)
    (back,) = reports.read_database_report(spark, path).collect()
    assert back["database"] == "db" and back["tables_count"] == 2 and back["generated_at"] is not None
    assert [t["table_name"] for t in back["tables"]] == ["a", "b"]
    assert [t["row_count"] for t in back["tables"]] == [9, 0]
    assert back["tables"][0]["samples"] == ['{"id":%d,"name":"n%d"}' % (i, i) for i in range(3)]
    tables = reports.table_reports(reports.read_database_report(spark, path))
    assert tuple(profile.database_overview(tables).first()) == (2, 4, 3, 1, 1)


def test_chunk_counts(spark):
    rows = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x")], "phase string, source string")
    got = {(r["grouping"], r["name"], r["chunk_count"]) for r in chunk_counts(rows).collect()}
    assert got == {("phase", "p", 2), ("phase", "q", 1), ("source", "x", 2), ("source", "y", 1), ("total", None, 3)}
    assert chunk_counts(rows.limit(0)).count() == 0
