import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulight.operators import chunks, findings, profile
from tabulight.sources import catalog as sources
from tabulight.sources import reports
from tabulight.sources.staging import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people") / "people")
    rows = [
        (i, None if i % 4 == 0 else "", "a,b" if i < 3 else "plain", float(i), dt.datetime(2024, 1, 1 + i), b"raw", [i])
        for i in range(10)
    ]
    schema = "id int, note string, tags string, score double, updated_at timestamp, blob binary, parts array<int>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile(people):
    stats = by_column(profile.column_profile(people, "people"))
    assert stats["note"]["null_count"] == 3 and stats["note"]["empty_count"] == 7 and stats["note"]["distinct_count"] == 1
    assert stats["tags"]["marked_count"] == 3 and stats["tags"]["min_text"] == "a,b"
    assert (stats["score"]["min_number"], stats["score"]["max_number"], stats["score"]["avg_number"]) == (0, 9, 4.5)
    assert stats["updated_at"]["max_time"] == "2024-01-10 00:00:00"
    assert stats["parts"]["distinct_count"] == 10 and stats["parts"]["family"] == "array"
    assert stats["blob"]["distinct_count"] is None


def test_profile_distinct_modes(people):
    assert by_column(profile.column_profile(people, "p", "approx"))["id"]["distinct_count"] == 10
    assert by_column(profile.column_profile(people, "p", "none"))["id"]["distinct_count"] is None
    some = by_column(profile.column_profile(people, "p", "exact", ["id"]))
    assert some["id"]["distinct_count"] == 10 and some["tags"]["distinct_count"] is None


def test_long_texts_count_as_digests(spark):
    df = spark.createDataFrame([("x" * 100 + str(i % 3),) for i in range(30)] + [("y" * 63,)], "t string")
    assert by_column(profile.column_profile(df, "t"))["t"]["distinct_count"] == 4


def test_all_null_column_has_no_distinct_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    assert by_column(profile.column_profile(df, "t"))["x"]["distinct_count"] == 0


def test_no_rows(spark):
    df = spark.createDataFrame([], "status string, n int")
    stats = findings.with_key_flags(profile.column_profile(df, "t"), sources.Catalog({"t": df}))
    assert by_column(findings.column_issues(stats)).keys() == {"n"}


@pytest.mark.parametrize(
    "name, distinct, rows, expected",
    [
        ("status", 20, 100, True), ("status", 21, 100, False), ("city", 50, 100, True), ("city", 51, 100, False),
        ("city", 1, 100, False), ("user_id", 33, 100, True), ("user_id", 34, 100, False), ("width", 2, 100, False),
        ("uuid", 20, 100, True), ("code", 11, 100, True), ("code", 10, 100, False), ("code", 51, 100, False),
        ("status", 1, 2, False),
    ],
)
def test_value_list_rule(spark, name, distinct, rows, expected):
    row = spark.range(0, 1, 1, 1).selectExpr(
        f"'{name}' AS column_name", "'text' AS family", f"{rows} AS row_count", "0 AS null_count", "0 AS empty_count",
        f"{distinct} AS distinct_count",
    )
    assert row.select(findings.value_list_rule()).first()[0] is expected


def test_enum_rule(spark):
    def verdict(distinct, rows):
        frame = spark.range(0, 1, 1, 1).selectExpr(
            "'text' AS family", f"{rows} AS row_count", "0 AS empty_count", f"{distinct} AS distinct_count"
        )
        return frame.select(findings.enum_rule()).first()[0]

    assert [verdict(2, 15), verdict(2, 14), verdict(3, 15), verdict(1, 99), verdict(19, 100), verdict(20, 100)] == [
        True, False, False, False, True, False,
    ]


def test_recent_samples_and_pages(people):
    newest = profile.sample_recent(people, 3).collect()
    assert [r["id"] for r in newest] == [9, 8, 7]
    page = profile.sample_recent(people, 3, tiebreak=["id"], offset=8).collect()
    assert [r["id"] for r in page] == [1, 0]
    assert profile.sample_recent(people.drop("updated_at"), 4).count() == 4


def test_stats_and_report_round_trip(spark, people, tmp_path):
    lake = sources.Catalog({"people": people}, {"people": sources.TableKeys(("id",))}, "db")
    stats = profile.table_stats(lake).first()
    assert stats["row_count"] == 10 and stats["file_count"] == 1 and stats["stored_bytes"] > 0
    report = profile.table_report(lake, 4)
    path = str(tmp_path / "report")
    reports.write_report(report, path)
    again = reports.read_table_report(spark, path, "people").first()
    assert again["sample_count"] == 4 and again["constraints"]["primary_keys"] == ["id"] and again["row_count"] == 10
    overview = profile.database_overview(reports.read_report(spark, path)).first()
    assert tuple(overview) == (1, 7, 4, 1, 1)
    text = chunks.table_text(reports.read_report(spark, path)).first()["content"]
    assert text.startswith("Table: people\nColumns:\n  - id (int, nullable: true)\n") and "Primary Keys: [id]" in text
    sample = chunks.sample_text(reports.read_report(spark, path)).first()["content"]
    assert sample.count("\nSample ") == 3


def test_binary_is_decoded(people):
    assert sources.decoded(people).select("blob").first()[0] == "raw"


def test_descriptors_and_constraints(spark, people):
    keys = sources.TableKeys(("id",), (sources.ForeignKey(("score",), "x", ("y",)),), (("note", "tags"),))
    lake = sources.Catalog({"people": people.withColumn("money", F.lit(1).cast("decimal(8,3)"))}, {"people": keys})
    found = {r["column_name"]: r for r in sources.column_descriptors(spark, lake).collect()}
    assert (found["money"]["precision"], found["money"]["scale"]) == (8, 3) and found["id"]["ordinal"] == 1
    kinds = {r["kind"]: r for r in sources.declared_constraints(spark, lake).collect()}
    assert kinds["foreign"]["ref_table"] == "x" and kinds["unique"]["columns"] == ["note", "tags"]


def test_jdbc_options():
    options = sources.jdbc_options("postgres", "h", 5432, "d", "t", "u", "p", "id", 1, 100, 8)
    assert options["url"] == "jdbc:postgresql://h:5432/d" and options["numPartitions"] == "8"
    assert sources.jdbc_options("mysql", "h", 3306, "d", "t", "u", "p")["url"] == "jdbc:mysql://h:3306/d"
    with pytest.raises(ValueError):
        sources.jdbc_options("oracle", "h", 1, "d", "t", "u", "p")
    with pytest.raises(ValueError):
        sources.jdbc_options("mysql", "h", 1, "d", "t", "u", "p", "id")


def test_checkpoint_folder_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_samples_of_a_table_without_a_key_are_the_same_each_time(spark):
    rows = [(i % 3, f"t{i % 7}", float(i % 5)) for i in range(200)]
    one = spark.createDataFrame(rows, "a int, `b.c` string, d double")
    seen = set()
    for parts in (1, 5):
        report = profile.table_report(sources.Catalog({"t": one.repartition(parts)}), 4).first()
        seen.add(tuple(report["samples"]))
    assert len(seen) == 1 and len(report["samples"]) == 4


def test_instants_are_told_apart_at_a_clock_change(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        two = spark.sql("SELECT timestamp_seconds(x) AS at FROM VALUES (1729989000), (1729992600) AS v(x)")  # both 02:30
        assert {str(r["at"]) for r in two.select(F.col("at").cast("string").alias("at")).collect()} == {"2024-10-27 02:30:00"}
        (found,) = profile.column_profile(two, "t").collect()
        assert found["distinct_count"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
