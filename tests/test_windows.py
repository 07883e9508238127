import random

import pytest
from pyspark.sql import functions as F

from tabulight.operators import hierarchy, windows


@pytest.fixture(scope="module")
def moves(spark):
    rng = random.Random(3)
    keys = ["hot"] * 200 + [f"k{i % 40}" for i in range(200)]
    rows = [(k, i, rng.randint(-5, 9)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, n int").repartition(4)


def test_sliced_running_total_equals_one_window(moves):
    plain = windows.running_total(moves, ["k"], ["at"], "n").collect()
    sliced = windows.running_total(moves, ["k"], ["at"], "n", slices=7).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, sliced))
    assert len({r["k"] for r in plain}) == 41


def test_sliced_previous_value_equals_one_window(moves):
    gaps = moves.withColumn("n", F.when(F.col("at") % 11 != 0, F.col("n")))
    plain = windows.previous_value(gaps, ["k"], ["at"], "n").collect()
    sliced = windows.previous_value(gaps, ["k"], ["at"], "n", slices=7).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, sliced))


def test_dedupe_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "name string, source int, v string")
    assert sorted(map(tuple, windows.dedupe_first(df, ["name"], ["source"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]


def test_top_n(moves):
    top = windows.top_n_per_group(moves, ["k"], [F.col("n").desc(), F.col("at")], 2).collect()
    assert len(top) == 82 and {r["row_number"] for r in top} == {1, 2}


def test_deep_tree_cycle_and_orphan(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(75)]
    odd = [(100, 101, "x"), (101, 100, "y"), (102, 101, "below"), (200, 999, "orphan")]
    found = hierarchy.tree_paths(spark.createDataFrame(chain + odd, "id int, up int, name string").coalesce(2), "id", "up", "name")
    by_id = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert by_id[74][:2] == (0, 75) and by_id[74][2].split(" > ") == [f"n{i}" for i in range(75)]
    assert by_id[0] == (0, 1, "n0")
    assert by_id[100] == by_id[101] == by_id[102] == (None, None, None)
    assert by_id[200] == (200, 1, "orphan")
