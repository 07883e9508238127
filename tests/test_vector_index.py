"""The inverted-list index: exact mode against a scan, recall of probing, appends."""

import random

import numpy as np
import pytest

from tabulight.operators import search, vector_index


def clustered(seed, count, dims=12, groups=15):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dims))
    return (centres[rng.integers(0, groups, count)] + rng.normal(size=(count, dims)) * 0.4).round(4).tolist()


def as_set(df):
    return {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """Clustered vectors, many copies of one, and vectors that have no direction or another length."""
    found = clustered(1, 300)
    found += [found[5]] * 100 + [None, [], [0.0] * 12, [1.0, 2.0], [None] * 12]
    return spark.createDataFrame(list(enumerate(found)), "chunk_id long, vector array<double>")


@pytest.fixture(scope="module")
def asked(spark):
    found = clustered(2, 30) + [[0.0] * 12, [-5.0] * 12, None, [1.0]]
    return spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(found)], "query_id string, query_vector array<double>")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("index") / "store")
    vector_index.build_index(rows, path)
    return path


def test_every_row_is_indexed_once(spark, rows, index):
    centres = vector_index.read_centres(spark, index)
    assert centres.rows.sum() == 400 and centres.outside == 5 and 1 <= centres.probe <= len(centres.rows)
    stored = spark.read.parquet(f"{index}/rows")
    assert sorted(r["id"] for r in stored.select("id").collect()) == list(range(405))


@pytest.mark.parametrize("k,probe", [(7, 1), (150, 3)])
def test_exact_mode_equals_a_scan(spark, rows, asked, index, k, probe, monkeypatch):
    """Also with a few queries and rows a task, for a k past the copies, and from any number of probes."""
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(vector_index, "ROWS_PER_PART", 25)
    clean = asked.filter("query_vector IS NOT NULL")
    found = as_set(vector_index.search_index(spark, index, clean, k, probe=probe, exact=True))
    assert found == as_set(search.nearest_batch(rows, clean, k))


def test_probing_finds_most_and_the_measure_tells(spark, rows, asked, index):
    real = asked.limit(30)
    exact = search.nearest_batch(rows, real, 10)
    shares = vector_index.recall(vector_index.search_index(spark, index, real, 10), exact).collect()
    assert len(shares) == 30 and sum(r["n_found"] for r in shares) >= 0.9 * sum(r["n_exact"] for r in shares)
    one = vector_index.recall(vector_index.search_index(spark, index, real, 10, probe=1), exact).collect()
    assert sum(r["n_found"] for r in one) <= sum(r["n_found"] for r in shares)


def test_added_rows_are_found(spark, rows, tmp_path):
    path = f"file://{tmp_path}/store"
    first = rows.filter("chunk_id % 2 = 0")
    vector_index.build_index(first, path, cells=9)
    vector_index.add_rows(rows.filter("chunk_id % 2 = 1"), path)
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(3, 20))], "query_id int, query_vector array<double>")
    assert as_set(vector_index.search_index(spark, path, wanted, 5, exact=True)) == as_set(search.nearest_batch(rows, wanted, 5))


def test_an_index_of_nothing(spark, rows, tmp_path):
    path = f"file://{tmp_path}/store"
    vector_index.build_index(rows.limit(0), path)
    wanted = spark.createDataFrame([(1, [1.0] * 12)], "query_id int, query_vector array<double>")
    assert vector_index.search_index(spark, path, wanted, 5, exact=True).collect() == []


def test_bounds_hold_for_random_vectors(spark, tmp_path):
    """Vectors without clusters, where bounds rule out little."""
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)], "chunk_id int, vector array<float>")
    path = f"file://{tmp_path}/store"
    vector_index.build_index(rows, path)
    wanted = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(30)], "query_id int, query_vector array<float>")
    found = as_set(vector_index.search_index(spark, path, wanted, 6, probe=2, exact=True))
    assert found == as_set(search.nearest_batch(rows, wanted, 6))
