"""Registered queries that find structure in values alone: references, keys, heavy values, stored profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import footers, heavy, inclusion, pages, search, stored_profiles, unique_sets, vector_index
from ..sources.staging import ensure_checkpoint_dir
from . import catalog_sql as sql
from .lake import COLUMNS, NAMES, open_lake
from .registry import query


@query(f"WITH {sql.inclusion_ctes()} SELECT * FROM found")
def inclusion_dependencies(spark, root):
    """Every pair of columns of the lake of which one holds all values of the other."""
    return inclusion.inclusion_dependencies(open_lake(spark, root))


@query(
    f"""WITH {sql.inclusion_ctes()}
SELECT child_table, child_column, parent_table, parent_column, child_distinct, parent_distinct, coverage,
  count(*) OVER (PARTITION BY child_table, child_column) AS choices
FROM found WHERE parent_unique AND child_distinct >= 2
QUALIFY row_number() OVER (PARTITION BY child_table, child_column ORDER BY coverage DESC, parent_table, parent_column) = 1
"""
)
def value_references(spark, root):
    """The likeliest reference of each column, by values whatever the names."""
    return inclusion.value_references(open_lake(spark, root))


@query(sql.column_sets_sql(2))
def unique_column_sets(spark, root):
    """All minimal keys of one or two columns of every table."""
    return unique_sets.unique_column_sets(open_lake(spark, root), largest=2)


NEIGHBOURS = 10
NEIGHBOUR_SQL = f"""
SELECT query_id, id, rank, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS id, c.label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id)::INT AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0
) WHERE rank <= {NEIGHBOURS}
"""


def _folder(spark, kind):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _indexed(spark, root):
    """The vectors, every fiftieth as a query, and the path of a new index over all of them."""
    vectors = open_lake(spark, root, "embeddings")["embeddings"]
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    path = _folder(spark, "index")
    vector_index.build_index(vectors, path, "vec_id", "embedding")
    return vectors, asked, path


@query(NEIGHBOUR_SQL)
def vector_index_exact(spark, root):
    """The nearest rows of every fiftieth row, through the cells and bounds of an index."""
    _, asked, path = _indexed(spark, root)
    found = vector_index.search_index(spark, path, asked, NEIGHBOURS, exact=True)
    return found.withColumn("score", F.round("score", 6))


@query()
def vector_index_recall(spark, root):
    """How many of the nearest rows of every fiftieth row are found by probing cells alone; near all, by measurement."""
    vectors, asked, path = _indexed(spark, root)
    exact = search.nearest_batch(vectors, asked, NEIGHBOURS, "vec_id", "embedding")
    return vector_index.recall(vector_index.search_index(spark, path, asked, NEIGHBOURS), exact)


@query(
    sql.union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"{f'CASE WHEN length({c}) >= 64 THEN sha256({c}) ELSE {c} END' if kind == 'string' else f'{c}::VARCHAR'} AS value, "
        f"{f'length({c}) >= 64' if kind == 'string' else 'false'} AS is_digest, count(*) AS value_count, any_value(n) AS filled_count "
        f"FROM (SELECT *, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL{f' AND {c} <> chr(0) AND length({c}) > 0' if kind == 'string' else ''}) "
        f"GROUP BY {c} HAVING 100 * count(*) >= any_value(n)"
        for t in COLUMNS for c, kind in sql.columns_of(t) if kind == "string" or kind in sql.INTS
    )
)
def heavy_values(spark, root):
    """Every value that makes up a hundredth of a text or integer column, of all tables."""
    return heavy.heavy_values(open_lake(spark, root), one_in=100)


@query(
    f"SELECT table_name, ordinal, column_name, row_count, null_count, empty_count, min_number, max_number, avg_number, "
    f"min_text, max_text, CASE WHEN distinct_count <= 2000 THEN distinct_count END AS distinct_count "
    f"FROM ({sql.profile_sql()}) WHERE row_count > 0"
)
def profile_refresh(spark, root):
    """The profile of all tables from a store that had half of them and then read the files of the rest only.

    Distinct counts are given where sketches are exact.
    """
    path = _folder(spark, "profiles")
    stored_profiles.refresh(spark, open_lake(spark, root, *NAMES[::2]), path)
    lake = open_lake(spark, root)
    stored_profiles.refresh(spark, lake, path)
    found = stored_profiles.merged_profile(spark, lake, path)
    return found.select(
        "table_name", "ordinal", "column_name", "row_count", "null_count", "empty_count", "min_number", "max_number",
        F.round("avg_number", 4).alias("avg_number"), "min_text", "max_text",
        F.when(F.col("distinct_count") <= 2000, F.col("distinct_count")).alias("distinct_count"),
    )


@query(
    "SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate), (SELECT count(*) FROM lineitem) AS row_count "
    "FROM (FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 4321)"
)
def sample_page_deep(spark, root):
    """A page in the middle of the newest-first order, with the number of all rows."""
    items = open_lake(spark, root, "lineitem")["lineitem"]
    page = pages.deep_page(items, 50, 4321, ("l_shipdate",), ("l_orderkey", "l_linenumber"))
    return page.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    sql.union(
        f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        + (f"min({c})::BIGINT AS min_value, max({c})::BIGINT AS max_value" if kind in sql.INTS else "NULL::BIGINT AS min_value, NULL::BIGINT AS max_value")
        + f" FROM {t}"
        for t in COLUMNS for i, (c, kind) in enumerate(sql.columns_of(t), 1) if not kind.startswith("array")
    )
)
def footer_stats(spark, root):
    """Rows, nulls and whole-number ranges of all columns, from footers."""
    lake = open_lake(spark, root)
    return footers.footer_stats(spark, {t: (f"{root}/{t}.parquet", lake[t].schema) for t in lake.names})
