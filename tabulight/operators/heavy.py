"""Values that fill a share of a column, found for all columns at once.

A first pass keeps counters of a bounded number of values a column in each task and merges
them; no value that fills the wanted share can be missing from those. A second pass counts
just the values that were kept, exactly. Neither shuffles a column's other values.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Catalog, type_family
from ..sources.staging import small_side
from .profile import DIGEST_FROM, name_of, tagged_values, value_text

# Counters a column per value that could be heavy. The merged counters are wrong by at most 3.5 rows in
# COUNTERS · one_in, under half of the share that is looked for.
COUNTERS = 8


def heavy_columns(catalog: Catalog) -> list[tuple[str, str, str]]:
    """(table, column, SQL of the value as text) of all text and integer columns; blank texts are no values."""
    found = []
    for table in catalog.names:
        for field in catalog[table].schema.fields:
            text = value_text(field.name, field.dataType)
            if type_family(field.dataType) == "text":
                found.append((table, field.name, f"CASE WHEN {name_of(field.name)} <> '' THEN {text} END"))
            elif isinstance(field.dataType, T.IntegralType):
                found.append((table, field.name, text))
    return found


def heavy_values(catalog: Catalog, one_in: int = 100) -> DataFrame:
    """(table_name, column_name, value, is_digest, value_count, filled_count), exact, of every value that
    makes up at least one in ``one_in`` of a column's rows that have a value.

    All text and integer columns are looked at; nulls and blank texts are no values. A
    text of 64 characters or more is told by its SHA-256 digest. A column has at most
    ``one_in`` such values.
    """
    columns = heavy_columns(catalog)
    entries: dict[str, list] = {}
    for tag, (table, _, value) in enumerate(columns):
        entries.setdefault(table, []).append((tag, {"s": value}))
    values = tagged_values(catalog.tables, entries).select("tag", "s")
    kept = 1 << math.ceil(math.log2(COUNTERS * one_in))
    counters = values.groupBy("tag").agg(
        F.count(F.lit(1)).alias("filled_count"), F.expr(f"approx_top_k(s, {kept}, {kept})").alias("items")
    )
    likely = counters.select("tag", "filled_count", F.explode("items").alias("i")).select(
        "tag", "filled_count", F.col("i.item").alias("s"), F.col("i.count").alias("about")
    ).filter(F.col("about") * one_in * 2 >= F.col("filled_count")).drop("about")
    # At most 2 · one_in values a column of the catalog, 64 characters each.
    exact = values.join(small_side(likely, F.lit(96)), ["tag", "s"]).groupBy("tag", "s", "filled_count").agg(F.count(F.lit(1)).alias("value_count"))
    names = F.from_json(F.lit(json.dumps([c[:2] for c in columns])), "array<array<string>>")[F.col("tag")]
    return exact.filter(F.col("value_count") * one_in >= F.col("filled_count")).select(
        names[0].alias("table_name"), names[1].alias("column_name"), F.col("s").alias("value"),
        (F.length("s") >= DIGEST_FROM).alias("is_digest"), "value_count", "filled_count",
    )
