"""Business areas of tables and texts: domain, processes, entities, relations, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import (
    AREA_LABELS,
    DIMENSION_CLASSES,
    DOMAIN_GENERAL,
    DOMAIN_INVENTORY,
    DOMAIN_PLATFORM,
    DOMAIN_RETAIL,
    RELATION_PAIRS,
)
from ..functions.text import text_summary
from ..sources.catalog import literal_rows


def infer_domain(areas: DataFrame, group: str = "source", area: str = "area") -> DataFrame:
    """The business domain of each group from the areas found in it; one aggregate."""

    def has(name: str) -> Column:
        return F.bool_or(F.col(area) == name)

    orders, products, customers = (
        has(x) for x in ("order_management", "product_management", "customer_management")
    )
    shipping, inventory = has("shipping_logistics"), has("inventory_management")
    sells = orders & products & customers
    domain = (
        F.when(sells & shipping, DOMAIN_PLATFORM)
        .when(sells, DOMAIN_RETAIL)
        .when(inventory & products, DOMAIN_INVENTORY)
        .otherwise(DOMAIN_GENERAL)
    )
    return areas.groupBy(group).agg(domain.alias("domain"))


def business_labels(areas: DataFrame, group: str = "source", area: str = "area") -> DataFrame:
    """Processes and entities of each group; areas are made distinct before labels are added."""
    labels = F.array(
        *[
            F.struct(F.lit(a).alias("area"), F.lit(kind).alias("kind"), F.lit(text).alias("label"))
            for a, kind, text in AREA_LABELS
        ]
    )
    present = areas.select(group, F.col(area).alias("found")).distinct()
    fitting = F.filter(labels, lambda x: x["area"] == F.col("found"))
    return present.select(group, F.inline(fitting)).select(group, "kind", "label").distinct()


def keyword_pairs(
    texts: DataFrame, text: str, group: str | None = None, pairs: Sequence[tuple[str, str, str]] = RELATION_PAIRS
) -> DataFrame:
    """Distinct relations whose two words meet in one text, per group if given."""
    low = F.lower(text)
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains(F.col("low"), F.lit(a)) & F.contains(F.col("low"), F.lit(b)), F.lit(label))
                for a, b, label in pairs
            ]
        )
    )
    keep = [group] if group else []
    found = texts.select(*keep, low.alias("low")).select(*keep, F.explode(hits).alias("relation"))
    return found.distinct()


def dimension_report(dimensions: DataFrame) -> DataFrame:
    """The five classes with description, members and counts.

    ``dimensions`` holds one row per dimension (``name``, ``dimension_class``), so a
    class lists at most as many names as there are tables.
    """
    classes = literal_rows(
        dimensions.sparkSession,
        [{"dimension_class": c, "description": d} for c, d in DIMENSION_CLASSES.items()],
        "dimension_class string, description string",
    )
    members = dimensions.groupBy("dimension_class").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("dimensions"),
        F.count_distinct("name").alias("dimension_count"),
    )
    return classes.join(members, "dimension_class", "left").select(
        "dimension_class",
        "description",
        F.coalesce("dimensions", F.lit("")).alias("dimensions"),
        F.coalesce("dimension_count", F.lit(0)).alias("dimension_count"),
    )


def model_totals(dimensions: DataFrame, facts: DataFrame) -> DataFrame:
    """How many dimensions and fact tables there are."""
    return dimensions.agg(F.count_distinct("name").alias("total")).select(
        F.lit("dimensions").alias("kind"), "total"
    ).unionByName(
        facts.agg(F.count(F.lit(1)).alias("total")).select(F.lit("fact_tables").alias("kind"), "total")
    )


def database_summary(tables: DataFrame, database: str, database_type: str = "parquet") -> DataFrame:
    """One text for the catalog: header, a cut description per table, table list.

    ``tables`` has one row per table: ``table_name``, ``description``.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("table_name", text_summary(F.col("description")).alias("summary")))
    )
    lines = F.transform("t", lambda x: F.concat(F.lit("• "), x["table_name"], F.lit(": "), x["summary"], F.lit("\n")))
    names = F.transform("t", lambda x: F.concat(F.lit("• "), x["table_name"], F.lit("\n")))
    # The header and section lines of the summary.
    text = F.concat(
        F.lit(f"Database: {database} ({database_type})\nTotal Tables Analyzed: "),
        F.size("t"),
        F.lit("\n\nTable Summary:\n=============\n\n"),
        F.array_join(lines, ""),
        F.lit("\nTable List:\n===========\n"),
        F.array_join(names, ""),
    )
    return tables.agg(ordered.alias("t")).select(text.alias("summary"))
