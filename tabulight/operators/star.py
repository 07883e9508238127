"""Star schema: detect dimensions and facts, and build them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import dimension_class


def _singular() -> Column:
    name = F.col("table_name")
    return F.regexp_replace(F.regexp_replace(name, "ies$", "y"), "(?<!s)s$", "")


# What a caller's rule can make of a column; ``class:…`` names the class of the column's table.
ROLES = ("key", "attribute", "measure", "ignore")


def column_roles(columns: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Column rows with the ``role`` and table ``class`` that a caller's rules give them, null where none does.

    ``rules`` has ``priority, table_pattern, column_pattern, role``; patterns are searched
    in the names, and the matching rule of the lowest priority decides, roles and classes
    each on their own. Rules are written by a person, so they travel as one constant.
    """
    rows = [] if rules is None else [tuple(r) for r in rules.select("priority", "table_pattern", "column_pattern", "role").orderBy("priority", "role").collect()]
    unknown = sorted({r[3] for r in rows if r[3] not in ROLES and not r[3].startswith("class:")})
    if unknown:
        raise ValueError(f"unknown roles: {', '.join(unknown)}")

    def first(matching: list[tuple]) -> Column:
        found = F.lit(None).cast("string")
        for _, table, column, role in reversed(matching):
            hit = F.col("table_name").rlike(table) & F.col("column_name").rlike(column)
            found = F.when(hit, F.lit(role)).otherwise(found)
        return found

    classes = [r for r in rows if r[3].startswith("class:")]
    return columns.withColumn("role", first([r for r in rows if r not in classes])).withColumn(
        "class", F.regexp_replace(first(classes), "^class:", "")
    )


def detect_dimensions(
    columns: DataFrame, keys: DataFrame, declared: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """Tables with a key and something that describes it, classified.

    ``columns`` are column descriptors, ``keys`` rows of ``table_name, key_columns`` that
    hold in the data, ``declared`` rows of ``declared_constraints``, ``rules`` a caller's
    rules (see ``column_roles``); all have few rows per column of the catalog. A table's
    key is, in this order, the columns that rules call its key, its declared primary key
    if that holds, its first column of unique numbers or times; free text is no key
    unless declared or called one. Attributes are its other texts and what rules call so.
    """
    ruled = column_roles(columns, rules)
    by_rule = ruled.filter("role = 'key'").groupBy("table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("ruled_key")
    )
    single = (
        keys.select("table_name", F.col("key_columns").alias("column_name"))
        .join(ruled.filter("family IN ('number', 'time') AND coalesce(role, '') <> 'ignore'"), ["table_name", "column_name"])
        .groupBy("table_name").agg(F.array(F.min_by("column_name", F.struct(F.col("family") != "number", "ordinal"))).alias("found_key"))
    )
    tables = ruled.groupBy("table_name").agg(F.first("class", ignorenulls=True).alias("class")).join(by_rule, "table_name", "left").join(single, "table_name", "left")
    if declared is not None:
        primary = declared.filter("kind = 'primary'").select("table_name", F.col("columns").alias("declared_key"))
        primary = primary.withColumn("key_columns", F.array_join("declared_key", ","))
        tables = tables.join(primary.join(keys.select("table_name", "key_columns").distinct(), ["table_name", "key_columns"]), "table_name", "left")
    else:
        tables = tables.withColumn("declared_key", F.lit(None).cast("array<string>"))
    describing = F.when(F.col("role").isNull(), F.col("family") == "text").otherwise(F.col("role") == "attribute")
    texts = ruled.filter(describing).groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("texts"))
    name = F.concat(F.lit("dim_"), _singular())
    listed = F.concat(F.lit("Attributes of "), "table_name", F.lit(": "), F.array_join("attributes", ", "))
    return (
        tables.withColumn("key_fields", F.coalesce("ruled_key", "declared_key", "found_key"))
        .filter("key_fields IS NOT NULL")
        .join(texts, "table_name")
        .withColumn("attributes", F.array_except("texts", "key_fields"))
        .filter(F.size("attributes") > 0)
        .withColumn("name", name)
        .withColumn("description", listed)
        .withColumn("dimension_class", F.coalesce("class", dimension_class(F.col("name"), F.lit(""))))
        .withColumn("business_use", F.concat(F.lit("Group facts by "), _singular()))
        .select(
            "name", "dimension_class", "description", F.col("table_name").alias("source_table"),
            "key_fields", "attributes", "business_use",
        )
    )


def detect_facts(columns: DataFrame, keys: DataFrame, references: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Tables with at least two references and a numeric measure that is in no key.

    A caller's rules (see ``column_roles``) add measures and leave columns out.
    """
    ruled = column_roles(columns, rules)
    dims = references.groupBy(F.col("child_table").alias("table_name")).agg(
        F.array_sort(F.collect_set("parent_table")).alias("dimensions"),
        F.collect_set("child_column").alias("reference_columns"),
    )
    key_parts = keys.groupBy("table_name").agg(
        F.flatten(F.collect_set(F.split("key_columns", ","))).alias("key_parts")
    )
    measured = F.when(F.col("role").isNull(), F.col("family") == "number").otherwise(F.col("role") == "measure")
    numbers = ruled.filter(measured).groupBy("table_name").agg(
        F.array_sort(F.collect_set("column_name")).alias("numbers"),
        F.collect_set(F.when(F.col("role") == "measure", F.col("column_name"))).alias("chosen"),
    )
    none = F.array().cast("array<string>")
    plain = F.array_except(F.array_except("numbers", "reference_columns"), F.coalesce("key_parts", none))
    measures = F.array_sort(F.array_union(plain, "chosen"))
    return (
        dims.filter(F.size("reference_columns") >= 2)
        .join(numbers, "table_name")
        .join(key_parts, "table_name", "left")
        .withColumn("measures", measures)
        .filter(F.size("measures") > 0)
        .select(
            F.concat(F.lit("fact_"), _singular()).alias("name"),
            F.concat(F.lit("Measures of "), "table_name").alias("description"),
            F.col("table_name").alias("source_table"),
            "measures",
            "dimensions",
        )
    )


def date_dimension(bounds: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """All days from the first to the last date in the given columns, with their parts.

    Each column gives a minimum and a maximum; the days come from a sequence.
    """
    ends = None
    for df, column in bounds:
        day = F.col(column).cast("date")
        one = df.agg(F.min(day).alias("low"), F.max(day).alias("high"))
        ends = one if ends is None else ends.unionByName(one)
    span = ends.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    days = span.select(F.explode(F.sequence("low", "high")).alias("day"))
    return days.select(
        F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"),
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        F.dayofmonth("day").alias("day_of_month"),
        F.weekday("day").alias("weekday"),
        (F.weekday("day") >= 5).alias("is_weekend"),
    )


def date_key(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd").cast("int")


def sales_fact(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order item: keys, quantity, amount, discount, profit where cost is known.

    ``items``: order_id, line_number, product_id, quantity, amount, discount[, cost];
    ``orders``: order_id, customer_id, ordered_at. The one join is on the order; tables
    bucketed by order_id are joined without a shuffle.
    """
    joined = items.join(orders, "order_id")
    cost = F.col("cost") if "cost" in items.columns else F.lit(None).cast("double")
    return joined.select(
        "order_id",
        "line_number",
        "customer_id",
        "product_id",
        date_key(F.col("ordered_at")).alias("date_key"),
        "quantity",
        "amount",
        F.round(F.col("amount") * F.col("discount"), 4).alias("discount_amount"),
        F.round(F.col("amount") * (1 - F.col("discount")) - cost, 4).alias("profit"),
    )


def inventory_fact(changes: DataFrame, products: DataFrame) -> DataFrame:
    """One row per stock change: quantity, unit cost, value."""
    cost = products.select(F.col("id").alias("product_id"), F.col("cost_price").alias("unit_cost"))
    return changes.join(cost, "product_id", "left").select(
        F.col("id").alias("change_id"),
        "product_id",
        "transaction_type",
        "quantity",
        "unit_cost",
        (F.col("quantity") * F.col("unit_cost")).alias("total_value"),
    )


def customer_behavior_fact(events: DataFrame, user: str, at: str, kind: str, view: str = "view") -> DataFrame:
    """Events, page views and dwell seconds per customer and day.

    Dwell within a day, the sum of gaps between neighbouring events, is the last time
    minus the first, so a plain aggregate does and no customer's events are sorted.
    """
    day = F.col(at).cast("date")
    return (
        events.groupBy(F.col(user).alias("customer_id"), day.alias("day"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col(kind) == view).alias("page_views"),
            (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))).alias("span"),
        )
        .select(
            "customer_id",
            F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"),
            "event_count",
            "page_views",
            F.expr("span div 1000000").alias("dwell_seconds"),
        )
    )


def promotion_dimension(coupons: DataFrame) -> DataFrame:
    """One row per coupon."""
    return coupons.select(
        F.col("id").alias("promotion_key"), "code", "name", "discount_type", "discount_value",
        "minimum_amount", "starts_at", "expires_at", "is_active",
    )


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """Save as a table bucketed and sorted by its join key, so later joins need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
