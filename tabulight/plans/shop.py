"""Queries over a shop's tables: views, totals, trends, stock and reconciliation.

Column names follow a small shop model: customers(id, name, email), orders(id,
customer_id, status, total, ordered_at), order_items(order_id, product_id, quantity,
total), products(id, name, sku, is_active). Sums of money are made in decimals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONEY = "decimal(18,2)"


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def money_sum(column: str | Column) -> Column:
    """An exact sum of money, as a double."""
    return F.sum(money(column)).cast("double")


def active_products(products: DataFrame) -> DataFrame:
    return products.filter("is_active")


def customer_order_summary(customers: DataFrame, orders: DataFrame, cancelled: str = "cancelled") -> DataFrame:
    """Every customer with count, sum and last date of orders that are not cancelled.

    The status test belongs to the join, so customers without such orders stay. Orders
    are summed per customer before the join: a large customer is one row there.
    """
    per_customer = (
        orders.filter(F.col("status") != cancelled)
        .groupBy("customer_id")
        .agg(
            F.count("id").alias("total_orders"),
            money_sum("total").alias("total_spent"),
            F.max("ordered_at").alias("last_order_date"),
        )
    )
    people = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), "email")
    return people.join(per_customer, "customer_id", "left").select(
        "customer_id",
        "customer_name",
        "email",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"),
        "last_order_date",
    )


def product_sales_summary(
    products: DataFrame, order_items: DataFrame, orders: DataFrame, drop_invalid: bool = False
) -> DataFrame:
    """Every product with its lines, quantity and revenue.

    As shipped, the order status sits on a second left join: lines of cancelled and
    refunded orders stay, and a line counts once for each valid order of its id. With
    ``drop_invalid``, only lines of valid orders count. Orders are counted per id
    before the join, so a repeated id multiplies no rows.
    """
    valid = (
        orders.filter(~F.col("status").isin("cancelled", "refunded"))
        .groupBy(F.col("id").alias("order_id"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    joined = order_items.join(valid, "order_id", "inner" if drop_invalid else "left")
    lines = joined.withColumn("times", F.coalesce("times", F.lit(1)))
    per_product = lines.groupBy("product_id").agg(
        F.sum("times").alias("total_sold"),
        F.sum(F.col("quantity") * F.col("times")).alias("total_quantity_sold"),
        F.sum(money("total") * F.col("times")).cast("double").alias("total_revenue"),
    )
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku")
    return named.join(per_product, "product_id", "left").select(
        "product_id",
        "product_name",
        "sku",
        F.coalesce("total_sold", F.lit(0)).alias("total_sold"),
        F.coalesce("total_quantity_sold", F.lit(0)).alias("total_quantity_sold"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
    )


def popular_products(
    products: DataFrame,
    order_items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    measure: str,
    low: float,
    high: float,
    n: int = 10,
) -> DataFrame:
    """Products most ordered by customers whose ``measure`` lies in a range.

    Lines are counted per product before product names are joined.
    """
    group = customers.filter(F.col(measure).between(low, high)).select(
        F.col("id").alias("customer_id"), F.col(measure).alias("measure")
    )
    bought = orders.select(F.col("id").alias("order_id"), "customer_id").join(group, "customer_id")
    per_product = (
        order_items.select("order_id", "product_id")
        .join(bought, "order_id")
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.round(F.avg(money("measure")).cast("double"), 2).alias("avg_measure"),
        )
    )
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (
        per_product.join(named, "product_id")
        .select("product_id", "product_name", "order_count", "avg_measure")
        .orderBy(F.col("order_count").desc(), "product_id")
        .limit(n)
    )


def reorder_list(products: DataFrame, stock: DataFrame) -> DataFrame:
    """Products at or below their least stock, most urgent first."""
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return (
        stock.filter(F.col("current_stock") <= F.col("min_stock_level"))
        .join(named, "product_id")
        .select(
            "product_id",
            "product_name",
            "current_stock",
            "min_stock_level",
            F.round(F.col("current_stock") - F.col("min_stock_level"), 4).alias("shortage"),
        )
        .orderBy("shortage", "product_id")
    )


def monthly_sales(orders: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Sales and orders per month; with ``as_of``, only the month up to that day."""
    if as_of is not None:
        orders = orders.filter(F.col("ordered_at") >= F.add_months(F.lit(as_of), -1))
    return (
        orders.groupBy(F.date_format("ordered_at", "yyyy-MM").alias("month"))
        .agg(money_sum("total").alias("total_sales"), F.count(F.lit(1)).alias("order_count"))
    )


def customer_totals(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with the sum of their orders, largest first; null without orders."""
    sums = orders.groupBy("customer_id").agg(money_sum("total").alias("total_orders"))
    people = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    return (
        people.join(sums, "customer_id", "left")
        .orderBy(F.col("total_orders").desc_nulls_last(), "customer_id")
    )


def children_per_parent(children: DataFrame, parent_column: str) -> DataFrame:
    """Average rows per distinct parent."""
    per_parent = children.filter(F.col(parent_column).isNotNull()).groupBy(parent_column).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_parent.agg(
        F.count(F.lit(1)).alias("parents"),
        F.sum("n").alias("children"),
        F.round(F.avg("n"), 6).alias("ratio"),
    )


def time_buckets(orders: DataFrame) -> DataFrame:
    """Count, sum and average per month, quarter and year.

    Rows are reduced to months once; quarters and years are made from the months.
    """
    months = orders.groupBy(
        F.year("ordered_at").alias("year"), F.month("ordered_at").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(money("total")).alias("total"))
    labels = F.array(
        F.struct(F.lit("month").alias("bucket"), F.format_string("%04d-%02d", "year", "month").alias("period")),
        F.struct(
            F.lit("quarter").alias("bucket"),
            F.format_string("%04d-Q%d", F.col("year"), F.ceil(F.col("month") / 3)).alias("period"),
        ),
        F.struct(F.lit("year").alias("bucket"), F.format_string("%04d", "year").alias("period")),
    )
    return (
        months.select("n", "total", F.inline(labels))
        .groupBy("bucket", "period")
        .agg(F.sum("n").alias("order_count"), F.sum("total").cast("double").alias("total_sales"))
        .withColumn("avg_sales", F.round(F.col("total_sales") / F.col("order_count"), 4))
    )


def sales_growth(orders: DataFrame) -> DataFrame:
    """Month-over-month change; the window runs over one row per month."""
    before = F.lag("total_sales").over(Window.orderBy("month"))
    return monthly_sales(orders).select(
        "month",
        "total_sales",
        F.round((F.col("total_sales") - before) / F.when(before != 0, before), 6).alias("growth"),
    )


def rank_per_group(orders: DataFrame, n: int = 3) -> DataFrame:
    """The largest orders of each customer, with ``row_number`` and ``rank``.

    Spark keeps n rows per customer in each task before the shuffle.
    """
    by_total = Window.partitionBy("customer_id").orderBy(F.col("total").desc(), "id")
    ties = Window.partitionBy("customer_id").orderBy(F.col("total").desc())
    return (
        orders.select("customer_id", "id", "total")
        .withColumn("row_number", F.row_number().over(by_total))
        .filter(F.col("row_number") <= n)
        .withColumn("total_rank", F.rank().over(ties))
    )


def reconcile(
    parents: DataFrame, children: DataFrame, key: str, stored: str, amount: str
) -> DataFrame:
    """Stored totals that differ from the sum of their children (no children: 0).

    ``parents`` has ``key`` and ``stored``; ``children`` has ``key`` and ``amount``.
    """
    sums = children.groupBy(key).agg(F.sum(money(amount)).alias("computed"))
    both = parents.join(sums, key, "left").select(
        key,
        money(stored).alias("stored"),
        F.coalesce("computed", F.lit(0).cast(MONEY)).alias("computed"),
    )
    return both.filter(~F.col("stored").eqNullSafe(F.col("computed"))).select(
        key,
        F.col("stored").cast("double").alias("stored_total"),
        F.col("computed").cast("double").alias("computed_total"),
    )


def basic_query(orders: DataFrame, year: int, least: float, limit: int, offset: int = 0) -> DataFrame:
    """One page of the orders of a year over an amount, largest first."""
    low, high = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    at = F.col("ordered_at")
    page = (
        orders.filter((at >= F.lit(low).cast(orders.schema["ordered_at"].dataType)))
        .filter(at < F.lit(high).cast(orders.schema["ordered_at"].dataType))
        .filter(F.col("total") > least)
        .select("id", "customer_id", "total")
        .orderBy(F.col("total").desc(), "id")
    )
    return page.offset(offset).limit(limit) if offset else page.limit(limit)
