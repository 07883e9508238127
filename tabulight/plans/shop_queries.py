"""Registered queries over the sales tables: views, totals, trends, dimensions, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, masking, profile, star, windows
from . import guarded, shop
from .lake import open_lake, shop_tables
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamp(column: str):
    return F.date_format(column, STAMP).alias(column)


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value FROM events "
    "ORDER BY ts DESC NULLS FIRST, event_id LIMIT 5"
)
def sample_recent(spark, root):
    events = open_lake(spark, root, "events")["events"]
    rows = profile.sample_recent(events, 5, ("updated_at", "ts"), ["event_id"])
    return rows.select("event_id", _stamp("ts"), "user_id", "event_type", "value")


@query(
    "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders "
    "ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 100"
)
def sample_page(spark, root):
    orders = open_lake(spark, root, "orders")["orders"]
    rows = profile.sample_recent(orders, 50, ("o_orderdate",), ["o_orderkey"], offset=100)
    return rows.select("o_orderkey", "o_custkey", _stamp("o_orderdate"))


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS sku FROM part WHERE p_size > 10")
def active_filter(spark, root):
    return shop.active_products(shop_tables(spark, root)["products"]).select("id", "name", "sku")


@query(
    """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS email, count(o_orderkey) AS total_orders,
  coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS total_spent,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_order_date
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P'
GROUP BY c_custkey, c_name, c_mktsegment
"""
)
def customer_order_summary(spark, root):
    t = shop_tables(spark, root)
    found = shop.customer_order_summary(t["customers"], t["orders"])
    return found.withColumn("last_order_date", F.date_format("last_order_date", STAMP))


@query(
    """
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS sku, count(l_partkey) AS total_sold,
  coalesce(sum(l_quantity), 0)::DOUBLE AS total_quantity_sold,
  coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS total_revenue
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey
LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus NOT IN ('P')
GROUP BY p_partkey, p_name, p_brand
"""
)
def product_sales_summary(spark, root):
    t = shop_tables(spark, root)
    return shop.product_sales_summary(t["products"], t["order_items"], t["orders"])


@query(
    """
SELECT p_partkey AS product_id, p_name AS product_name, count(*) AS order_count,
  round(avg(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS avg_measure
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal BETWEEN 1000 AND 5000 GROUP BY p_partkey, p_name ORDER BY order_count DESC, p_partkey LIMIT 10
"""
)
def popular_products(spark, root):
    t = shop_tables(spark, root)
    return shop.popular_products(
        t["products"], t["order_items"], t["orders"], t["customers"], "balance", 1000, 5000
    )


@query(
    """
WITH s AS (SELECT l_partkey AS k, round(avg(l_quantity), 4) AS least FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS product_id, p_name AS product_name, p_size::DOUBLE AS current_stock, least AS min_stock_level,
  round(p_size - least, 4) AS shortage
FROM part JOIN s ON k = p_partkey WHERE p_size <= least
"""
)
def reorder_list(spark, root):
    t = shop_tables(spark, root)
    needed = t["order_items"].groupBy("product_id").agg(F.round(F.avg("quantity"), 4).alias("min_stock_level"))
    on_hand = t["products"].select(
        F.col("id").alias("product_id"), F.col("stock").cast("double").alias("current_stock")
    )
    return shop.reorder_list(t["products"], needed.join(on_hand, "product_id"))


@query(
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_sales, "
    "count(*) AS order_count FROM orders GROUP BY 1"
)
def monthly_sales(spark, root):
    return shop.monthly_sales(shop_tables(spark, root)["orders"])


@query(
    "SELECT c_custkey AS customer_id, c_name AS customer_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_orders "
    "FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name"
)
def customer_totals(spark, root):
    t = shop_tables(spark, root)
    return shop.customer_totals(t["customers"], t["orders"])


@query(
    "SELECT count(DISTINCT o_custkey) AS parents, count(o_custkey) AS children, "
    "round(count(o_custkey) / count(DISTINCT o_custkey), 6) AS ratio FROM orders"
)
def avg_orders_per_customer(spark, root):
    return shop.children_per_parent(shop_tables(spark, root)["orders"], "customer_id")


@query(
    """
WITH b AS (
  SELECT 'month' AS bucket, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice::DECIMAL(18,2) AS t FROM orders
  UNION ALL SELECT 'quarter', strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), o_totalprice::DECIMAL(18,2) FROM orders
  UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), o_totalprice::DECIMAL(18,2) FROM orders)
SELECT bucket, period, count(*) AS order_count, sum(t)::DOUBLE AS total_sales,
  round(sum(t)::DOUBLE / count(*), 4) AS avg_sales FROM b GROUP BY ALL
"""
)
def time_buckets(spark, root):
    return shop.time_buckets(shop_tables(spark, root)["orders"])


@query(
    """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_sales
           FROM orders GROUP BY 1),
l AS (SELECT *, lag(total_sales) OVER (ORDER BY month) AS before FROM m)
SELECT month, total_sales, round((total_sales - before) / nullif(before, 0), 6) AS growth FROM l
"""
)
def sales_growth(spark, root):
    return shop.sales_growth(shop_tables(spark, root)["orders"])


@query(
    """
WITH r AS (SELECT o_custkey AS customer_id, o_orderkey AS id, o_totalprice AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS row_number,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INT AS total_rank FROM orders)
SELECT * FROM r WHERE row_number <= 3
"""
)
def rank_per_group(spark, root):
    return shop.rank_per_group(shop_tables(spark, root)["orders"])


@query(
    """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity,
  sum(l_quantity) OVER w AS running_total, sum(l_quantity) OVER w - l_quantity AS previous_total
FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey,
  l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)
"""
)
def running_balance(spark, root):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
    items = open_lake(spark, root, "lineitem")["lineitem"].select("l_partkey", *order)
    return windows.running_total(items, ["l_partkey"], order, "l_quantity").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "running_total", "previous_total"
    )


@query(
    """
WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(18,2)) AS computed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, o_totalprice::DECIMAL(18,2)::DOUBLE AS stored_total,
  coalesce(computed, 0)::DOUBLE AS computed_total
FROM orders LEFT JOIN s ON k = o_orderkey
WHERE o_totalprice::DECIMAL(18,2) IS DISTINCT FROM coalesce(computed, 0)
"""
)
def reconcile_totals(spark, root):
    t = shop_tables(spark, root)
    stored = t["orders"].select(F.col("id").alias("order_id"), "total")
    lines = t["order_items"].select("order_id", F.col("total").alias("amount"))
    return shop.reconcile(stored, lines, "order_id", "total", "amount")


@query(
    """
WITH RECURSIVE nodes AS (
  SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS label FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
walk AS (
  SELECT node, node AS root, 1 AS level, label AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.node, w.root, w.level + 1, w.path || ' > ' || n.label FROM nodes n JOIN walk w ON n.parent = w.node)
SELECT node, root, level, path FROM walk
""",
    name="hierarchy",
)
def hierarchy_paths(spark, root):
    lake = open_lake(spark, root, "region", "nation", "supplier", "customer")

    def part(table, mark, key, up_mark, up, label):
        parent = F.concat(F.lit(up_mark), up) if up else F.lit(None).cast("string")
        return lake[table].select(
            F.concat(F.lit(mark), key).alias("node"), parent.alias("parent"), F.col(label).alias("label")
        )

    nodes = profile.union_all(
        [
            part("region", "r", "r_regionkey", None, None, "r_name"),
            part("nation", "n", "n_nationkey", "r", "n_regionkey", "n_name"),
            part("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_name"),
            part("customer", "c", "c_custkey", "n", "c_nationkey", "c_name"),
        ]
    )
    return hierarchy.tree_paths(nodes, "node", "parent", "label")


@query(
    "SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS total FROM orders "
    "WHERE year(o_orderdate) = 1998 AND o_totalprice > 10000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"
)
def basic_query(spark, root):
    return shop.basic_query(shop_tables(spark, root)["orders"], 1998, 10000, limit=20, offset=40)


CUSTOMERS_SQL = (
    "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey"
)


@query(CUSTOMERS_SQL + " LIMIT 50")
def capped_query(spark, root):
    open_lake(spark, root, "orders").register()
    return guarded.capped_query(spark, CUSTOMERS_SQL)


@query(f"SELECT least(count(*), 100) AS row_count, count(*) > 100 AS truncated FROM ({CUSTOMERS_SQL})")
def capped_query_flag(spark, root):
    open_lake(spark, root, "orders").register()
    return guarded.query_outcome(spark, CUSTOMERS_SQL)


@query(
    """
WITH q AS (SELECT event_id, CASE event_type
  WHEN 'view' THEN 'SELECT * FROM events WHERE event_id = ' || event_id
  WHEN 'click' THEN '  select value from events; DROP TABLE events'
  WHEN 'purchase' THEN 'DELETE FROM events WHERE event_id = ' || event_id
  WHEN 'signup' THEN 'SELECT drop_date, ''drop'' FROM events' || chr(10) || 'WHERE user_id = ' || user_id
  ELSE 'WITH x AS (SELECT 1) SELECT [update] FROM x' END AS text FROM events),
w AS (SELECT event_id, text, list_filter(list_transform(regexp_split_to_array(upper(text), '\\s+'),
  lambda t: trim(t, '.,;()[]')), lambda t: t IN ('DROP', 'DELETE', 'UPDATE', 'INSERT', 'ALTER', 'CREATE',
  'TRUNCATE', 'EXEC', 'EXECUTE', 'MERGE', 'BULK', 'BACKUP', 'RESTORE')) AS bad FROM q)
SELECT event_id, upper(trim(text)) LIKE 'SELECT%' AND len(bad) = 0 AS is_safe, bad[1] AS forbidden_word FROM w
"""
)
def sql_audit(spark, root):
    kind, event = F.col("event_type"), F.col("event_id")
    text = (
        F.when(kind == "view", F.concat(F.lit("SELECT * FROM events WHERE event_id = "), event))
        .when(kind == "click", F.lit("  select value from events; DROP TABLE events"))
        .when(kind == "purchase", F.concat(F.lit("DELETE FROM events WHERE event_id = "), event))
        .when(kind == "signup", F.concat(F.lit("SELECT drop_date, 'drop' FROM events\nWHERE user_id = "), "user_id"))
        .otherwise(F.lit("WITH x AS (SELECT 1) SELECT [update] FROM x"))
    )
    log = open_lake(spark, root, "events")["events"].select("event_id", text.alias("query_text"))
    return guarded.audit_queries(log, "query_text").drop("query_text")


@query(
    """
SELECT c_custkey, sha256(c_name) AS name, '***@example.com' AS email,
  repeat('*', length(phone) - 4) || right(phone, 4) AS phone, '***' AS api_token, c_acctbal
FROM (SELECT *, '+886-9' || lpad(c_custkey::VARCHAR, 8, '0') AS phone FROM customer)
"""
)
def mask_columns(spark, root):
    people = open_lake(spark, root, "customer")["customer"].select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+886-9"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
        F.concat(F.lit("tok-"), "c_custkey").alias("api_token"),
        "c_acctbal",
    )
    return masking.mask_columns(people)


@query(
    "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name"
)
def dedupe_first(spark, root):
    part = open_lake(spark, root, "part")["part"].select("p_name", "p_partkey", "p_brand")
    return windows.dedupe_first(part, ["p_name"], ["p_partkey"])


@query(
    "SELECT c_custkey AS customer_key, c_name AS customer_name, c_mktsegment AS segment, n_name AS nation, "
    "r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def dim_customer(spark, root):
    lake = open_lake(spark, root, "customer", "nation", "region")
    places = lake["nation"].join(lake["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return lake["customer"].join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
    )


@query(
    "SELECT p_partkey AS product_key, p_name AS product_name, p_brand AS brand, p_type AS category, "
    "p_retailprice AS price FROM part"
)
def dim_product(spark, root):
    return open_lake(spark, root, "part")["part"].select(
        F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"),
    )


@query(
    """
WITH b AS (SELECT min(d) AS low, max(d) AS high FROM
  (SELECT o_orderdate::DATE AS d FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem UNION ALL SELECT ts::DATE FROM events)),
s AS (SELECT unnest(generate_series(low::TIMESTAMP, high::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM b)
SELECT strftime(d, '%Y%m%d')::INT AS date_key, strftime(d, '%Y-%m-%d') AS day, year(d)::INT AS year,
  quarter(d)::INT AS quarter, month(d)::INT AS month, day(d)::INT AS day_of_month, (isodow(d) - 1)::INT AS weekday,
  isodow(d) >= 6 AS is_weekend FROM s
"""
)
def dim_date(spark, root):
    lake = open_lake(spark, root, "orders", "lineitem", "events")
    return star.date_dimension(
        [(lake["orders"], "o_orderdate"), (lake["lineitem"], "l_shipdate"), (lake["events"], "ts")]
    )


@query(
    "SELECT n_nationkey AS location_key, n_name AS nation, r_name AS region, "
    "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def dim_location(spark, root):
    lake = open_lake(spark, root, "nation", "region", "customer")
    counts = lake["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return (
        lake["nation"]
        .join(lake["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("n_nationkey").alias("location_key"), F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"), F.coalesce("customers", F.lit(0)).alias("customers"),
        )
    )


@query(
    """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, o_custkey AS customer_id, l_partkey AS product_id,
  strftime(o_orderdate, '%Y%m%d')::INT AS date_key, l_quantity AS quantity, l_extendedprice AS amount,
  round(l_extendedprice * l_discount, 4) AS discount_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
)
def fact_sales(spark, root):
    lake = open_lake(spark, root, "lineitem", "orders")
    items = lake["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("discount"),
    )
    orders = lake["orders"].select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("ordered_at"),
    )
    return star.sales_fact(items, orders).drop("profit")


@query(
    """
SELECT user_id AS customer_id, strftime(ts, '%Y%m%d')::INT AS date_key, count(*) AS event_count,
  count_if(event_type = 'view') AS page_views, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS dwell_seconds
FROM events GROUP BY 1, 2
"""
)
def fact_customer_behavior(spark, root):
    events = open_lake(spark, root, "events")["events"]
    return star.customer_behavior_fact(events, "user_id", "ts", "event_type")
