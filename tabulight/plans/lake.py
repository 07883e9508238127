"""The test lake: its tables, keys and derived columns, as the registered queries use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, ForeignKey, TableKeys, read_catalog

# Columns with Spark types, in table order.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
NAMES = tuple(COLUMNS)


def _fk(column: str, table: str, ref: str) -> ForeignKey:
    return ForeignKey((column,), table, (ref,))


KEYS = {
    "region": TableKeys(("r_regionkey",)),
    "nation": TableKeys(("n_nationkey",), (_fk("n_regionkey", "region", "r_regionkey"),)),
    "customer": TableKeys(("c_custkey",), (_fk("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": TableKeys(("s_suppkey",), (_fk("s_nationkey", "nation", "n_nationkey"),)),
    "part": TableKeys(("p_partkey",)),
    "orders": TableKeys(("o_orderkey",), (_fk("o_custkey", "customer", "c_custkey"),)),
    "lineitem": TableKeys(
        (),
        (
            _fk("l_orderkey", "orders", "o_orderkey"),
            _fk("l_partkey", "part", "p_partkey"),
            _fk("l_suppkey", "supplier", "s_suppkey"),
        ),
    ),
    "events": TableKeys(("event_id",)),
    "documents": TableKeys(("doc_id",)),
    "embeddings": TableKeys(("vec_id",)),
    "pages": TableKeys(("page_id",)),
    "benchmark": TableKeys(("item_id",)),
    "labels": TableKeys(("doc_id",), (_fk("doc_id", "documents", "doc_id"),)),
    "conversations": TableKeys(("conv_id", "turn")),
}
KEY_SETS = {"conversations": [("conv_id", "turn")], "lineitem": [("l_orderkey", "l_linenumber")]}


def open_lake(spark: SparkSession, root: str, *names: str) -> Catalog:
    """The named tables (all if none), with their known columns and keys."""
    wanted = names or NAMES
    keys = {n: KEYS[n] for n in wanted}
    return read_catalog(spark, root, wanted, keys, schemas={n: COLUMNS[n] for n in wanted})


def survey_lake(spark: SparkSession, root: str) -> Catalog:
    """All tables, orders with a mostly empty note and parts with a list of tags."""
    lake = open_lake(spark, root)
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    orders = lake["orders"].withColumn("o_note", F.when(urgent, F.lit("call first")))
    part = lake["part"].withColumn("p_tags", F.translate("p_name", " ", ","))
    return lake.with_table("orders", orders).with_table("part", part)


def aged_lake(spark: SparkSession, root: str) -> Catalog:
    """All tables and an archive of events before 2000, which is empty."""
    lake = open_lake(spark, root)
    archive = lake["events"].filter(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return lake.with_table("events_archive", archive)


def shop_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The lake's sales tables under the shop model's names; status P counts as cancelled."""
    lake = open_lake(spark, root, "customer", "orders", "lineitem", "part")
    c, o, li, p = (lake[n] for n in ("customer", "orders", "lineitem", "part"))
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("delivered")
    return {
        "customers": c.select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("email"), F.col("c_acctbal").alias("balance"),
        ),
        "orders": o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), status.alias("status"),
            F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("ordered_at"),
        ),
        "order_items": li.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total"),
        ),
        "products": p.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("sku"),
            (F.col("p_size") > 10).alias("is_active"), F.col("p_size").alias("stock"),
        ),
    }
