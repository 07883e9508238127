import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shop_fixture import shop_catalog
from tabulight.operators import decisions, findings, hierarchy, keys, profile, star, validate, windows
from tabulight.plans import shop, understanding
from tabulight.sources.catalog import Catalog, ForeignKey, TableKeys


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return shop_catalog(spark, tmp_path_factory.mktemp("shop"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_usage_bands(catalog):
    bands = {}
    for name, _, band in rows(profile.usage_bands(profile.row_counts(catalog))):
        bands.setdefault(band, set()).add(name)
    assert bands["empty"] == {"shopping_carts", "returns"}
    assert bands["low"] == {
        "customer_addresses", "product_variants", "orders", "order_items", "payments", "shipments",
        "reviews", "coupons", "inventory_transactions",
    }
    assert bands[None] == {"customers", "products", "categories"}
    assert "high" not in bands


def test_customer_order_summary(catalog):
    found = {r[0]: r[3:] for r in rows(shop.customer_order_summary(catalog["customers"], catalog["orders"]))}
    assert len(found) == 10
    spent = {1: 39570, 2: 1376, 3: 36180, 4: 458, 5: 9762}
    for customer, (count, total, last) in found.items():
        assert count == (1 if customer in spent else 0)
        assert total == spent.get(customer, 0)
        assert (last is None) == (customer not in spent)


def test_cancelled_orders_keep_their_customer(catalog):
    orders = catalog["orders"].withColumn("status", F.lit("cancelled"))
    found = rows(shop.customer_order_summary(catalog["customers"], orders))
    assert len(found) == 10 and {r[3] for r in found} == {0}


def test_product_sales_summary(catalog):
    args = catalog["products"], catalog["order_items"], catalog["orders"]
    found = {r[0]: tuple(r[3:]) for r in rows(shop.product_sales_summary(*args))}
    sold = {1: (1, 1, 35900), 2: (1, 1, 32900), 4: (2, 3, 1350), 6: (2, 2, 17800), 9: (1, 1, 1200), 10: (1, 1, 5800)}
    assert found == {i: sold.get(i, (0, 0, 0)) for i in range(1, 11)}


def test_product_sales_counts_a_line_once_per_valid_order(catalog):
    orders = catalog["orders"].unionByName(catalog["orders"].filter("id = 1"))
    args = catalog["products"], catalog["order_items"], orders
    found = {r[0]: tuple(r[3:5]) for r in rows(shop.product_sales_summary(*args))}
    joined = (
        catalog["order_items"].join(orders.select(F.col("id").alias("order_id")), "order_id", "left")
        .groupBy("product_id").agg(F.count(F.lit(1)), F.sum("quantity")).collect()
    )
    assert {i: n for i, n in found.items() if n[0]} == {r[0]: (r[1], r[2]) for r in joined}


def test_product_sales_without_cancelled(catalog):
    orders = catalog["orders"].withColumn("status", F.when(F.col("id") == 1, "refunded").otherwise(F.col("status")))
    args = catalog["products"], catalog["order_items"], orders
    found = {r[0]: r[3] for r in rows(shop.product_sales_summary(*args, drop_invalid=True))}
    assert found[1] == 0 and found[10] == 0 and found[4] == 2


def test_reconcile_orders_with_items(catalog):
    stored = catalog["orders"].select(F.col("id").alias("order_id"), "subtotal")
    lines = catalog["order_items"].select("order_id", F.col("total").alias("amount"))
    found = {r[0]: r[1:] for r in rows(shop.reconcile(stored, lines, "order_id", "subtotal", "amount"))}
    assert found == {1: (36500, 41700), 2: (1200, 2100), 3: (33500, 41800), 4: (350, 450)}


def test_reconcile_customers_with_orders(catalog):
    stored = catalog["customers"].select(F.col("id").alias("customer_id"), "total_orders")
    lines = catalog["orders"].select("customer_id", F.lit(1).alias("one"))
    found = {r[0]: r[1:] for r in rows(shop.reconcile(stored, lines, "customer_id", "total_orders", "one"))}
    assert found == {5: (8, 1), 6: (5, 0), 7: (32, 0), 8: (2, 0), 9: (12, 0), 10: (4, 0)}


def test_stock_chain(catalog):
    moves = catalog["inventory_transactions"]
    assert rows(windows.continuity(moves, ["product_id"], "previous_quantity", "quantity", "new_quantity")) == []
    assert rows(windows.chain_breaks(moves, ["product_id"], ["id"], "previous_quantity", "new_quantity")) == []
    broken = moves.withColumn("previous_quantity", F.when(F.col("id") == 7, 190).otherwise(F.col("previous_quantity")))
    found = windows.chain_breaks(broken, ["product_id"], ["id"], "previous_quantity", "new_quantity")
    assert [r["id"] for r in found.collect()] == [7]


def test_category_tree(catalog):
    found = {r[0]: r[1:] for r in rows(hierarchy.tree_paths(catalog["categories"], "id", "parent_id", "name"))}
    assert sum(level == 1 for _, level, _ in found.values()) == 5
    assert found[6] == (1, 2, "electronics > phones")
    assert found[11] == (3, 2, "home > bedding")


RULES = [
    validate.not_null("customers", "email"),
    validate.UniqueRule("products", ("sku",)),
    validate.at_least("products", "price", 0),
    validate.between("reviews", "rating", 1, 5),
    validate.in_list("customers", "customer_type", ["regular", "premium", "vip"]),
    validate.above("order_items", "quantity", 0),
    validate.ReferenceRule("orders", "customer_id", "customers", "id"),
]


def test_constraints_hold(catalog):
    assert {r[2] for r in rows(validate.constraint_violations(catalog, RULES))} == {0}


def test_constraints_broken(catalog):
    first = F.col("id") == 1
    bad = catalog.with_table("customers", catalog["customers"].withColumn("email", F.when(~first, F.col("email"))))
    bad = bad.with_table(
        "products",
        catalog["products"]
        .withColumn("sku", F.when(first, "SKU-2").otherwise(F.col("sku")))
        .withColumn("price", F.when(first, -1).otherwise(F.col("price"))),
    )
    bad = bad.with_table("reviews", catalog["reviews"].withColumn("rating", F.when(first, 6).otherwise(F.col("rating"))))
    bad = bad.with_table("orders", catalog["orders"].withColumn("customer_id", F.when(first, 99).otherwise(F.col("customer_id"))))
    found = {r[1]: r[2] for r in rows(validate.constraint_violations(bad, RULES))}
    assert found == {
        "email not null": 1, "sku unique": 1, "price at least 0": 1, "rating in range": 1,
        "customer_type in list": 0, "quantity above 0": 0, "customer_id in customers.id": 1,
    }


@pytest.fixture(scope="module")
def issues(catalog):
    found = understanding.column_findings(catalog)
    return {(r["table_name"], r["column_name"]): r["issues"] for r in found.collect()}


def test_unused_columns(issues):
    unused = {c for c, names in issues.items() if "potentially_unused" in names}
    assert unused == {
        ("customers", "date_of_birth"), ("products", "images"), ("orders", "notes"), ("order_items", "variant_id"),
    }


def test_other_issues(issues):
    assert "potential_collection" in issues[("products", "tags")]
    assert "undefined_int" in issues[("products", "inventory_quantity")]
    assert ("products", "category_id") not in {c for c, n in issues.items() if "undefined_int" in n}
    # 3 types in 10 rows: not below a fifth of the rows, but a value list worth making.
    assert issues[("customers", "customer_type")] == ["value_collection_needed"]


def test_column_questions_follow_table_column_and_issue(spark, catalog):
    asked = findings.column_questions(understanding.column_findings(catalog)).orderBy("question_number").collect()
    assert [r["question_id"] for r in asked] == [f"q{i}" for i in range(1, len(asked) + 1)]
    assert [(r["table_name"], r["ordinal"]) for r in asked] == sorted((r["table_name"], r["ordinal"]) for r in asked)
    first = next(r for r in asked if r["column_name"] == "notes")
    assert first["question_type"] == "unused_column_check" and len(first["options"]) == 3
    assert "'orders'" in first["question"] and "'notes'" in first["question"]


def test_table_questions_and_decisions(spark, catalog):
    counts = profile.row_counts(catalog)
    asked = findings.table_questions(counts)
    by_table = {r["table_name"]: r for r in asked.collect()}
    assert len(by_table) == 11
    assert by_table["returns"]["question_id"] == "q1" and by_table["shopping_carts"]["question_id"] == "q2"
    assert " 5 " in by_table["orders"]["question"]
    replies = {"returns": "可以刪除", "shopping_carts": "保留（仍在使用）", "coupons": "merge with orders",
               "payments": "測試數據，可以清理", "orders": "DROP it"}
    answers = spark.createDataFrame(
        [(by_table[t]["question_id"], text) for t, text in replies.items()] + [("notes", "刪除"), ("q99", "刪除")],
        "question_id string, response string",
    )
    questions = asked.select("question_id", F.explode("related_tables").alias("table_name"))
    answered = decisions.answer_questions(questions, answers)
    decided = decisions.table_decisions(answered)
    assert {r["table_name"]: r["decision"] for r in decided.collect()} == {
        "returns": "drop", "shopping_carts": "keep", "coupons": "merge", "payments": "review", "orders": "drop",
    }
    assert dict(rows(decisions.decision_counts(decided))) == {"drop": 2, "keep": 1, "merge": 1, "review": 1}
    kept = {r[0] for r in rows(decisions.exclude_tables(counts, decided))}
    assert kept == set(catalog.names) - {"returns", "orders"}
    outcome = dict((r[0], r[2]) for r in rows(decisions.excluded_summary(counts, decided)))
    assert {t for t, o in outcome.items() if o == "excluded"} == {"returns", "orders"}
    assert set(decisions.apply_table_decisions(catalog, decided).names) == kept
    unmatched = decisions.answer_questions(questions, answers, keep_unmatched=True)
    assert unmatched.filter("table_name IS NULL").count() == 1


def test_column_decisions_routed_and_applied(spark, catalog):
    asked = findings.column_questions(understanding.column_findings(catalog))
    ids = {(r["table_name"], r["column_name"], r["question_type"]): r["question_id"] for r in asked.collect()}
    replies = {
        ("orders", "notes", "unused_column_check"): ("不再使用，可以移除", "remove", "none"),
        ("customers", "date_of_birth", "unused_column_check"): ("仍在使用", "review", "none"),
        ("products", "tags", "collection_check"): ("應該轉換為關聯表格", "convert", "items"),
        ("customers", "customer_type", "value_collection_check"): ("需要搜集值選項", "define", "options"),
        ("products", "inventory_quantity", "int_definition_check"): ("需要更好的定義", "define", "none"),
    }
    answers = spark.createDataFrame(
        [(ids[k], v[0]) for k, v in replies.items()], "question_id string, response string"
    )
    decided = decisions.column_decisions(decisions.answer_questions(asked, answers))
    found = {(r["table_name"], r["column_name"]): (r["decision"], r["value_list"]) for r in decided.collect()}
    assert found == {k[:2]: v[1:] for k, v in replies.items()}
    cleaned = understanding.clean_catalog(catalog, column_answers=answers)
    assert "notes" not in cleaned["orders"].columns and "tags" not in cleaned["products"].columns
    assert "date_of_birth" in cleaned["customers"].columns


def test_decisions_make_tables_and_prune_keys(spark):
    tags = spark.createDataFrame(
        [(1, ["a", "b"], "x;y", "red", 7), (2, None, "", "blue", 8), (3, [], "z", "red", 9)],
        "id int, tags array<string>, codes string, colour string, owner int",
    )
    owners = spark.createDataFrame([(7,), (8,), (9,)], "id int")
    to_owner = ForeignKey(("owner",), "owners", ("id",))
    made = Catalog(
        {"things": tags, "owners": owners, "keyless": tags},
        {"things": TableKeys(("id",), (to_owner,)), "owners": TableKeys(("id",))},
    )
    schema = "table_name string, column_name string, decision string, value_list string"
    decided = spark.createDataFrame(
        [
            ("things", "tags", "convert", "items"), ("things", "codes", "convert", "items"),
            ("things", "colour", "enum", "enum"), ("things", "owner", "remove", "none"),
            ("keyless", "tags", "convert", "items"), ("missing", "x", "remove", "none"),
        ],
        schema,
    )
    found = decisions.apply_column_decisions(made, decided)
    assert sorted(rows(found["things_tags_items"])) == [(1, 0, "a"), (1, 1, "b")]
    assert sorted(rows(found["things_codes_items"])) == [(1, 0, "x"), (1, 1, "y"), (3, 0, "z")]
    assert sorted(rows(found["things_colour_values"])) == [("blue", 1), ("red", 2)]
    assert found["things"].columns == ["id", "colour"] and "tags" in found["keyless"].columns
    assert found.keys["things"] == TableKeys(("id",)) and found.keys["things_tags_items"].foreign[0].ref_table == "things"
    dropped = spark.createDataFrame([("owners", "drop")], "table_name string, decision string")
    assert decisions.apply_table_decisions(made, dropped).keys == {"things": TableKeys(("id",))}


def test_enum_answers(spark):
    rows_in = [("enum_check", "枚舉值完整"), ("enum_check", "枚舉值不完整，需要補充"), ("enum_check", "需要進一步檢查")]
    answered = spark.createDataFrame(rows_in, "question_type string, response string")
    got = [(r["decision"], r["value_list"]) for r in decisions.column_decisions(answered).collect()]
    assert got == [("enum", "enum"), ("define", "enum"), ("review", "none")]


def test_answers_from_json(spark):
    df = spark.createDataFrame([('{"q1": "drop", "timestamp": "x", "notes": "y", "q2": "keep"}',)], "body string")
    assert rows(decisions.answers_from_json(df, "body")) == [("q1", "drop"), ("q2", "keep")]


def test_references_found(catalog):
    found = {(r[0], r[1], r[2]): r for r in rows(keys.discover_references(catalog))}
    assert ("order_items", "order_id", "orders") in found
    assert ("categories", "parent_id", "categories") in found
    assert ("order_items", "variant_id", "product_variants") in found
    assert found[("reviews", "product_id", "products")][-1] == "many_to_one"
    assert found[("payments", "order_id", "orders")][-1] == "one_to_one"


def test_references_across_number_types(spark):
    whole = spark.range(5).select(F.col("id").cast("bigint").alias("id"))
    for kind in ("decimal(10,2)", "double", "smallint", "decimal(38,19)"):
        things = whole.select(F.col("id").cast(kind).alias("owner_id"))
        made = Catalog({"owners": whole, "things": things})
        pair = keys.ReferencePair("things", "owner_id", "owners", "id")
        found = keys.reference_inclusion(made, [pair]).first()
        assert (found["matched_distinct"], found["inclusion"], found["orphan_rows"]) == (5, 1.0, 0), kind


def test_empty_tables_have_stats(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "full"))
    spark.range(0).write.parquet(str(tmp_path / "none"))
    made = Catalog({n: spark.read.parquet(str(tmp_path / n)) for n in ("full", "none")})
    found = {r["table_name"]: r for r in profile.table_stats(made).collect()}
    assert found["full"]["row_count"] == 3 and found["none"][1:] == (0, 0, 0)


def test_reference_orphans(catalog):
    items = catalog["order_items"].withColumn("order_id", F.when(F.col("id") < 3, 77).otherwise(F.col("order_id")))
    bad = catalog.with_table("order_items", items)
    found = {tuple(r)[:3]: r for r in keys.reference_inclusion(bad, keys.reference_pairs(bad)).collect()}
    pair = found[("order_items", "order_id", "orders")]
    assert (pair["orphan_rows"], pair["child_rows"]) == (2, 8) and pair["inclusion"] == 0.8


def test_declared_keys_verified(catalog):
    found = {(r[0], r[1]): r["is_key"] for r in keys.verify_declared_keys(catalog).collect()}
    assert found[("products", "sku")] and found[("orders", "id")] and all(found.values())
    twice = catalog.with_table("orders", catalog["orders"].unionAll(catalog["orders"]))
    found = {(r[0], r[1]): r["is_key"] for r in keys.verify_declared_keys(twice).collect()}
    assert not found[("orders", "id")] and found[("products", "sku")]


def test_model(spark, catalog):
    model = understanding.model_catalog(spark, catalog)
    areas = {r["table_name"]: r["area"] for r in model.areas.collect()}
    assert areas["customers"] == "customer_management" and areas["order_items"] == "order_management"
    assert areas["coupons"] == "marketing_promotion" and areas["shipments"] == "shipping_logistics"
    assert areas["returns"] == "other"
    assert rows(model.domain)[0][1].startswith("電商平台")
    facts = {r["source_table"]: r for r in model.facts.collect()}
    assert "total" in facts["order_items"]["measures"] and "orders" in facts["order_items"]["dimensions"]
    dims = {r["source_table"]: r["dimension_class"] for r in model.dimensions.collect()}
    assert dims["customers"] == "people" and dims["products"] == "product" and dims["orders"] == "event"
    assert sum(r["dimension_count"] for r in model.report.collect()) == len(dims)
    assert dict(rows(model.totals)) == {"dimensions": len(dims), "fact_tables": len(facts)}


def test_inventory_fact_and_promotions(catalog):
    found = {r[0]: tuple(r)[3:] for r in star.inventory_fact(catalog["inventory_transactions"], catalog["products"]).collect()}
    assert found[1] == (-1, Decimal("28000.00"), Decimal("-28000.00"))
    assert found[8] == (5, Decimal("5200.00"), Decimal("26000.00"))
    assert star.promotion_dimension(catalog["coupons"]).count() == 3


def test_sales_fact_profit(catalog):
    cost = catalog["products"].select(F.col("id").alias("product_id"), F.col("cost_price").cast("double").alias("unit"))
    items = catalog["order_items"].join(cost, "product_id").select(
        "order_id", F.col("id").alias("line_number"), "product_id", "quantity",
        F.col("total").cast("double").alias("amount"), F.lit(0.0).alias("discount"),
        (F.col("unit") * F.col("quantity")).alias("cost"),
    )
    orders = catalog["orders"].select(F.col("id").alias("order_id"), "customer_id", "ordered_at")
    found = {r["line_number"]: r for r in star.sales_fact(items, orders).collect()}
    assert found[1]["profit"] == 7900 and found[3]["profit"] == 540 and found[1]["date_key"] == 20240102


def test_last_month_of_sales(catalog):
    assert shop.monthly_sales(catalog["orders"], dt.date(2024, 2, 5)).first()["order_count"] == 2
    assert shop.monthly_sales(catalog["orders"], dt.date(2025, 1, 1)).count() == 0
