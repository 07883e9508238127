"""A small shop: 14 tables whose keys, amounts and states give known answers."""

from decimal import Decimal as D

from tabulight.sources.catalog import Catalog, ForeignKey, TableKeys

T0 = "timestamp'2024-01-01 00:00:00'"


def _fk(column, table):
    return ForeignKey((column,), table, ("id",))


KEYS = {
    "customers": TableKeys(("id",), (), (("email",),)),
    "customer_addresses": TableKeys(("id",), (_fk("customer_id", "customers"),)),
    "categories": TableKeys(("id",), (_fk("parent_id", "categories"),), (("name",),)),
    "products": TableKeys(("id",), (_fk("category_id", "categories"),), (("sku",),)),
    "product_variants": TableKeys(("id",), (_fk("product_id", "products"),), (("sku",),)),
    "orders": TableKeys(("id",), (_fk("customer_id", "customers"),), (("order_number",),)),
    "order_items": TableKeys(
        ("id",),
        (_fk("order_id", "orders"), _fk("product_id", "products"), _fk("variant_id", "product_variants")),
    ),
    "shopping_carts": TableKeys(("id",), (_fk("customer_id", "customers"),)),
    "payments": TableKeys(("id",), (_fk("order_id", "orders"),)),
    "shipments": TableKeys(("id",), (_fk("order_id", "orders"),)),
    "returns": TableKeys(("id",), (_fk("order_id", "orders"),)),
    "coupons": TableKeys(("id",), (), (("code",),)),
    "reviews": TableKeys(("id",), (_fk("product_id", "products"), _fk("customer_id", "customers"))),
    "inventory_transactions": TableKeys(("id",), (_fk("product_id", "products"),)),
}


def shop_catalog(spark, folder) -> Catalog:
    """The shop, written to ``folder`` as one Parquet file per table and read back."""
    tables = shop_frames(spark)
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    return Catalog({name: spark.read.parquet(f"{folder}/{name}") for name in tables}, KEYS, "shop")


def shop_frames(spark) -> dict:
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    stored = [(1, "39570"), (1, "1376"), (1, "36180"), (1, "458"), (8, "8500"), (5, "2200"), (32, "52000"),
              (2, "750"), (12, "15600"), (4, "1800")]
    types = ["premium", "regular", "vip", "regular", "premium", "regular", "vip", "regular", "premium", "regular"]
    customers = frame(
        [
            (i, f"user{i}@mail.test", f"Person {i}", None, types[i - 1], n, D(spent))
            for i, (n, spent) in enumerate(stored, start=1)
        ],
        "id int, email string, name string, date_of_birth date, customer_type string, total_orders int, "
        "total_spent decimal(10,2)",
    )
    addresses = frame(
        [(1, 1, "shipping", "A"), (2, 1, "billing", "A"), (3, 2, "shipping", "B"), (4, 3, "shipping", "C"),
         (5, 4, "shipping", "D"), (6, 5, "shipping", "E")],
        "id int, customer_id int, address_type string, city string",
    )
    categories = frame(
        [(1, "electronics", None), (2, "clothes", None), (3, "home", None), (4, "books", None), (5, "sport", None),
         (6, "phones", 1), (7, "laptops", 1), (8, "men", 2), (9, "women", 2), (10, "kitchen", 3), (11, "bedding", 3)],
        "id int, name string, parent_id int",
    )
    prices = [("35900", 28000, 49), ("32900", 26000, 29), ("89900", 75000, 20), ("450", 180, 197), ("480", 200, 150),
              ("8900", 5200, 29), ("12800", 6800, 15), ("680", 250, 100), ("1200", 450, 79), ("5800", 3200, 59)]
    areas = [6, 6, 7, 8, 9, 10, 11, 4, 5, 6]
    products = frame(
        [
            (i, f"SKU-{i}", f"product {i}", areas[i - 1], D(price), D(cost), stock, True, ["new", f"tag{i}"], None)
            for i, (price, cost, stock) in enumerate(prices, start=1)
        ],
        "id int, sku string, name string, category_id int, price decimal(10,2), cost_price decimal(10,2), "
        "inventory_quantity int, is_active boolean, tags array<string>, images string",
    )
    variants = frame(
        [(1, 1, "SKU-1-BLK", "black"), (2, 1, "SKU-1-BLU", "blue"), (3, 1, "SKU-1-WHT", "white")],
        "id int, product_id int, sku string, option1 string",
    )
    order_rows = [(1, "delivered", "36500", "2920", "150", "39570"), (2, "shipped", "1200", "96", "80", "1376"),
                  (3, "processing", "33500", "2680", "0", "36180"), (4, "confirmed", "350", "28", "80", "458"),
                  (5, "pending", "8900", "712", "150", "9762")]
    orders = frame(
        [
            (i, f"ORD-{i}", i, status, D(sub), D(tax), D(ship), D(total), None)
            for i, status, sub, tax, ship, total in order_rows
        ],
        "id int, order_number string, customer_id int, status string, subtotal decimal(10,2), "
        "tax_amount decimal(10,2), shipping_amount decimal(10,2), total decimal(10,2), notes string",
    ).selectExpr("*", f"{T0} + make_interval(0, 0, 0, id) AS ordered_at", f"{T0} AS created_at")
    items = frame(
        [(1, 1, 1, 1, 1, D("35900")), (2, 1, 10, None, 1, D("5800")), (3, 2, 4, None, 2, D("900")),
         (4, 2, 9, None, 1, D("1200")), (5, 3, 2, None, 1, D("32900")), (6, 3, 6, None, 1, D("8900")),
         (7, 4, 4, None, 1, D("450")), (8, 5, 6, None, 1, D("8900"))],
        "id int, order_id int, product_id int, variant_id int, quantity int, total decimal(10,2)",
    )
    carts = frame([], "id int, session_id string, customer_id int, items string")
    payments = frame(
        [(i, i, D(t), "completed") for i, t in enumerate(("39570", "1376", "36180", "458"), start=1)],
        "id int, order_id int, amount decimal(10,2), status string",
    )
    shipments = frame(
        [(1, 1, "T1", "delivered"), (2, 2, "T2", "shipped"), (3, 3, "T3", "in_transit")],
        "id int, order_id int, tracking_number string, status string",
    )
    returns = frame([], "id int, order_id int, reason string, status string")
    coupons = frame(
        [(1, "WELCOME10", "new", "percentage", D("10"), D("500"), True),
         (2, "SUMMER20", "summer", "percentage", D("20"), D("1000"), True),
         (3, "FLASH500", "flash", "fixed_amount", D("500"), D("3000"), True)],
        "id int, code string, name string, discount_type string, discount_value decimal(10,2), "
        "minimum_amount decimal(10,2), is_active boolean",
    ).selectExpr("*", f"{T0} AS starts_at", f"{T0} AS expires_at")
    reviews = frame(
        [(1, 1, 1, 5), (2, 4, 2, 4), (3, 9, 2, 5), (4, 2, 3, 5), (5, 6, 3, 4), (6, 4, 4, 3)],
        "id int, product_id int, customer_id int, rating int",
    )
    changes = frame(
        [(1, 1, "sale", -1, 50, 49), (2, 10, "sale", -1, 60, 59), (3, 4, "sale", -2, 200, 198),
         (4, 9, "sale", -1, 80, 79), (5, 2, "sale", -1, 30, 29), (6, 6, "sale", -1, 25, 24),
         (7, 4, "sale", -1, 198, 197), (8, 6, "adjustment", 5, 24, 29)],
        "id int, product_id int, transaction_type string, quantity int, previous_quantity int, new_quantity int",
    )
    return {
        "customers": customers, "customer_addresses": addresses, "categories": categories,
        "products": products, "product_variants": variants, "orders": orders, "order_items": items,
        "shopping_carts": carts, "payments": payments, "shipments": shipments, "returns": returns,
        "coupons": coupons, "reviews": reviews, "inventory_transactions": changes,
    }
