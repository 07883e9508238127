"""Ordered keyword classification: rules are data, the result is one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind


@dataclass(frozen=True)
class Rule:
    """A class and the words that mark it, per scope (a named text column)."""

    label: str
    words: Mapping[str, tuple[str, ...]]


def classify(texts: Mapping[str, Column], rules: Sequence[Rule], default: str) -> Column:
    """The label of the first rule with a word in its text, else ``default``.

    The texts are bound once, so lower-casing and the like is not repeated per word.
    """

    def first_hit(scope_texts: Column) -> Column:
        result = None
        for rule in rules:
            hit = F.lit(False)
            for scope, scope_words in rule.words.items():
                for word in scope_words:
                    hit = hit | F.coalesce(F.contains(scope_texts[scope], F.lit(word)), F.lit(False))
            result = F.when(hit, rule.label) if result is None else result.when(hit, rule.label)
        return result.otherwise(default)

    return bind(F.struct(*[text.alias(scope) for scope, text in texts.items()]), first_hit)


def _named(label: str, words: str) -> Rule:
    return Rule(label, {"name": tuple(words.split())})


def _both(label: str, words: str) -> Rule:
    return Rule(label, {"name": tuple(words.split()), "description": tuple(words.split())})


# Business areas, by table name and by words of the description.
BUSINESS_RULES = (
    Rule("customer_management", {"name": ("customer",), "description": ("顧客", "客戶")}),
    Rule("product_management", {"name": ("product", "categories"), "description": ("商品",)}),
    Rule("order_management", {"name": ("order", "cart"), "description": ("訂單",)}),
    Rule("inventory_management", {"name": ("inventory",), "description": ("庫存",)}),
    Rule("marketing_promotion", {"name": ("coupon", "promo"), "description": ("優惠", "促銷")}),
    Rule("content_reviews", {"name": ("review",), "description": ("評論",)}),
    Rule("shipping_logistics", {"name": ("shipment", "shipping"), "description": ("運送",)}),
)
BUSINESS_DEFAULT = "other"

# Table categories by lower-cased name.
TABLE_RULES = (
    _named("User Management", "user member"),
    _named("Order Processing", "order transaction"),
    _named("Product Management", "product item"),
    _named("Payment Processing", "payment tender"),
    _named("Promotions & Benefits", "benefit coupon voucher promotion"),
    _named("Audit & Logging", "log audit"),
    _named("Membership Tiers", "tier level"),
    _named("Contact Management", "contact client"),
    _named("Currency Management", "currency"),
    _named("System Management", "migration schema"),
)
TABLE_DEFAULT = "General Business Data"

# Dimension classes by lower-cased name or description.
DIMENSION_RULES = (
    _both("people", "customer user person people client supplier vendor employee staff member"),
    _both("time", "date time datetime timestamp calendar period month year day hour"),
    _both("product", "product item goods merchandise sku inventory catalog category coupon discount price"),
    _both("event", "order transaction sale purchase shipment delivery payment review feedback event action behavior"),
    _both("location", "location address city country region state province zip postal geo place area"),
)
DIMENSION_DEFAULT = "product"
DIMENSION_CLASSES = {
    "people": "人 - 資料模型裡面的對象 (客戶、使用者、供應商等)",
    "time": "時間 - 時間維度",
    "product": "物體 - 資料模型裡面的物體 (產品、折扣券等)",
    "event": "事件 - 資料模型裡面的事件 (運輸、銷售等)",
    "location": "地點 - 上述發生的地點",
}

# Domain names.
DOMAIN_PLATFORM = "電商平台 (E-commerce Platform)"
DOMAIN_RETAIL = "零售/銷售系統 (Retail/Sales System)"
DOMAIN_INVENTORY = "庫存管理系統 (Inventory Management System)"
DOMAIN_GENERAL = "通用商業系統 (General Business System)"

# Processes and entities that go with a business area.
AREA_LABELS = (
    ("customer_management", "process", "顧客管理 (Customer Management)"),
    ("customer_management", "entity", "顧客 (Customer)"),
    ("product_management", "process", "商品目錄管理 (Product Catalog Management)"),
    ("product_management", "entity", "商品 (Product)"),
    ("product_management", "entity", "商品分類 (Category)"),
    ("order_management", "process", "訂單處理 (Order Processing)"),
    ("order_management", "process", "購物車管理 (Shopping Cart Management)"),
    ("order_management", "entity", "訂單 (Order)"),
    ("order_management", "entity", "訂單項目 (Order Item)"),
    ("inventory_management", "process", "庫存管理 (Inventory Management)"),
    ("inventory_management", "entity", "庫存交易 (Inventory Transaction)"),
    ("marketing_promotion", "process", "行銷活動管理 (Marketing Campaign Management)"),
    ("marketing_promotion", "entity", "優惠券 (Coupon)"),
    ("content_reviews", "process", "用戶評論管理 (User Review Management)"),
    ("content_reviews", "entity", "評論 (Review)"),
    ("shipping_logistics", "process", "物流運送管理 (Shipping & Logistics Management)"),
    ("shipping_logistics", "entity", "運送 (Shipment)"),
)

# Two words of one description and the relation they stand for.
RELATION_PAIRS = (
    ("訂單", "顧客", "顧客下訂單 (Customer places Orders)"),
    ("商品", "訂單", "訂單包含商品 (Orders contain Products)"),
    ("商品", "分類", "商品屬於分類 (Products belong to Categories)"),
    ("評論", "商品", "顧客評論商品 (Customers review Products)"),
    ("運送", "訂單", "訂單需要運送 (Orders require Shipping)"),
)


def business_area(name: Column, description: Column) -> Column:
    return classify(
        {"name": name, "description": F.lower(description)}, BUSINESS_RULES, BUSINESS_DEFAULT
    )


def table_category(name: Column) -> Column:
    return classify({"name": F.lower(name)}, TABLE_RULES, TABLE_DEFAULT)


def dimension_class(name: Column, description: Column, explicit: Column | None = None) -> Column:
    """An explicit valid class wins, else the first class with a matching word."""
    guessed = classify(
        {"name": F.lower(name), "description": F.lower(description)}, DIMENSION_RULES, DIMENSION_DEFAULT
    )
    if explicit is None:
        return guessed
    return F.when(explicit.isin(*DIMENSION_CLASSES), explicit).otherwise(guessed)
