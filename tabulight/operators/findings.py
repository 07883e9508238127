"""Column findings: rules over the column profile, and the questions they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.catalog import Catalog, type_family
from .profile import EXACT_VALUES, LOW_BELOW, distinct_counts, profile_catalog, typed_value

# Thresholds of the column rules.
UNUSED_SHARE = 0.8
COLLECTION_ROWS = 2
ENUM_ROWS, ENUM_SHARE = 5, 5
VALUE_ROWS, STATUS_UNIQUE, CHAR_UNIQUE, CHAR_LOW, CHAR_HIGH = 3, 20, 50, 0.1, 0.9
NAME_SHARE, ID_SHARE = 2, 3
STATUS_NAMES = ("status", "type", "state", "gender", "category")
LABEL_NAMES = ("name", "title", "city", "address")
# Issue labels in report order.
ISSUES = (
    "potentially_unused", "potential_collection", "enum_usage", "value_collection_needed", "undefined_int",
)
# Question type, text and options of each issue, in question order.
COLUMN_QUESTIONS = (
    (
        "potentially_unused", "unused_column_check",
        "表格 '%s' 的欄位 '%s' 看起來可能沒有在使用（大量空值）。這個欄位是否還在被應用程序使用？",
        ("不再使用，可以移除", "仍在使用", "需要進一步檢查"),
    ),
    (
        "potential_collection", "collection_check",
        "表格 '%s' 的欄位 '%s' 看起來像是儲存了多個值的集合。這個欄位是否應該轉換為關聯表格？",
        ("應該轉換為關聯表格", "保持現狀", "需要進一步檢查"),
    ),
    (
        "enum_usage", "enum_check",
        "表格 '%s' 的欄位 '%s' 看起來使用了枚舉值。這個欄位的枚舉值是否完整定義？",
        ("枚舉值完整", "枚舉值不完整，需要補充", "需要進一步檢查"),
    ),
    (
        "undefined_int", "int_definition_check",
        "表格 '%s' 的欄位 '%s' 使用了 int 類型但看起來沒有明確的定義。這個欄位是否需要更好的定義？",
        ("需要更好的定義", "定義已經足夠", "需要進一步檢查"),
    ),
    (
        "value_collection_needed", "value_collection_check",
        "表格 '%s' 的欄位 '%s' 包含了多個不同的值。這個欄位是否需要搜集可用的值選項？",
        ("需要搜集值選項", "不需要，值動態生成", "需要進一步檢查"),
    ),
)
TABLE_QUESTIONS = {
    "empty_table_check": (
        "表格 '%s' 是空的（0條記錄）。是否可以安全刪除這個表格？",
        ("可以刪除", "保留（仍在使用）", "需要進一步檢查"),
    ),
    "usage_check": (
        "表格 '%s' 只有 %d 條記錄。這是否表示這個表格已經不再使用？",
        ("不再使用，可以刪除", "仍在使用", "測試數據，可以清理"),
    ),
}


def is_id_name(name: str, literal: bool = False) -> bool:
    """A name with the whole token ``id`` (or, if ``literal``, with those letters)."""
    low = name.lower()
    if "uuid" in low or "guid" in low:
        return False
    return "id" in low if literal else "id" in low.split("_")


def columns_needing_distinct(catalog: Catalog) -> dict[str, list[str]]:
    """Columns whose rules read a distinct count: texts, and names a rule knows."""

    def needed(field) -> bool:
        low = field.name.lower()
        return (
            type_family(field.dataType) == "text"
            or any(word in low for word in STATUS_NAMES + LABEL_NAMES)
            or is_id_name(low, literal=True)
        )

    return {t: [f.name for f in catalog[t].schema.fields if needed(f)] for t in catalog.names}


# Five standard deviations of the sketch; a count further from a threshold than that is on the side its estimate is.
ERROR_BAND = 0.08


def undecided() -> Column:
    """Profile rows whose estimated distinct count is too near a row share of their rule to tell the side.

    The sketch is exact well past the fixed thresholds of 1, 20 and 50 values.
    """
    unique, rows, name = _unique(), F.col("row_count"), F.lower("column_name")

    def near(share: int) -> Column:
        return F.abs(unique - rows / share) <= unique * ERROR_BAND + 1

    labels = F.lit(False)
    for word in LABEL_NAMES:
        labels = labels | F.contains(name, F.lit(word))
    rules = ((F.col("family") == "text") & near(ENUM_SHARE)) | (labels & near(NAME_SHARE))
    rules = rules | (F.contains(name, F.lit("id")) & near(ID_SHARE))
    return (F.col("distinct_count") > EXACT_VALUES * (1 - ERROR_BAND)) & rules


def findings_profile(catalog: Catalog) -> DataFrame:
    """The profile the rules need, with distinct counts only where a rule reads one.

    Counts come from sketches, which no value is shuffled for. Only columns whose estimate
    lies within the sketch's error of a row-share threshold are counted exactly. The
    profile has a row per column; those pass through the driver.
    """
    needed = columns_needing_distinct(catalog)
    found = profile_catalog(catalog, "approx", needed)
    rough = found.sparkSession.createDataFrame(found.collect(), found.schema)
    open_ = rough.filter(undecided()).select("table_name", "column_name").collect()
    if not open_:
        return rough
    entries: dict[str, list] = {}
    for tag, (table, column) in enumerate(open_):
        entries.setdefault(table, []).append((tag, typed_value(column, catalog[table].schema[column].dataType)))
    names = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in open_])
    exact = distinct_counts(catalog.tables, entries).select(names[F.col("tag")].alias("at"), F.col("distinct_count").alias("exact"))
    exact = exact.select("at.*", "exact")
    return (
        rough.join(exact, ["table_name", "column_name"], "left")
        .withColumn("distinct_count", F.coalesce("exact", "distinct_count"))
        .select(*rough.columns)
    )


def _unique() -> Column:
    empties = F.when(F.col("empty_count") > 0, 1).otherwise(0)
    return F.col("distinct_count") - empties


def _filled() -> Column:
    return F.col("row_count") - F.col("null_count") - F.col("empty_count")


def unused_rule() -> Column:
    """Nullable and null or empty in more than 80 percent of the rows."""
    share = (F.col("null_count") + F.col("empty_count")) / F.col("row_count")
    return F.col("nullable") & F.coalesce(F.when(F.col("row_count") > 0, share) > UNUSED_SHARE, F.lit(False))


def collection_rule() -> Column:
    """An array, or a text with list marks in more than two rows."""
    marked = (F.col("family") == "text") & (F.col("marked_count") > COLLECTION_ROWS)
    return (F.col("family") == "array") | marked


def enum_rule() -> Column:
    """A text with few values: more than one, fewer than a fifth of the rows."""
    few = (_unique() > 1) & (_unique() < F.floor(F.col("row_count") / ENUM_SHARE))
    return (F.col("family") == "text") & (F.col("row_count") >= ENUM_ROWS) & few


def value_list_rule(literal_id: bool = False) -> Column:
    """A column whose values are worth listing; the first matching name rule decides."""
    name, unique, rows = F.lower("column_name"), _unique(), F.col("row_count")

    def named(words) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        return hit

    ids = F.contains(name, F.lit("id")) if literal_id else F.array_contains(F.split(name, "_"), "id")
    ids = ids & ~F.contains(name, F.lit("uuid")) & ~F.contains(name, F.lit("guid"))
    ratio = unique / F.when(_filled() > 0, _filled())
    rule = (
        F.when(named(STATUS_NAMES), unique <= STATUS_UNIQUE)
        .when(named(LABEL_NAMES), (unique > 1) & (unique <= F.floor(rows / NAME_SHARE)))
        .when(ids, (unique > 1) & (unique <= F.floor(rows / ID_SHARE)))
        .when(
            F.col("family") == "text",
            (ratio > CHAR_LOW) & (ratio < CHAR_HIGH) & (unique <= CHAR_UNIQUE),
        )
        .otherwise(F.lit(False))
    )
    return (rows >= VALUE_ROWS) & (_filled() >= VALUE_ROWS) & F.coalesce(rule, F.lit(False))


def undefined_int_rule() -> Column:
    """An integer that is in no declared key; reads the flags of ``with_key_flags``."""
    whole = F.col("data_type").isin("tinyint", "smallint", "int", "bigint")
    return whole & ~F.col("in_primary") & ~F.col("in_foreign")


def with_key_flags(profile: DataFrame, catalog: Catalog) -> DataFrame:
    """Profile rows with flags for columns in declared primary and foreign keys."""

    def listed(names: list[str]) -> Column:
        full = F.concat_ws(".", "table_name", "column_name")
        return full.isin(*names) if names else F.lit(False)

    primary = [f"{t}.{c}" for t in catalog.names for c in catalog.keys_of(t).primary]
    foreign = [f"{t}.{c}" for t in catalog.names for k in catalog.keys_of(t).foreign for c in k.columns]
    return profile.withColumn("in_primary", listed(primary)).withColumn("in_foreign", listed(foreign))


def column_issues(profile: DataFrame, literal_id: bool = False) -> DataFrame:
    """Columns with at least one issue; ``issues`` in report order."""
    rules = {
        "potentially_unused": unused_rule(),
        "potential_collection": collection_rule(),
        "enum_usage": enum_rule(),
        "value_collection_needed": value_list_rule(literal_id),
        "undefined_int": undefined_int_rule(),
    }
    found = F.array_compact(F.array(*[F.when(rules[label], F.lit(label)) for label in ISSUES]))
    return (
        profile.withColumn("issues", found)
        .filter(F.size("issues") > 0)
        .select("table_name", "ordinal", "column_name", "data_type", "nullable", "issues")
    )


def column_questions(issues: DataFrame) -> DataFrame:
    """One question per column and issue; ids follow table, column and issue order.

    There is one row per column of the catalog here, so the numbering window is small.
    """
    templates = F.array(
        *[
            F.struct(
                F.lit(order).alias("issue_order"),
                F.lit(issue).alias("issue"),
                F.lit(kind).alias("question_type"),
                F.format_string(text, F.col("table_name"), F.col("column_name")).alias("question"),
                F.array(*map(F.lit, options)).alias("options"),
            )
            for order, (issue, kind, text, options) in enumerate(COLUMN_QUESTIONS)
        ]
    )
    raised = F.filter(templates, lambda t: F.array_contains(F.col("issues"), t["issue"]))
    numbered = Window.orderBy("table_name", "ordinal", "issue_order")
    return (
        issues.select("table_name", "ordinal", "column_name", "data_type", F.inline(raised))
        .withColumn("question_number", F.row_number().over(numbered).cast("bigint"))
        .withColumn("question_id", F.concat(F.lit("q"), "question_number"))
        .drop("issue_order")
    )


def table_questions(counts: DataFrame) -> DataFrame:
    """A question per empty table, then one per table of 1 to 9 rows; one row per table."""
    n = F.col("row_count")
    kind = F.when(n == 0, "empty_table_check").when(n < LOW_BELOW, "usage_check")
    empty, low = TABLE_QUESTIONS["empty_table_check"], TABLE_QUESTIONS["usage_check"]
    numbered = Window.orderBy("question_type", "table_name")
    return (
        counts.withColumn("question_type", kind)
        .filter("question_type IS NOT NULL")
        .withColumn(
            "question",
            F.when(n == 0, F.format_string(empty[0], F.col("table_name"))).otherwise(
                F.format_string(low[0], F.col("table_name"), n)
            ),
        )
        .withColumn("related_tables", F.array("table_name"))
        .withColumn(
            "options",
            F.when(n == 0, F.array(*map(F.lit, empty[1]))).otherwise(F.array(*map(F.lit, low[1]))),
        )
        .withColumn("question_number", F.row_number().over(numbered).cast("bigint"))
        .withColumn("question_id", F.concat(F.lit("q"), "question_number"))
    )
