"""Answers joined to questions, routed to decisions, and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, ForeignKey, TableKeys
from .values import collection_child_table, value_lookup_table

# Answer keys that are not answers.
IGNORED_KEYS = ("timestamp", "notes")
# Words of an answer and the decision they stand for, first match wins.
TABLE_ANSWER_WORDS = (
    ("drop", ("刪除", "drop")),
    ("keep", ("保留", "keep", "仍在使用")),
    ("merge", ("合併", "merge")),
)
# Question type, answer words, decision, value list to make.
COLUMN_ANSWER_WORDS = (
    ("unused_column_check", ("不再使用", "可以移除"), "remove", None),
    ("collection_check", ("應該轉換",), "convert", "items"),
    ("enum_check", ("枚舉值完整",), "enum", "enum"),
    ("enum_check", ("枚舉值不完整",), "define", "enum"),
    ("int_definition_check", ("需要更好的定義",), "define", None),
    ("value_collection_check", ("需要搜集值選項",), "define", "options"),
)


def _has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(text), F.lit(word.lower()))
    return hit


def clean_answers(answers: DataFrame) -> DataFrame:
    return answers.filter(~F.col("question_id").isin(*IGNORED_KEYS))


def answers_from_json(df: DataFrame, column: str) -> DataFrame:
    """(question_id, response) rows of ``{"q1": "text", ...}`` objects."""
    pairs = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    return clean_answers(df.select(F.inline(pairs)).toDF("question_id", "response"))


def answer_questions(questions: DataFrame, answers: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Answers with their question's columns; unmatched answers dropped unless kept."""
    return clean_answers(answers).join(questions, "question_id", "left" if keep_unmatched else "inner")


def column_decisions(answered: DataFrame) -> DataFrame:
    """``decision`` (remove, convert, enum, define, review) and ``value_list`` to make."""
    decision = value_list = None
    for kind, words, result, listed in COLUMN_ANSWER_WORDS:
        hit = (F.col("question_type") == kind) & _has_any(F.col("response"), words)
        made = F.lit(listed)
        decision = F.when(hit, result) if decision is None else decision.when(hit, result)
        value_list = F.when(hit, made) if value_list is None else value_list.when(hit, made)
    return answered.withColumn("decision", decision.otherwise("review")).withColumn(
        "value_list", value_list.otherwise(F.lit("none"))
    ).withColumn("value_list", F.coalesce("value_list", F.lit("none")))


def table_decisions(answered: DataFrame) -> DataFrame:
    """drop, keep, merge or review for each answered table."""
    decision = None
    for result, words in TABLE_ANSWER_WORDS:
        hit = _has_any(F.col("response"), words)
        decision = F.when(hit, result) if decision is None else decision.when(hit, result)
    return answered.withColumn("decision", decision.otherwise("review"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("decision_count"))


def exclude_tables(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tables that no answer drops."""
    dropped = decisions.filter("decision = 'drop'").select("table_name").distinct()
    return tables.join(dropped, "table_name", "left_anti")


def excluded_summary(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """All tables with a flag: kept or excluded."""
    dropped = decisions.filter("decision = 'drop'").select("table_name").distinct()
    marked = dropped.withColumn("dropped", F.lit(True))
    return tables.join(marked, "table_name", "left").select(
        *tables.columns, F.when(F.col("dropped"), "excluded").otherwise("kept").alias("outcome")
    )


def _pruned(keys: dict[str, TableKeys], tables: dict[str, DataFrame]) -> dict[str, TableKeys]:
    """The keys whose columns, and whose tables referred to, are all still there."""

    def has(table: str, columns: tuple[str, ...]) -> bool:
        return table in tables and set(columns) <= set(tables[table].columns)

    return {
        table: TableKeys(
            k.primary if has(table, k.primary) else (),
            tuple(f for f in k.foreign if has(table, f.columns) and has(f.ref_table, f.ref_columns)),
            tuple(u for u in k.unique if has(table, u)),
        )
        for table, k in keys.items()
        if table in tables
    }


def apply_table_decisions(catalog: Catalog, decisions: DataFrame) -> Catalog:
    """The catalog without dropped tables and keys to them; at most one name per table is read back."""
    rows = decisions.filter("decision = 'drop'").select("table_name").distinct().collect()
    gone = {row[0] for row in rows}
    kept = {name: df for name, df in catalog.tables.items() if name not in gone}
    return Catalog(kept, _pruned(catalog.keys, kept), catalog.database, catalog.database_type)


def apply_column_decisions(catalog: Catalog, decisions: DataFrame) -> Catalog:
    """The catalog as decided, with new tables; one row per column is read back.

    Removed columns go, with the keys that use them. A converted collection moves to a
    table ``<table>_<column>_items`` (parent key, position, item) that refers to its
    parent; it stays a column where the parent has no key to refer to, or is part of
    it. Columns with a value list to make get ``<table>_<column>_values``.
    """
    rows = (
        decisions.filter("decision IN ('remove', 'convert') OR value_list IN ('enum', 'options')")
        .select("table_name", "column_name", "decision", "value_list")
        .distinct()
        .collect()
    )
    out, keys = dict(catalog.tables), dict(catalog.keys)
    gone: dict[str, set[str]] = {}
    for table, column, decision, listed in rows:
        if table not in catalog.tables or column not in catalog[table].columns:
            continue
        primary = catalog.keys.get(table, TableKeys()).primary
        if decision == "remove":
            gone.setdefault(table, set()).add(column)
        elif decision == "convert" and primary and column not in primary:
            child = f"{table}_{column}_items"
            out[child] = collection_child_table(catalog[table], primary, column)
            keys[child] = TableKeys((*primary, "item_position"), (ForeignKey(primary, table, primary),))
            gone.setdefault(table, set()).add(column)
        if listed in ("enum", "options"):
            listing = f"{table}_{column}_values"
            out[listing] = value_lookup_table(catalog[table], column)
            keys[listing] = TableKeys(("value",))
    for table, columns in gone.items():
        out[table] = out[table].drop(*columns)
    return Catalog(out, _pruned(keys, out), catalog.database, catalog.database_type)
