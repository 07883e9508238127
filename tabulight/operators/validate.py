"""Constraint checks: each table is scanned once for all its row rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, literal_rows
from .inclusion import comparable
from .keys import key_checks
from .profile import union_all

# The forms a value may have; see ``comparable``.
VALUE_TYPES = (("n", "BIGINT"), ("d", "DOUBLE"), ("s", "STRING"))


@dataclass(frozen=True)
class RowRule:
    """``condition`` holds for good rows; a null result passes, as in SQL CHECK."""

    table: str
    name: str
    condition: str


@dataclass(frozen=True)
class UniqueRule:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ReferenceRule:
    table: str
    column: str
    ref_table: str
    ref_column: str


def not_null(table: str, column: str) -> RowRule:
    return RowRule(table, f"{column} not null", f"`{column}` IS NOT NULL")


def in_list(table: str, column: str, values: Sequence[str]) -> RowRule:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return RowRule(table, f"{column} in list", f"`{column}` IN ({listed})")


def between(table: str, column: str, low: float, high: float) -> RowRule:
    return RowRule(table, f"{column} in range", f"`{column}` BETWEEN {low} AND {high}")


def at_least(table: str, column: str, low: float) -> RowRule:
    return RowRule(table, f"{column} at least {low}", f"`{column}` >= {low}")


def above(table: str, column: str, low: float) -> RowRule:
    return RowRule(table, f"{column} above {low}", f"`{column}` > {low}")


def row_violations(df: DataFrame, table: str, rules: Sequence[RowRule]) -> DataFrame:
    counts = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.count_if(~F.expr(rule.condition)).alias("violations"),
            )
            for rule in rules
        ]
    )
    return df.agg(counts.alias("c")).select(F.lit(table).alias("table_name"), F.inline("c"))


def unique_violations(catalog: Catalog, rules: Sequence[UniqueRule]) -> DataFrame:
    """Rows beyond the first of each complete key."""
    wanted: dict[str, list] = {}
    for rule in rules:
        wanted.setdefault(rule.table, []).append(rule.columns)
    return key_checks(catalog, wanted).select(
        "table_name",
        F.concat("key_columns", F.lit(" unique")).alias("rule"),
        (F.col("row_count") - F.col("null_count") - F.col("distinct_count")).alias("violations"),
    )


def reference_violations(catalog: Catalog, rules: Sequence[ReferenceRule]) -> DataFrame:
    """Rows whose value has no parent, for all rules at once; nulls pass.

    Each table is scanned once for all its columns in any rule, and all values of all rules
    meet in one shuffle, after those of a task were merged: a value that fills a third of
    a table is one row a task.
    """
    columns: dict[str, list[str]] = {}
    for number, rule in enumerate(rules):
        for table, column, is_parent in ((rule.table, rule.column, False), (rule.ref_table, rule.ref_column, True)):
            value = comparable(column, catalog[table].schema[column].dataType)
            parts = [f"CAST({value.get(kind, 'NULL')} AS {name})" for kind, name in VALUE_TYPES]
            columns.setdefault(table, []).append(
                f"named_struct('number', {number}, 'is_parent', {str(is_parent).lower()}, 'n', {parts[0]}, 'd', {parts[1]}, 's', {parts[2]})"
            )
    listed = [catalog[t].select(F.expr(f"inline(array({', '.join(found)}))")) for t, found in columns.items()]
    values = (
        union_all(listed).filter("n IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL").groupBy("number", "n", "d", "s")
        .agg(F.count_if(~F.col("is_parent")).alias("children"), F.bool_or("is_parent").alias("held"))
    )
    orphans = values.filter(~F.col("held")).groupBy("number").agg(F.sum("children").alias("violations"))
    named = literal_rows(
        catalog[rules[0].table].sparkSession,
        [
            {"number": i, "table_name": r.table, "rule": f"{r.column} in {r.ref_table}.{r.ref_column}"}
            for i, r in enumerate(rules)
        ],
        "number int, table_name string, rule string",
    )
    return named.join(orphans, "number", "left").select(
        "table_name", "rule", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations")
    )


def constraint_violations(catalog: Catalog, rules: Sequence) -> DataFrame:
    """Violations of every rule, in one job."""
    by_table: dict[str, list[RowRule]] = {}
    unique = [rule for rule in rules if isinstance(rule, UniqueRule)]
    references = [rule for rule in rules if isinstance(rule, ReferenceRule)]
    frames = [unique_violations(catalog, unique)] if unique else []
    frames += [reference_violations(catalog, references)] if references else []
    for rule in rules:
        if isinstance(rule, RowRule):
            by_table.setdefault(rule.table, []).append(rule)
    frames += [row_violations(catalog[t], t, r) for t, r in by_table.items()]
    return union_all(frames)
