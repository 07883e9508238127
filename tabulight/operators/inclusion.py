"""References between columns of any name, found by their values alone.

An inverted index of all columns is made in one shuffle: a value is one row there with
the set of columns that hold it, as bits. A column refers to those that are in the sets
of all its values, so one bit-AND per column over the sets gives every inclusion at once;
no pair of columns is compared on its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Catalog, type_family
from .profile import name_of, tagged_values, union_all, value_text

WORD = 64


def comparable(column: str, data_type: T.DataType) -> dict[str, str]:
    """A value in the one form in which it meets equal values of other columns.

    Whole numbers of any type meet as BIGINT, other numbers as DOUBLE; texts meet texts;
    dates meet timestamps without zone as midnight, instants only instants.
    """
    c = name_of(column)
    if isinstance(data_type, T.IntegralType):
        return {"n": f"CAST({c} AS BIGINT)"}
    if type_family(data_type) == "number":
        x = f"CAST({c} AS DOUBLE)"
        # 2^63 is the first double past the range of BIGINT
        whole = f"{x} = floor({x}) AND abs({x}) < 9223372036854775808D"
        return {"n": f"CASE WHEN {whole} THEN CAST({c} AS BIGINT) END", "d": f"CASE WHEN NOT ({whole}) THEN {x} END"}
    if isinstance(data_type, T.TimestampType):
        return {"s": f"concat('i', unix_micros({c}))"}
    if type_family(data_type) == "time":
        return {"s": f"concat('m', CAST(CAST({c} AS TIMESTAMP_NTZ) AS STRING))"}
    return {"s": f"concat('t', {value_text(column, data_type)})"}


def value_sets(catalog: Catalog, columns: list[tuple[str, str]]) -> DataFrame:
    """(words, n_values): the distinct sets of columns that share a value, with how many values have each.

    Values are first merged in their own tasks, so one that fills a third of a table is a
    row a task; what is counted after the shuffle is sets, of which there are far fewer.
    """
    entries: dict[str, list] = {}
    for number, (table, column) in enumerate(columns):
        entries.setdefault(table, []).append((number, comparable(column, catalog[table].schema[column].dataType)))
    words = range(-(-len(columns) // WORD))
    held = [
        F.coalesce(F.expr(f"bit_or(CASE WHEN tag DIV {WORD} = {w} THEN shiftleft(1L, CAST(tag % {WORD} AS INT)) END)"), F.lit(0)).alias(f"w{w}")
        for w in words
    ]
    sets = tagged_values(catalog.tables, entries).groupBy("n", "d", "s").agg(*held)
    names = [f"w{w}" for w in words]
    return sets.groupBy(*names).agg(F.count(F.lit(1)).alias("n_values")).select(F.array(*names).alias("words"), "n_values")


def members(words: Column | str, count: int) -> Column:
    """The numbers of the bits that are set, below ``count``."""
    words = F.col(words) if isinstance(words, str) else words
    return F.filter(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.getbit(F.get(words, F.floor(i / WORD).cast("int")), i % WORD) == 1,
    )


def comparable_columns(catalog: Catalog) -> list[tuple[str, str]]:
    return [
        (t, f.name) for t in catalog.names for f in catalog[t].schema.fields
        if type_family(f.dataType) in ("number", "text", "time")
    ]


def inclusion_dependencies(catalog: Catalog) -> DataFrame:
    """Every pair of columns of which one holds all values of the other, whatever they are called.

    (child_table, child_column, parent_table, parent_column, child_distinct,
    parent_distinct, coverage, parent_unique); coverage is the share of the parent's
    values that the child uses, and a unique parent has no null and no value twice.
    Columns without any value refer to nothing. Numbers, texts and times are compared
    among themselves; see ``comparable``. Numbers that are not whole meet as DOUBLE.
    """
    columns = comparable_columns(catalog)
    sets = value_sets(catalog, columns)
    size = len(columns)
    per_column = (
        sets.select(F.explode(members("words", size)).alias("child"), "words", "n_values")
        .groupBy("child")
        .agg(
            F.sum("n_values").alias("distinct_count"),
            *[F.bit_and(F.col("words")[w]).alias(f"w{w}") for w in range(-(-size // WORD))],
        )
        .select("child", "distinct_count", F.array(*[f"w{w}" for w in range(-(-size // WORD))]).alias("words"))
    )
    presence = present_rows(catalog, columns)
    # From here on there is a row per column of the catalog, and one per pair that is included.
    facts = per_column.join(presence, per_column["child"] == presence["tag"], "left").select(
        "child", "words", "distinct_count", (F.col("distinct_count") == F.col("n_rows")).alias("is_unique"),
    )
    pairs = facts.select("child", F.col("distinct_count").alias("child_distinct"), F.explode(members("words", size)).alias("parent")).filter("child <> parent")
    parents = facts.select(F.col("child").alias("parent"), F.col("distinct_count").alias("parent_distinct"), F.col("is_unique").alias("parent_unique"))
    names = F.from_json(F.lit(json.dumps([list(c) for c in columns])), "array<array<string>>")
    return pairs.join(parents, "parent").select(
        names[F.col("child")][0].alias("child_table"), names[F.col("child")][1].alias("child_column"),
        names[F.col("parent")][0].alias("parent_table"), names[F.col("parent")][1].alias("parent_column"),
        "child_distinct", "parent_distinct",
        F.round(F.col("child_distinct") / F.col("parent_distinct"), 6).alias("coverage"), "parent_unique",
    )


def present_rows(catalog: Catalog, columns: list[tuple[str, str]]) -> DataFrame:
    """(tag, n_rows): the rows of the table of each column that has no null; one scan a table."""
    frames = []
    for table in catalog.names:
        own = [(i, c) for i, (t, c) in enumerate(columns) if t == table]
        if own:
            counts = ", ".join(f"named_struct('tag', {i}, 'n_rows', count(1), 'present', count({name_of(c)}))" for i, c in own)
            frames.append(catalog[table].agg(F.expr(f"array({counts})").alias("c")).select(F.inline("c")))
    return union_all(frames).filter("present = n_rows").select("tag", "n_rows")


def value_references(catalog: Catalog, least_coverage: float = 0.0, least_values: int = 2) -> DataFrame:
    """The likeliest reference of each column: into a unique column of which it uses the largest share.

    Columns with fewer than ``least_values`` values are left out, as they fit everywhere.
    Two unique columns of one table may name the same thing; both are tried. Ties go to
    the parent's table and column in order. Adds ``choices``, the number of unique parents that fit.
    """
    found = inclusion_dependencies(catalog).filter(
        F.col("parent_unique") & (F.col("coverage") >= least_coverage) & (F.col("child_distinct") >= least_values)
    )
    best = F.struct((-F.col("coverage")).alias("order"), "parent_table", "parent_column", "child_distinct", "parent_distinct", "coverage")
    # At most one entry per column of the catalog in a group.
    return found.groupBy("child_table", "child_column").agg(F.min(best).alias("b"), F.count(F.lit(1)).alias("choices")).select(
        "child_table", "child_column", "b.parent_table", "b.parent_column", "b.child_distinct", "b.parent_distinct", "b.coverage", "choices"
    )
