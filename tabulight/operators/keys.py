"""Keys and references, found in the data."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.catalog import Catalog, type_family
from .profile import (
    distinct_counts, hashed_value, name_of, quoted, tagged_values, typed_value, union_all, value_text,
)


CLASH_SCHEMA = "tag int, row_count long, present long, clash boolean"


def _clashes(df: DataFrame, entries: list[tuple[int, str]]) -> DataFrame:
    """Per task and column: rows, rows with a value, and whether a value came twice in a batch.

    Once a column has clashed in a task its values are not looked at again there.
    """
    target = to_arrow_schema(T.StructType.fromDDL(CLASH_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, present, clash = 0, np.zeros(len(entries), np.int64), np.zeros(len(entries), bool)
        for batch in batches:
            rows += batch.num_rows
            for i, values in enumerate(batch.columns):
                known = len(values) - values.null_count
                present[i] += known
                if not clash[i]:
                    clash[i] = values.null_count > 0 or len(np.unique(values.to_numpy())) < known
        if rows:
            tags = pa.array([tag for tag, _ in entries], pa.int32())
            yield pa.RecordBatch.from_arrays([tags, pa.array([rows] * len(entries)), pa.array(present), pa.array(clash)], schema=target)

    return df.selectExpr(*[f"{value} AS c{i}" for i, (_, value) in enumerate(entries)]).mapInArrow(run, CLASH_SCHEMA)


def promising_columns(catalog: Catalog) -> dict[str, list[str]]:
    """Complete columns in which no value is seen twice near by: one scan a table.

    A value that comes twice in a batch, or a null, proves that a column is no key; what
    is left is few columns to count exactly. One row per column reaches the driver.
    """
    frames, labels = [], []
    for table, df in sorted(catalog.tables.items()):
        fields = [f for f in df.schema.fields if type_family(f.dataType) in ("number", "text", "time")]
        if fields:
            entries = [(len(labels) + i, hashed_value(f.name, f.dataType)["n"]) for i, f in enumerate(fields)]
            labels += [(table, f.name) for f in fields]
            frames.append(_clashes(df, entries))
    if not frames:
        return {}
    seen = union_all(frames).groupBy("tag").agg(
        F.sum("row_count").alias("row_count"), F.sum("present").alias("present"), F.max("clash").alias("clash")
    )
    found: dict[str, list[str]] = {}
    for row in seen.filter("NOT clash AND present = row_count").orderBy("tag").collect():
        table, column = labels[row["tag"]]
        found.setdefault(table, []).append(column)
    return found


def key_value(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """A key as one typed value; several parts as one text, null if a part is null.

    Parts that may hold any character are led by their length, so no two keys have one text.
    """
    if len(columns) == 1:
        return typed_value(columns[0], df.schema[columns[0]].dataType)

    def part(column: str) -> str:
        data_type = df.schema[column].dataType
        text = value_text(column, data_type)
        closed = type_family(data_type) in ("number", "time", "bool")
        return text if closed else f"concat(length({text}), ':', {text})"

    complete = " AND ".join(f"{name_of(c)} IS NOT NULL" for c in columns)
    return {"s": f"CASE WHEN {complete} THEN concat_ws(',', {', '.join(map(part, columns))}) END"}


def key_checks(catalog: Catalog, wanted: dict[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Exact tests of column sets: rows, distinct keys, rows with a null part.

    All sets of all tables go through one shuffle of distinct keys.
    """
    entries: dict[str, list[tuple[int, dict[str, str]]]] = {}
    labels = []
    for table, column_sets in wanted.items():
        for columns in column_sets:
            entries.setdefault(table, []).append((len(labels), key_value(catalog[table], columns)))
            labels.append((table, ",".join(columns)))
    names = ", ".join(
        f"named_struct('tag', {i}, 'table_name', {quoted(t)}, 'key_columns', {quoted(c)})"
        for i, (t, c) in enumerate(labels)
    )
    spark = next(iter(catalog.tables.values())).sparkSession
    checks = spark.range(0, 1, 1, 1).selectExpr(f"inline(array({names}))")
    sizes = union_all(
        catalog[t].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in entries
    )
    counts = distinct_counts(catalog.tables, entries)
    zero = F.lit(0).cast("bigint")
    return (
        checks.join(sizes, "table_name")
        .join(counts, "tag", "left")
        .select(
            "table_name",
            "key_columns",
            "row_count",
            F.coalesce("distinct_count", zero).alias("distinct_count"),
            (F.col("row_count") - F.coalesce("present", zero)).alias("null_count"),
        )
        .withColumn(
            "is_key", (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
        )
    )


def key_check(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """The exact test of one column set."""
    return key_checks(Catalog({table: df}), {table: [list(columns)]})


def key_candidates(
    catalog: Catalog, sets: dict[str, Iterable[Sequence[str]]] | None = None, likely: dict[str, list[str]] | None = None
) -> DataFrame:
    """Complete and unique single columns, and the given column sets that are.

    Exact counting is spent only on columns not ruled out before; ``likely`` passes
    a result of ``promising_columns`` on.
    """
    wanted: dict[str, list[Sequence[str]]] = {}
    for table, columns in (promising_columns(catalog) if likely is None else likely).items():
        wanted[table] = [[c] for c in columns]
    for table, column_sets in (sets or {}).items():
        wanted[table] = wanted.get(table, []) + [list(c) for c in column_sets]
    return key_checks(catalog, wanted).filter("is_key")


def verify_declared_keys(catalog: Catalog) -> DataFrame:
    """Every declared primary and unique key with the result of its exact test."""
    wanted: dict[str, list[Sequence[str]]] = {}
    for table in catalog.names:
        keys = catalog.keys_of(table)
        declared = ([keys.primary] if keys.primary else []) + list(keys.unique)
        if declared:
            wanted[table] = declared
    return key_checks(catalog, wanted)


@dataclass(frozen=True)
class ReferencePair:
    """A column that may refer to a key column."""

    child_table: str
    child_column: str
    parent_table: str
    parent_column: str


def _stem(column: str) -> str:
    head, _, rest = column.partition("_")
    return rest if rest and len(head) <= 2 else column


def _plural(word: str) -> str:
    return word[:-1] + "ies" if word.endswith("y") else word + "s"


def reference_pairs(catalog: Catalog) -> list[ReferencePair]:
    """Column pairs whose names and types fit a reference.

    Names fit if they are equal past a one- or two-letter table prefix and end in
    ``key`` or ``id``, if ``thing_id`` meets ``id`` of a table named ``...things``,
    or if ``parent_id`` meets ``id`` of its own table.
    """
    fields = {t: {f.name: type_family(f.dataType) for f in catalog[t].schema.fields} for t in catalog.names}
    pairs = []
    for child, child_fields in fields.items():
        for column, family in child_fields.items():
            stem = _stem(column)
            for parent, parent_fields in fields.items():
                for target, target_family in parent_fields.items():
                    if family != target_family or (child, column) == (parent, target):
                        continue
                    same = stem == _stem(target) and child != parent and stem.endswith(("key", "_id"))
                    thing = column[:-3] if column.endswith("_id") else None
                    named = bool(thing) and target == "id" and parent.endswith(_plural(thing))
                    own = column == "parent_id" and target == "id" and child == parent
                    if same or named or own:
                        pairs.append(ReferencePair(child, column, parent, target))
    return pairs


def common_type(left: T.DataType, right: T.DataType) -> str:
    """The type in which values of two columns are compared.

    Whole numbers meet as BIGINT, decimals and whole numbers as a decimal that holds
    all digits of both, all other numbers as DOUBLE, and anything else as text.
    """
    both = left, right
    if all(isinstance(t, T.IntegralType) for t in both):
        return "BIGINT"
    if not all(isinstance(t, T.NumericType) for t in both):
        return "STRING"
    if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in both):
        return "DOUBLE"
    sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in both]
    whole, scale = (max(part) for part in zip(*sizes))
    return f"DECIMAL({whole + scale},{scale})" if whole + scale <= 38 else "DOUBLE"


def reference_inclusion(catalog: Catalog, pairs: Sequence[ReferencePair]) -> DataFrame:
    """How far each child column's values are found in its parent column.

    Each table is scanned once for all its pairs; values are counted per task before
    the one shuffle, so a value that fills a third of a table is one row there.
    """
    fields = {
        (t, f.name): f.dataType for t in {x for p in pairs for x in (p.child_table, p.parent_table)}
        for f in catalog[t].schema.fields
    }

    def value(table: str, column: str, kind: str) -> dict[str, str]:
        text = f"CAST({name_of(column)} AS {kind})"
        if kind == "BIGINT":
            return {"n": text}
        # Adding zero turns -0.0 into 0.0.
        return {"d": f"{text} + 0.0D"} if kind == "DOUBLE" else {"s": f"CAST({text} AS STRING)"}

    # Numbers are compared as the narrowest type that holds both sides, other values as text.
    targets, parents = [], []
    child_entries: dict[str, list] = {}
    parent_entries: dict[str, list] = {}
    for number, p in enumerate(pairs):
        types = fields[p.child_table, p.child_column], fields[p.parent_table, p.parent_column]
        kind = common_type(*types)
        child_entries.setdefault(p.child_table, []).append((number, value(p.child_table, p.child_column, kind)))
        target = (p.parent_table, p.parent_column, kind)
        if target not in parents:
            parent_entries.setdefault(p.parent_table, []).append((len(parents), value(*target)))
            parents.append(target)
        targets.append(parents.index(target))

    def counted(entries, tag: str, count: str) -> DataFrame:
        return (
            tagged_values(catalog.tables, entries)
            .groupBy(F.col("tag").alias(tag), "n", "d", "s")
            .agg(F.count(F.lit(1)).alias(count))
        )

    child_values = counted(child_entries, "pair", "child_rows")
    parent_values = counted(parent_entries, "parent", "parent_rows")
    # Which parent column each pair reads, as data; one entry per pair.
    links = F.from_json(F.lit(json.dumps(targets)), "array<int>")
    near, far = child_values.withColumn("parent", links[F.col("pair")]).alias("c"), parent_values.alias("p")
    same = (
        (F.col("c.parent") == F.col("p.parent"))
        & F.col("c.n").eqNullSafe(F.col("p.n"))
        & F.col("c.d").eqNullSafe(F.col("p.d"))
        & F.col("c.s").eqNullSafe(F.col("p.s"))
    )
    matched = near.join(far, same, "left").select("c.pair", "c.child_rows", "p.parent_rows")
    per_pair = matched.groupBy("pair").agg(
        F.count(F.lit(1)).alias("child_distinct"),
        F.count("parent_rows").alias("matched_distinct"),
        F.sum("child_rows").alias("child_rows"),
        F.sum(F.when(F.col("parent_rows").isNull(), F.col("child_rows")).otherwise(0)).alias("orphan_rows"),
        F.max("child_rows").alias("most_children"),
        F.max("parent_rows").alias("most_parents"),
    )
    labels = [
        [p.child_table, p.child_column, p.parent_table, p.parent_column] for p in pairs
    ]
    names = F.from_json(F.lit(json.dumps(labels)), "array<array<string>>")[F.col("pair")]
    unique = parent_values.groupBy("parent").agg((F.max("parent_rows") == 1).alias("parent_unique"))
    return (
        per_pair.withColumn("parent", links[F.col("pair")])
        .join(unique, "parent")
        .select(
            names[0].alias("child_table"),
            names[1].alias("child_column"),
            names[2].alias("parent_table"),
            names[3].alias("parent_column"),
            "child_distinct",
            "matched_distinct",
            F.round(F.col("matched_distinct") / F.col("child_distinct"), 6).alias("inclusion"),
            "child_rows",
            "orphan_rows",
            "parent_unique",
            F.when(~F.col("parent_unique"), "many_to_many")
            .when(F.col("most_children") == 1, "one_to_one")
            .otherwise("many_to_one")
            .alias("cardinality"),
        )
    )


def discover_references(catalog: Catalog, least: float = 1.0, likely: dict[str, list[str]] | None = None) -> DataFrame:
    """References found by name and by value: unique parent, inclusion of at least ``least``.

    Parents that cannot be unique are not compared at all.
    """
    likely = promising_columns(catalog) if likely is None else likely
    pairs = [p for p in reference_pairs(catalog) if p.parent_column in likely.get(p.parent_table, ())]
    found = reference_inclusion(catalog, pairs)
    return found.filter(F.col("parent_unique") & (F.col("inclusion") >= least))
