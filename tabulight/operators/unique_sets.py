"""Keys of several columns, found in the data: a search through column sets from small to large.

A set is tried only if no part of it is a key already, so all results are minimal. Before
the values of a set are shuffled, the product of its columns' distinct counts must reach
the row count. Sets of a large table are then counted exactly among a share of the values:
one combination that comes twice there proves that a set is no key, and costs little.
What is left of all tables is counted exactly over all rows, in one shuffle a level.
"""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, literal_rows, type_family
from .keys import key_checks, key_value
from .profile import distinct_counts, name_of, union_all

# An estimate has 1.6 percent standard error, so a true key's does not fall below this share.
SKETCH_SHARE = 0.9
SETS_PER_AGGREGATE = 32
# A share has about so many rows, and so many values of a set's leading column at least.
SHARE_ROWS, SHARE_VALUES = 1 << 17, 64


def combined_sketch(columns: tuple[str, ...]) -> str:
    """SQL for the estimated number of distinct combinations."""
    return f"hll_sketch_estimate(hll_sketch_agg(xxhash64({', '.join(map(name_of, columns))})))"


def estimates(catalog: Catalog, wanted: dict[str, list[tuple[str, ...]]]) -> dict[tuple[str, tuple[str, ...]], tuple[int, int, int]]:
    """(rows, complete rows, estimated combinations) of each column set; a row per set reaches the driver."""
    frames, labels = [], []
    for table, sets in wanted.items():
        for first in range(0, len(sets), SETS_PER_AGGREGATE):
            stats = []
            for columns in sets[first : first + SETS_PER_AGGREGATE]:
                complete = f"count_if({' AND '.join(f'{name_of(c)} IS NOT NULL' for c in columns)})"
                stats.append(f"named_struct('at', {len(labels)}, 'n', count(1), 'complete', {complete}, 'distinct', {combined_sketch(columns)})")
                labels.append((table, columns))
            frames.append(catalog[table].agg(F.expr(f"array({', '.join(stats)})").alias("s")).select(F.inline("s")))
    if not frames:
        return {}
    return {labels[r["at"]]: (r["n"], r["complete"], r["distinct"]) for r in union_all(frames).collect()}


def next_sets(columns: list[str], size: int, keys: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The sets of ``size`` columns of which no part is a key."""
    return [s for s in combinations(columns, size) if not any(set(k) <= set(s) for k in keys)]


def repeated_sets(
    catalog: Catalog, wanted: dict[str, list[tuple[str, ...]]], known: dict[tuple[str, tuple[str, ...]], tuple[int, int, int]]
) -> set[tuple[str, tuple[str, ...]]]:
    """The (table, set) of which a combination is found twice in a share of the rows.

    A share takes all rows of some values of the set's leading column, which is the one with
    the most values, so it holds all rows of a combination or none. A set that is not returned
    may be a key or not. ``known`` has the rows and estimated values of single columns.
    """
    tables, entries, labels = {}, {}, []
    for table, sets in wanted.items():
        shares = []
        for columns in sets:
            lead = max(columns, key=lambda c: known[table, (c,)][2])
            rows, _, values = known[table, (lead,)]
            parts = min(rows // SHARE_ROWS, values // SHARE_VALUES)
            if parts < 2:
                continue
            share = f"pmod(xxhash64({name_of(lead)}), {parts}) = 0"
            value = {slot: f"CASE WHEN {share} THEN {text} END" for slot, text in key_value(catalog[table], columns).items()}
            entries.setdefault(table, []).append((len(labels), value))
            labels.append((table, columns))
            shares.append(share)
        if shares:
            tables[table] = catalog[table].filter(" OR ".join(sorted(set(shares))))
    if not labels:
        return set()
    return {labels[r["tag"]] for r in distinct_counts(tables, entries).filter("distinct_count < present").collect()}


def unique_column_sets(catalog: Catalog, largest: int = 3) -> DataFrame:
    """(table_name, key_columns, set_size, row_count): all minimal keys of up to ``largest`` columns.

    A key has no null in any of its columns and no combination twice. Columns of numbers,
    texts, times and booleans are tried, in table order. A table whose full rows repeat
    has no key and is left after one look; one without rows has none either. The search
    keeps names of columns on the driver, never values.
    """
    spark = next(iter(catalog.tables.values())).sparkSession
    singles = {
        t: [(f.name,) for f in catalog[t].schema.fields if type_family(f.dataType) in ("number", "text", "time", "bool")]
        for t in catalog.names
    }
    singles = {t: s for t, s in singles.items() if s}
    known = estimates(catalog, singles)
    # A column with a null is in no key.
    columns = {t: [c for (c,) in s if known[t, (c,)][0] and known[t, (c,)][0] == known[t, (c,)][1]] for t, s in singles.items()}
    whole = estimates(catalog, {t: [tuple(c)] for t, c in columns.items() if c})
    columns = {
        t: c for t, c in columns.items() if c and whole[t, tuple(c)][2] >= SKETCH_SHARE * whole[t, tuple(c)][0]
    }
    keys: dict[str, list[tuple[str, ...]]] = {t: [] for t in columns}
    rows = []
    for size in range(1, largest + 1):
        tried = {}
        for table, names in columns.items():
            n = known[table, (names[0],)][0]
            reach = {c: known[table, (c,)][2] / SKETCH_SHARE for c in names}
            tried[table] = [s for s in next_sets(names, size, keys[table]) if prod(reach[c] for c in s) >= n]
        tried = {t: s for t, s in tried.items() if s}
        repeated = repeated_sets(catalog, tried, known) if size > 1 else {
            (t, s) for t, sets in tried.items() for s in sets if known[t, s][2] < SKETCH_SHARE * known[t, s][0]
        }
        likely = {t: [s for s in sets if (t, s) not in repeated] for t, sets in tried.items()}
        likely = {t: s for t, s in likely.items() if s}
        if not likely:
            continue
        named = {(t, ",".join(s)): s for t, sets in likely.items() for s in sets}
        for r in key_checks(catalog, likely).filter("is_key").collect():
            keys[r["table_name"]].append(named[r["table_name"], r["key_columns"]])
            rows.append({"table_name": r["table_name"], "key_columns": r["key_columns"], "set_size": size, "row_count": r["row_count"]})
    return literal_rows(spark, rows, "table_name string, key_columns string, set_size int, row_count bigint")
