"""Pages far into an order, without sorting the rows before them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .profile import RECENT_COLUMNS, name_of


def page_order(df: DataFrame, recent: Iterable[str], tiebreak: Iterable[str]) -> list[tuple[str, Column, bool]]:
    """(name, value, descending) of what a page is ordered by; nulls come first in either direction."""
    present = [F.col(name_of(c)) for c in recent if c in df.columns]
    order = [("k0", F.coalesce(*present), True)] if present else []
    return order + [(f"k{i}", F.col(name_of(c)), False) for i, c in enumerate(tiebreak, 1)]


def _precedes(value: Column, mark, descending: bool) -> Column:
    """Whether a value stands before another one; nothing stands before a null."""
    if mark is None:
        return F.lit(False)
    mark = F.lit(mark)
    return value.isNull() | (value > mark if descending else value < mark)


def _before(order: list[tuple[str, Column, bool]], marks: dict) -> Column:
    """Whether a row stands before the row with these order values."""
    cases, same = [], F.lit(True)
    for name, value, descending in order:
        cases.append(same & _precedes(value, marks[name], descending))
        same = same & value.eqNullSafe(F.lit(marks[name]))
    return reduce(Column.__or__, cases)


def _same(order: list[tuple[str, Column, bool]], marks: dict) -> Column:
    return reduce(Column.__and__, [value.eqNullSafe(F.lit(marks[name])) for name, value, _ in order])


def deep_page(
    df: DataFrame, n: int, offset: int, recent: Iterable[str] = RECENT_COLUMNS, tiebreak: Iterable[str] = ()
) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of the newest-first order, and ``row_count``, the rows of the table.

    Only the order columns are dealt out, by range; counts per partition tell which
    partitions hold the page, and just those are sorted. Its first and last order values
    then pick the rows themselves by a filter that reaches the scan. ``tiebreak`` should
    make the order total; rows that are equal in it come in any order. A page past the
    end is empty. Without any order column the first rows that are found are as good as others.
    """
    order = page_order(df, recent, tiebreak)
    if not order:
        return df.limit(n).withColumn("row_count", F.lit(df.count()))
    names = [F.desc_nulls_first(name) if descending else F.asc_nulls_first(name) for name, _, descending in order]
    keys = df.select(*[value.alias(name) for name, value, _ in order])
    dealt = stage(keys.repartitionByRange(*names).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # a row a partition
    total, wanted, before, seen = sum(counts.values()), [], 0, 0
    for part in sorted(counts):
        if seen + counts[part] <= offset:
            before += counts[part]
        elif seen < offset + n:
            wanted.append(part)
        seen += counts[part]
    empty = df.limit(0).withColumn("row_count", F.lit(total))
    if not wanted or n <= 0:
        return empty
    near = dealt.filter(F.col("part").isin(*wanted))
    page = near.orderBy(*names).offset(offset - before).limit(n).collect()
    first, last = page[0].asDict(), page[-1].asDict()
    held = [(name, F.col(name), descending) for name, _, descending in order]
    # rows equal to the first one may stand before the page
    skipped = offset - before - near.filter(_before(held, first)).count()
    inside = ~F.coalesce(_before(order, first), F.lit(False)) & (F.coalesce(_before(order, last), F.lit(False)) | _same(order, last))
    # the leading value alone is what a scan can use
    name, lead, descending = order[0]
    if first[name] is not None and last[name] is not None:
        low, high = (last[name], first[name]) if descending else (first[name], last[name])
        inside = (lead >= F.lit(low)) & (lead <= F.lit(high)) & inside
    rows = df.withColumns({name: value for name, value, _ in order}).filter(inside)
    return rows.orderBy(*names).offset(skipped).limit(n).drop(*[name for name, _, _ in order]).withColumn("row_count", F.lit(total))
