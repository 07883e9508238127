"""Mask sensitive columns, found by name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a column name says about its values, first match wins, and how to hide them:
# "hide" drops the value, "hash" keeps equality, "tail" keeps the last four
# characters, "email" keeps the domain.
MASK_RULES = (
    ("password|passwd|secret|token|api_?key|private_?key|certificate|credential", "hide"),
    ("email", "email"),
    ("phone|mobile|fax", "tail"),
    ("birth|ssn|passport|(^|_)name$|street|address|(^|_)ip$|(^|_)host", "hash"),
)
HIDDEN = "***"


def mask_kind(column: str, rules: Sequence[tuple[str, str]] = MASK_RULES) -> str | None:
    for pattern, kind in rules:
        if re.search(pattern, column.lower()):
            return kind
    return None


def masked(column: Column, kind: str) -> Column:
    text = column.cast("string")
    if kind == "hide":
        return F.when(text.isNotNull(), F.lit(HIDDEN))
    if kind == "hash":
        return F.sha2(text, 256)
    if kind == "email":
        return F.regexp_replace(text, "^[^@]*", HIDDEN)
    return F.when(
        F.length(text) > 4, F.concat(F.repeat(F.lit("*"), F.length(text) - 4), F.right(text, F.lit(4)))
    ).otherwise(F.repeat(F.lit("*"), F.length(text)))


def mask_columns(df: DataFrame, rules: Sequence[tuple[str, str]] = MASK_RULES) -> DataFrame:
    """All columns, those with a sensitive name masked as text."""
    out = []
    for name in df.columns:
        kind = mask_kind(name, rules)
        out.append(masked(F.col(f"`{name}`"), kind).alias(name) if kind else F.col(f"`{name}`"))
    return df.select(*out)
