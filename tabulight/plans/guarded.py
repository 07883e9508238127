"""Read-only SQL with row caps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_MARKS, UNSAFE_WORDS, is_read_only, unsafe_word

# Row caps of the guarded query and of the query tool.
ANSWER_ROWS, TOOL_ROWS = 50, 100


class UnsafeQuery(ValueError):
    """The text is not a plain SELECT."""


def check_read_only(query: str) -> str:
    """The query if it starts with SELECT and has no forbidden word, else UnsafeQuery."""
    upper = query.strip().upper()
    if not upper.startswith("SELECT"):
        raise UnsafeQuery("only SELECT queries are allowed")
    for word in upper.split():
        if word.strip(TOKEN_MARKS) in UNSAFE_WORDS:
            raise UnsafeQuery(f"forbidden word: {word.strip(TOKEN_MARKS)}")
    return query.strip().rstrip(";")


def capped_query(spark: SparkSession, query: str, rows: int = ANSWER_ROWS) -> DataFrame:
    """The first ``rows`` rows of a read-only query."""
    return spark.sql(check_read_only(query)).limit(rows)


@dataclass(frozen=True)
class QueryResult:
    query: str
    columns: list[str]
    rows: list[dict]
    row_count: int
    truncated: bool


def run_query(spark: SparkSession, query: str, max_rows: int = TOOL_ROWS) -> QueryResult:
    """Rows of a read-only query and whether there were more than ``max_rows``."""
    df = capped_query(spark, query, max_rows + 1)
    rows = [r.asDict() for r in df.collect()]
    return QueryResult(query, df.columns, rows[:max_rows], min(len(rows), max_rows), len(rows) > max_rows)


def query_outcome(spark: SparkSession, query: str, max_rows: int = TOOL_ROWS) -> DataFrame:
    """``row_count`` and ``truncated`` of a capped query, as one row."""
    seen = capped_query(spark, query, max_rows + 1).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(
        F.least("n", F.lit(max_rows).cast("bigint")).alias("row_count"),
        (F.col("n") > max_rows).alias("truncated"),
    )


def audit_queries(log: DataFrame, query: str) -> DataFrame:
    """A query log with ``is_safe`` and the forbidden word found, if any."""
    return log.withColumn("is_safe", is_read_only(F.col(query))).withColumn(
        "forbidden_word", unsafe_word(F.col(query))
    )


def query_log_findings(log: DataFrame) -> DataFrame:
    """Answered questions as findings to store: ``phase, source, body`` (JSON) rows.

    ``log``: query, sql_query, result_count, error, asked_at, insights.
    """
    # The names and texts of the record.
    record = F.struct(
        F.lit("marketing_query").alias("phase"),
        F.lit("Marketing query result with business insights").alias("description"),
        "query",
        "sql_query",
        "result_count",
        (F.coalesce("error", F.lit("")) != "").alias("has_error"),
        F.col("asked_at").cast("string").alias("timestamp"),
        (F.coalesce("insights", F.lit("")) != "").alias("insights_generated"),
    )
    return log.select(
        F.lit("marketing_query").alias("phase"),
        F.lit("phase_marketing_query").alias("source"),
        F.to_json(record).alias("body"),
    )
