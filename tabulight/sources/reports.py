"""Table reports as JSON files with a fixed schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = (
    "table_name string, schema array<struct<name:string,type:string,nullable:boolean>>, "
    "constraints struct<primary_keys:array<string>,foreign_keys:array<string>,unique_keys:array<string>>, "
    "samples array<string>, row_count bigint, column_count int, sample_count int, "
    "has_constraints boolean, has_indexes boolean"
)


DATABASE_SCHEMA = (
    "database string, database_type string, tables_count bigint, generated_at timestamp, "
    "tables array<struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2: ", REPORT_SCHEMA) + ">>"
)


def read_database_report(spark: SparkSession, path: str) -> DataFrame:
    """A stage report written by ``write_report``, one row with every table's report."""
    return spark.read.schema(DATABASE_SCHEMA).json(path)


def table_reports(report: DataFrame) -> DataFrame:
    """The table reports of a stage report, one row each."""
    return report.select(F.inline("tables"))


def write_report(report: DataFrame, path: str) -> None:
    """Replace the report at ``path``."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The report with its types; unknown fields are ignored, missing ones are null."""
    return spark.read.schema(REPORT_SCHEMA).json(path)


def read_table_report(spark: SparkSession, path: str, table: str) -> DataFrame:
    return read_report(spark, path).filter(F.col("table_name") == table)
