"""Texts to chunks: line windows, table descriptions, JSON findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import json_lines
from ..functions.text import line_chunks

CHUNK_COLUMNS = ("phase", "source", "chunk_no", "content", "kind", "table_name")
# Fixed value: rows shown in a sample block.
SAMPLE_ROWS = 3


def chunk_documents(
    docs: DataFrame,
    text: str,
    source: Column,
    phase: Column,
    size: int = 1000,
    overlap: int = 200,
) -> DataFrame:
    """One row per line window of each document; blank windows dropped."""
    pieces = F.posexplode(line_chunks(F.col(text), size, overlap)).alias("chunk_no", "content")
    return (
        docs.select(phase.alias("phase"), source.cast("string").alias("source"), pieces)
        .filter("content IS NOT NULL")
        .withColumn("kind", F.lit("knowledge_chunk"))
        .withColumn("table_name", F.lit(None).cast("string"))
        .select(*CHUNK_COLUMNS)
    )


def table_text(report: DataFrame) -> DataFrame:
    """The schema block of each table report."""
    # The lines of the block.
    keys = F.col("constraints")
    columns = F.transform(
        "schema",
        lambda c: F.concat(
            F.lit("  - "), c["name"], F.lit(" ("), c["type"], F.lit(", nullable: "),
            c["nullable"].cast("string"), F.lit(")\n"),
        ),
    )
    primary = F.when(
        F.size(keys["primary_keys"]) > 0,
        F.concat(F.lit("  Primary Keys: ["), F.array_join(keys["primary_keys"], " "), F.lit("]\n")),
    ).otherwise("")
    foreign = F.when(
        F.size(keys["foreign_keys"]) > 0,
        F.concat(
            F.lit("  Foreign Keys:\n"),
            F.array_join(
                F.transform(keys["foreign_keys"], lambda k: F.concat(F.lit("    - "), k, F.lit("\n"))), ""
            ),
        ),
    ).otherwise("")
    text = F.concat(
        F.lit("Table: "), "table_name", F.lit("\nColumns:\n"), F.array_join(columns, ""),
        F.lit("Constraints:\n"), primary, foreign,
    )
    return report.select("table_name", text.alias("content"))


def sample_text(report: DataFrame) -> DataFrame:
    """The sample block of each table report that has samples."""
    # The lines of the block.
    lines = F.transform(
        F.slice("samples", 1, SAMPLE_ROWS),
        lambda s, i: F.concat(F.lit("Sample "), i + 1, F.lit(": "), s, F.lit("\n")),
    )
    text = F.concat(F.lit("Sample data for table: "), "table_name", F.lit("\n"), F.array_join(lines, ""))
    return report.filter(F.size("samples") > 0).select("table_name", text.alias("content"))


def chunk_sections(
    report: DataFrame, findings: DataFrame | None = None, size: int = 1000, overlap: int = 200
) -> DataFrame:
    """Schema and sample blocks of table reports, line windows of other findings.

    ``findings`` has ``phase``, ``source`` and ``body`` (JSON) columns.
    """

    def block(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            F.lit("phase1").alias("phase"),
            F.lit("phase1_analysis.json").alias("source"),
            F.lit(0).alias("chunk_no"),
            "content",
            F.lit(kind).alias("kind"),
            "table_name",
        )

    chunks = block(table_text(report), "table_schema").unionByName(block(sample_text(report), "table_samples"))
    if findings is None:
        return chunks
    texts = findings.withColumn("text", json_lines(F.col("body")))
    return chunks.unionByName(
        chunk_documents(texts, "text", F.col("source"), F.col("phase"), size, overlap)
    )
