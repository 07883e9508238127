"""The stages end to end: profile, ask, decide, clean, classify, model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import business_area, table_category
from ..operators import business, decisions, findings, keys, profile, star
from ..sources.catalog import Catalog, column_descriptors, declared_constraints


@dataclass
class Model:
    """What the stages found."""

    areas: DataFrame
    domain: DataFrame
    labels: DataFrame
    dimensions: DataFrame
    facts: DataFrame
    report: DataFrame
    totals: DataFrame


def column_findings(catalog: Catalog) -> DataFrame:
    """Columns with issues over whole tables."""
    stats = findings.with_key_flags(findings.findings_profile(catalog), catalog)
    return findings.column_issues(stats)


def clean_catalog(
    catalog: Catalog, table_answers: DataFrame | None = None, column_answers: DataFrame | None = None
) -> Catalog:
    """Apply a person's answers: dropped tables first, then removed and converted columns."""
    if table_answers is not None:
        asked = findings.table_questions(profile.row_counts(catalog))
        answered = decisions.answer_questions(asked, table_answers)
        exploded = answered.withColumn("table_name", F.explode("related_tables"))
        catalog = decisions.apply_table_decisions(catalog, decisions.table_decisions(exploded))
    if column_answers is not None:
        asked = findings.column_questions(column_findings(catalog))
        answered = decisions.answer_questions(asked, column_answers)
        catalog = decisions.apply_column_decisions(catalog, decisions.column_decisions(answered))
    return catalog


def table_descriptions(catalog: Catalog) -> DataFrame:
    """A sentence per table from its size and columns."""
    frames = []
    for name in catalog.names:
        listed = ", ".join(catalog[name].columns)
        count = F.count(F.lit(1)).cast("string")
        text = F.concat(
            F.lit(f"Table {name} holds "), count, F.lit(f" rows in {len(catalog[name].columns)} columns. "),
            F.lit(f"They are {listed}."),
        )
        frames.append(catalog[name].agg(text.alias("description")).select(F.lit(name).alias("table_name"), "description"))
    return profile.union_all(frames)


def model_catalog(
    spark: SparkSession, catalog: Catalog, key_sets: dict | None = None, rules: DataFrame | None = None
) -> Model:
    """Areas, domain and labels by name and description; star schema from keys in the data and a caller's rules."""
    described = table_descriptions(catalog)
    areas = described.select(
        F.lit(catalog.database).alias("source"),
        "table_name",
        business_area(F.col("table_name"), F.col("description")).alias("area"),
        table_category(F.col("table_name")).alias("category"),
    )
    columns = column_descriptors(spark, catalog)
    likely = keys.promising_columns(catalog)
    found_keys = keys.key_candidates(catalog, key_sets, likely)
    references = keys.discover_references(catalog, likely=likely)
    dimensions = star.detect_dimensions(columns, found_keys, declared_constraints(spark, catalog), rules)
    facts = star.detect_facts(columns, found_keys, references, rules)
    return Model(
        areas=areas,
        domain=business.infer_domain(areas),
        labels=business.business_labels(areas),
        dimensions=dimensions,
        facts=facts,
        report=business.dimension_report(dimensions),
        totals=business.model_totals(dimensions, facts),
    )
