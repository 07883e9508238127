"""The documents' way to training data: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulight.llm import decontaminate, jaccard_join, language_id, pieces, quality
from tabulight.llm.frames import stage
from tabulight.llm.queries import model_path, table

WORDS, PERCENT = 5, 80


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models, trained on these documents, recognise."""
    return language_id.drop_rejected(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality trees, trained on the labelled ones of these documents, do not reject."""
    return quality.drop_low(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, words=WORDS, percent=PERCENT)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and token_ids of each document."""
    return pieces.encode(docs, model_path())


STAGES = [
    ("language", recognised), ("quality", good), ("near_duplicates", single), ("decontamination", unseen),
    ("tokens", encoded),
]
# A trained classifier and an edit-distance search are no SQL; the tests hold run() against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
