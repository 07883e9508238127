"""The knowledge store: chunks with vectors in Parquet, one folder per phase.

Chunk rows: ``chunk_id, source, chunk_no, content, content_hash, metadata, vector, phase``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import embed
from .staging import small_side, stage

STORE_SCHEMA = (
    "chunk_id string, source string, chunk_no int, content string, content_hash string, "
    "metadata map<string,string>, vector array<double>, phase string"
)
STORE_COLUMNS = [part.split()[0] for part in STORE_SCHEMA.split(", ")]


def hashed(chunks: DataFrame) -> DataFrame:
    """Chunks with the digest of their content and an id that a re-run repeats."""
    digest = chunks.withColumn("content_hash", F.sha2("content", 256))
    parts = F.concat_ws("\u0001", "phase", "source", F.col("chunk_no").cast("string"), "content_hash")
    return digest.withColumn("chunk_id", F.sha2(parts, 256))


def embedded(chunks: DataFrame, embedder="tfidf", timestamp: Column | None = None) -> DataFrame:
    """Store rows: hashed chunks with metadata and vector."""
    stamp = (F.current_timestamp() if timestamp is None else timestamp).cast("string")
    entries = {
        "source": F.col("source"),
        "type": F.col("kind"),
        "table": F.col("table_name"),
        "phase": F.col("phase"),
        "timestamp": stamp,
    }
    full = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    metadata = F.map_filter(full, lambda k, v: v.isNotNull())
    return (
        chunks.withColumn("metadata", metadata)
        .withColumn("vector", embed(F.col("content"), embedder))
        .select(*STORE_COLUMNS)
    )


def build_store_rows(chunks: DataFrame, embedder="tfidf", timestamp: Column | None = None) -> DataFrame:
    return embedded(hashed(chunks), embedder, timestamp)


def append_chunks(rows: DataFrame, path: str) -> None:
    rows.select(*STORE_COLUMNS).write.mode("append").partitionBy("phase").parquet(path)


def replace_phases(rows: DataFrame, path: str) -> None:
    """Overwrite the phases that occur in ``rows``; others stay."""
    (
        rows.select(*STORE_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("phase")
        .parquet(path)
    )


def rebuild_store(rows: DataFrame, path: str) -> None:
    """Clear the store and write it anew."""
    (
        rows.select(*STORE_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("phase")
        .parquet(path)
    )


def scan_chunks(spark: SparkSession, path: str, phases: Sequence[str] | None = None) -> DataFrame:
    """All chunks, or those of some phases (only their folders are read)."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(path)
    return rows.filter(F.col("phase").isin(*phases)) if phases else rows


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """JSON-text vectors as arrays; rows whose text is not a vector are dropped."""
    vector = F.from_json(F.col(column), "array<double>")
    return df.withColumn(column, vector).filter(F.col(column).isNotNull())


def without_metadata(chunks: DataFrame, key: str, value: str) -> DataFrame:
    """Chunks whose metadata value differs or is missing."""
    return chunks.filter(~F.col("metadata")[key].eqNullSafe(F.lit(value)))


def _drop_folder(spark: SparkSession, path: str, phase: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", phase):
        raise ValueError(f"unusable phase name: {phase!r}")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/phase={phase}")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(folder, True)


def delete_phase(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """Drop a phase's folder, no rewrite; what is left is counted per phase."""
    _drop_folder(spark, path, phase)
    return knowledge_stats(scan_chunks(spark, path))


def delete_by_metadata(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Delete matching chunks; only the phases that hold some are rewritten.

    Survivors are staged first, so a lost job leaves the store or the staged copy whole.
    """
    if key == "phase":
        return delete_phase(spark, path, value)
    chunks = scan_chunks(spark, path)
    hit = [r[0] for r in chunks.filter(F.col("metadata")[key] == value).select("phase").distinct().collect()]
    if hit:
        survivors = stage(without_metadata(scan_chunks(spark, path, hit), key, value))
        kept = {r[0] for r in survivors.select("phase").distinct().collect()}
        replace_phases(survivors, path)
        for phase in hit:
            if phase not in kept:
                _drop_folder(spark, path, phase)
    return knowledge_stats(scan_chunks(spark, path))


def delete_phases(spark: SparkSession, path: str, phases: str) -> DataFrame:
    """Drop a comma list of phases."""
    for phase in filter(None, (p.strip() for p in phases.split(","))):
        _drop_folder(spark, path, phase)
    return knowledge_stats(scan_chunks(spark, path))


def new_chunks(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashed chunks whose content is not stored yet, each content once: its first place by phase, source and number.

    Only digests and places are compared and shuffled; contents stay in their rows until
    it is known which are new. The places of those are broadcast where they measure few,
    so that the contents of all other chunks are not moved at all.
    """
    place = ["phase", "source", "chunk_no"]
    first = candidates.groupBy("content_hash").agg(F.min(F.struct(*place)).alias("first"))
    fresh = first.join(stored.select("content_hash"), "content_hash", "left_anti").select("content_hash", "first.*")
    size = F.lit(64) + sum((F.coalesce(F.octet_length(f"{c}_"), F.lit(0)) for c in place[:2]), F.lit(16))
    wanted = small_side(fresh.select(*[F.col(c).alias(f"{c}_") for c in ("content_hash", *place)]), size)
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in place]
    found = candidates.join(wanted, [F.col("content_hash") == F.col("content_hash_"), *same], "left_semi")
    # The same place may come twice with one content; only new contents get here.
    rest = [c for c in candidates.columns if c not in ("content_hash", *place)]
    once = found.groupBy("content_hash").agg(F.min(F.struct(*place, *rest)).alias("first"))
    return once.select("content_hash", "first.*").select(*candidates.columns)


def update_index(spark: SparkSession, chunks: DataFrame, path: str, embedder="tfidf") -> None:
    """Append chunks not stored yet; vectors are made for those only.

    The new rows are written in full before they are added, since they are found by
    reading the store they go to.
    """
    fresh = new_chunks(hashed(chunks), scan_chunks(spark, path))
    append_chunks(stage(embedded(fresh, embedder)), path)


def knowledge_stats(chunks: DataFrame) -> DataFrame:
    """Chunks per phase."""
    return chunks.groupBy("phase").agg(F.count(F.lit(1)).alias("chunk_count"))


def source_stats(chunks: DataFrame) -> DataFrame:
    """Chunks per source."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(grouping, name, chunk_count): chunks per phase, per source and in all, from one pass; no rows for no chunks."""
    sets = chunks.groupingSets([["phase"], ["source"], []], "phase", "source")
    found = sets.agg(F.count(F.lit(1)).alias("chunk_count"), F.grouping("phase").alias("p"), F.grouping("source").alias("s"))
    kind = F.when(F.col("p") == 0, "phase").when(F.col("s") == 0, "source").otherwise("total")
    return found.select(kind.alias("grouping"), F.coalesce("phase", "source").alias("name"), "chunk_count")


def export_knowledge(chunks: DataFrame, path: str) -> None:
    """JSON lines in one folder per phase, and a summary with counts and time.

    A phase is never gathered in one document, so its size does not matter.
    """
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("phase").json(
        f"{path.rstrip('/')}/chunks"
    )
    summary = knowledge_stats(chunks).withColumn("export_timestamp", F.current_timestamp())
    summary.write.mode("overwrite").json(f"{path.rstrip('/')}/summary")
