import json
import os

import pytest
from pyspark.sql import functions as F

from tabulight.functions.jsontext import findings_text
from tabulight.operators import chunks
from tabulight.sources import knowledge
from tabulight.streaming.index_stream import empty_store, index_arrivals


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "phase string, source string, text string").coalesce(1)


def cut(df):
    return chunks.chunk_documents(df, "text", F.col("source"), F.col("phase"), 4, 1)


def stats(df):
    return {r["phase"]: r["chunk_count"] for r in df.collect()}


BODY = "\n".join(f"row {i} of table customer" for i in range(9))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("phase1", "a", BODY), ("phase2", "b", "one\ntwo"), ("phase3", "c", "three")]
    knowledge.rebuild_store(knowledge.build_store_rows(cut(docs_frame(spark, rows))), path)
    return path


def test_store_round_trip(spark, store):
    scanned = knowledge.scan_chunks(spark, store)
    assert stats(knowledge.knowledge_stats(scanned)) == {"phase1": 3, "phase2": 1, "phase3": 1}
    row = scanned.filter("phase = 'phase2'").first()
    assert row["content"] == "one\ntwo" and len(row["vector"]) == 256
    assert row["metadata"]["source"] == "b" and row["metadata"]["type"] == "knowledge_chunk"
    plan = knowledge.scan_chunks(spark, store, ["phase2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(phase" in plan or "PartitionFilters: [(phase" in plan


def test_replace_phase_keeps_others(spark, store):
    rows = knowledge.build_store_rows(cut(docs_frame(spark, [("phase1", "a", "new")])))
    knowledge.replace_phases(rows, store)
    assert stats(knowledge.knowledge_stats(knowledge.scan_chunks(spark, store))) == {"phase1": 1, "phase2": 1, "phase3": 1}


def test_append(spark, store):
    knowledge.append_chunks(knowledge.build_store_rows(cut(docs_frame(spark, [("phase2", "d", "more")]))), store)
    assert stats(knowledge.knowledge_stats(knowledge.scan_chunks(spark, store)))["phase2"] == 2


def test_delete_phase_and_list(spark, store):
    assert stats(knowledge.delete_by_metadata(spark, store, "phase", "phase2")) == {"phase1": 3, "phase3": 1}
    assert stats(knowledge.delete_phases(spark, store, "phase1, phase3")) == {}
    with pytest.raises(ValueError):
        knowledge.delete_phase(spark, store, "../x")


def test_delete_by_other_metadata(spark, store):
    knowledge.append_chunks(knowledge.build_store_rows(cut(docs_frame(spark, [("phase2", "d", "more")]))), store)
    assert stats(knowledge.delete_by_metadata(spark, store, "source", "b")) == {"phase1": 3, "phase2": 1, "phase3": 1}
    assert stats(knowledge.delete_by_metadata(spark, store, "source", "c")) == {"phase1": 3, "phase2": 1}
    assert stats(knowledge.delete_by_metadata(spark, store, "source", "none")) == {"phase1": 3, "phase2": 1}


def test_update_adds_only_new_content(spark, store):
    rows = [("phase1", "a", BODY), ("phase2", "x", "fresh"), ("phase2", "y", "fresh"), ("phase3", "z", "three")]
    knowledge.update_index(spark, cut(docs_frame(spark, rows)), store)
    assert stats(knowledge.knowledge_stats(knowledge.scan_chunks(spark, store))) == {"phase1": 3, "phase2": 2, "phase3": 1}
    fresh = knowledge.scan_chunks(spark, store).filter("content = 'fresh'").collect()
    assert [r["source"] for r in fresh] == ["x"]
    knowledge.update_index(spark, cut(docs_frame(spark, rows)), store)
    assert knowledge.scan_chunks(spark, store).count() == 6


def test_export(spark, store, tmp_path):
    out = str(tmp_path / "export")
    knowledge.export_knowledge(knowledge.scan_chunks(spark, store), out)
    assert sorted(x for x in os.listdir(out + "/chunks") if x.startswith("phase=")) == ["phase=phase1", "phase=phase2", "phase=phase3"]
    assert spark.read.json(out + "/chunks").count() == 5
    assert spark.read.json(out + "/summary").agg(F.sum("chunk_count")).first()[0] == 5


def test_bad_vectors_are_skipped(spark):
    df = spark.createDataFrame([(1, "[0.5, 1]"), (2, "oops"), (3, None)], "id int, vector string")
    assert [tuple(r) for r in knowledge.decode_vectors(df, "vector").collect()] == [(1, [0.5, 1.0])]


def test_findings_to_chunks(spark):
    df = spark.createDataFrame([(json.dumps({"a": {"b": 1}}),)], "body string")
    texts = df.select(findings_text("phase2", F.col("body"), F.lit("t")).alias("text"))
    found = chunks.chunk_documents(texts, "text", F.lit("phase_phase2"), F.lit("phase2")).collect()
    assert len(found) == 1 and found[0]["content"].endswith("a:\n  b:\n    1")


def test_stream_of_files(spark, tmp_path):
    store, inbox, mark = (str(tmp_path / n) for n in ("store", "inbox", "mark"))
    empty_store(spark, store)
    assert knowledge.scan_chunks(spark, store).count() == 0
    schema = "phase string, source string, text string"
    docs_frame(spark, [("phase1", "a", "x\ny"), ("phase1", "b", "x\ny")]).write.parquet(inbox)

    def run():
        arrivals = spark.readStream.schema(schema).parquet(inbox)
        index_arrivals(spark, arrivals, "text", F.col("source"), F.col("phase"), store, mark).awaitTermination()

    run()
    assert knowledge.scan_chunks(spark, store).count() == 1
    docs_frame(spark, [("phase2", "c", "x\ny"), ("phase2", "d", "z")]).write.mode("append").parquet(inbox)
    run()
    assert sorted(r["content"] for r in knowledge.scan_chunks(spark, store).collect()) == ["x\ny", "z"]
