import pyarrow as pa

from tabulight.llm import frames


def test_staged_jobs_move_small_batches(spark):
    """Batches are bounded by bytes while a staged job runs, no row is lost, and the session keeps its setting."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    before = spark.conf.get(frames.BATCH_LIMIT)
    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) AS t")
    found = frames.stage(wide.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r["n"] for r in found) == 4000
    assert max(r["size"] for r in found) < 9_000_000
    assert spark.conf.get(frames.BATCH_LIMIT) == before


def test_a_filtered_text_travels_once(spark):
    """The function reads the bytes of the text column itself; nulls are none, the other columns stay as they are."""
    rows = spark.createDataFrame([(1, "Äb", "x"), (2, None, "y"), (3, "c", None), (4, "", "z")], "n long, Text string, other string")
    kept = frames.arrow_filter(rows, "text", lambda: lambda bodies: [b is None or b == "Äb".encode() for b in bodies])
    assert [tuple(r) for r in kept.orderBy("n").collect()] == [(1, "Äb", "x"), (2, None, "y")]
    seen = frames.arrow_filter(rows, "Text", lambda: lambda bodies: [True] * len(bodies))
    assert "AS BINARY" not in seen._jdf.queryExecution().toString().upper()
