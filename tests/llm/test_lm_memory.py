from tabulight.llm import lm_scoring


def rows_of(spark, count):
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(40))) for i in range(count)]
    return spark.createDataFrame([*texts, (None, "w1 w2 w3"), (count, None)], "doc_id long, text string").coalesce(1)


def test_counts_of_many_batches_make_one_row_a_shard(spark):
    """How many n-grams are counted at once follows from their number, not from the size of the Arrow batches."""
    texts = rows_of(spark, 60).selectExpr("coalesce(cast(text AS binary), cast('' AS binary)) AS body")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        whole = lm_scoring.packed_counts(texts, 3, (0, 1)).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        cut = lm_scoring.packed_counts(texts, 3, (0, 1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(cut) == len({(r["kind"], r["shard"]) for r in cut})
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))


def test_no_texts_or_levels_are_left_to_the_job_that_reads_the_scores(spark):
    """That job is the caller's, with batches as large as the session allows: it has only numbers to join."""
    rows = rows_of(spark, 40)
    made = lm_scoring.lm_score(rows)
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = {r["doc_id"]: r for r in made.collect()}
    assert len(found) == 42 and found[40]["n_tokens"] == 1 and found[None]["held_out"] and found[None]["n_tokens"] == 4


def test_batches_of_texts_stay_small_beside_the_filter(spark, monkeypatch):
    """Every staged job of the scoring moves batches of MOVED_BYTES; the session's own setting comes back."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen, stage_at = [], lm_scoring.stage_at

    def noted(df, *args, **options):
        seen.append(args)
        return stage_at(df, *args, **options)

    monkeypatch.setattr(lm_scoring, "stage_at", noted)
    before = spark.conf.get(limit)
    lm_scoring.lm_score(rows_of(spark, 10)).collect()
    assert seen and set(seen) == {(lm_scoring.MOVED_BYTES,)} and spark.conf.get(limit) == before


def test_the_driver_holds_a_filter_part_once(spark):
    """A part is put together where it stays, not from a list of its pieces."""
    import tracemalloc

    words = 1 << 18
    counted = spark.range(0, 6, 1, 6).selectExpr(
        "cast(id % 2 AS int) AS kind", "cast(id div 2 AS int) AS shard", f"cast(repeat(char(97 + id), {8 * words}) AS binary) AS bits"
    )
    plan = lm_scoring.filter_plan(counted)
    assert len(plan) == 1
    tracemalloc.start()
    shared = lm_scoring.filter_part(counted, 3, plan[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    made = shared.value
    assert made.bits.nbytes == 8 * (6 * words + 1) and peak < 1.9 * made.bits.nbytes
    for kind in (0, 1):
        for shard in range(3):
            at = made.start[kind, shard]
            assert made.size[kind, shard] == words
            assert set(made.bits[at : at + words].tobytes()) == {97 + kind + 2 * shard}
