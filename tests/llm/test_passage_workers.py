from tabulight.llm import substrings


def test_no_task_of_passage_removal_keeps_two_python_workers(spark):
    """Where words are joined, texts are told apart by the same function, not by another one before it."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame(
        [(1, passage), (2, f"a {passage} b"), (3, "c d"), (4, None), (None, passage), (5, "")], "doc_id long, text string"
    )
    made = substrings.remove_repeats(rows)
    assert {tuple(r) for r in made.collect()} == {
        (1, 60, 0, passage), (2, 62, 60, "a b"), (3, 2, 0, "c d"), (4, 0, 0, ""), (None, 60, 0, passage), (5, 0, 0, ""),
    }
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
