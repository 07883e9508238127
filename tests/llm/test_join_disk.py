import random

from tabulight.llm import frames, jaccard_join


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString("\n").split("\n") if name.startswith("shuffle")}


def test_a_staged_job_leaves_no_shuffle_files(spark):
    """They go when the job ends, whenever the driver collects its garbage; the session keeps its setting."""
    setting = spark.conf.get(frames.CLEANUP)
    sums = spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").repartition(3, "k")
    before = shuffle_files(spark)
    made = frames.stage(sums)
    assert not [name for name in shuffle_files(spark) - before if name.endswith(".data")]
    sums.write.format("noop").mode("overwrite").save()  # a job that is not staged: files are seen where they lie
    assert [name for name in shuffle_files(spark) - before if name.endswith(".data")]
    assert made.count() == 7 and spark.conf.get(frames.CLEANUP) == setting


def test_whole_sets_are_read_only_where_signatures_fit(spark, monkeypatch):
    """Texts that share a minimum but too little else are told apart by their signatures; near copies still link."""
    rng = random.Random(3)
    rows = []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(300)]
        rows.append((10 * family, " ".join(base)))
        rows.append((10 * family + 1, " ".join(base[:200] + [f"x{rng.random()}" for _ in range(100)])))
        if family % 4 == 0:
            rows += [(10 * family + 2, " ".join([*base[:-3], "end"])), (10 * family + 3, " ".join(["start", *base[2:]]))]
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    asked, verified = [], jaccard_join.verified

    def noted(df, key, text, words, percent, common, found, sizes, whole=True):
        if not whole:
            asked.extend(r["id"] for r in found.select("id").distinct().collect())
        return verified(df, key, text, words, percent, common, found, sizes, whole)

    monkeypatch.setattr(jaccard_join, "verified", noted)
    made = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    near = {i: i - i % 10 for i, _ in rows if i is not None and i < 900 and i % 10 != 1}
    assert made == {i: near.get(i, i) for i, _ in rows} | {902: 0, None: None}
    assert asked and not [i for i in asked if i % 10 == 1]
