import hashlib
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulight.functions import vectors
from tabulight.operators import search

TEXTS = [
    "Order by customer: total revenue, total price. SELECT table!", "", "   ", "分析 銷售 數據 customer",
    "a" * 50, "Sales sales SALES; order? order metric metric product " * 7, "hello, world. foo",
]


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def plain_hash(text, dim=256):
    digest = hashlib.sha256(text.encode()).hexdigest()
    return unit([int(digest[i * 8 : i * 8 + 8], 16) / 2**64 if i < 8 else 0.0 for i in range(dim)])


def plain_charstats(text):
    n = len(text.encode())
    marks = [" ", ".", ","] + list(vectors.LETTERS)
    v = [n / 1000] + [text.count(m) / n if n else 0.0 for m in marks]
    return unit(v + [0.0] * (384 - len(v)))


def plain_tfidf(text, dim=256, stats=True):
    text = text.lower()
    for mark in ".,:;!?":
        text = text.replace(mark, " ")
    tokens = text.split()
    index = {w: i for i, w in enumerate(vectors.VOCABULARY)}
    known = [w for w in tokens if w in index]
    v = [0.0] * dim
    for w in set(known):
        if index[w] < dim:
            v[index[w]] = known.count(w) / len(known) * (1.0 if "customer" in w or "product" in w else 2.0)
    for i in range(min(dim, len(tokens))):
        v[i] += 0.1 * i / len(tokens)
    if stats and dim >= 10:
        size = len(text.encode())
        v[-10:] = [size / 1000, len(tokens) / 100, size / (len(tokens) + 1), len(set(tokens)) / (len(tokens) + 1)] + [
            text.count(t) / 10 for t in vectors.COUNTED_TERMS
        ]
    return unit(v)


@pytest.mark.parametrize(
    "builder, plain",
    [
        (vectors.embed_hash, plain_hash),
        (vectors.embed_charstats, plain_charstats),
        (vectors.embed_tfidf, plain_tfidf),
        (lambda c: vectors.embed_tfidf(c, 40), lambda t: plain_tfidf(t, 40)),
        (lambda c: vectors.embed_tfidf(c, 256, stats=False), lambda t: plain_tfidf(t, 256, stats=False)),
        (lambda c: vectors.embed_hash(c, 5), lambda t: plain_hash(t, 5)),
    ],
)
def test_embeddings_match_plain_python(spark, builder, plain):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").coalesce(1)
    for row in df.select("i", builder(F.col("t")).alias("v")).collect():
        assert np.allclose(row["v"], plain(TEXTS[row["i"]]), atol=1e-12), TEXTS[row["i"]]


def test_tfidf_of_more_texts_than_are_built_at_once(spark):
    """No expression runs over the slots of a vector; texts of all blocks, blank marks of all kinds, and no text."""
    texts = [None if i % 50 == 3 else f"Order\u00a0{i} customer\u3000x{i % 7}. " * (i % 11) for i in range(2 * vectors.ROWS + 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", vectors.embed_tfidf(F.col("t")).alias("v"))
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
    for row in df.collect():
        if texts[row["i"]] is None:
            assert row["v"] == [0.0] * 246 + [None] * 10
        else:
            assert np.allclose(row["v"], plain_tfidf(texts[row["i"]]), atol=1e-12)


def test_charstats_take_little_beside_their_batch():
    """Texts stay the batch's bytes: what is made beside them is far smaller, for many texts and for a long one."""
    for texts in (["Some text, e.g. this. " * 250] * 4000 + ["", None], ["ab c" * 4_000_000]):
        batch = pa.array(texts)
        tracemalloc.start()
        made = vectors._charstats.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8_000_000
        assert np.allclose(made[0].as_py(), plain_charstats(texts[0])[:56], atol=1e-12)


def test_vocabulary_keeps_last_index():
    last = {w: i for i, w in enumerate(vectors.VOCABULARY)}
    assert len(vectors.VOCABULARY) == 61 and len(last) == 58
    assert (last["order"], last["customer"], last["metric"]) == (22, 39, 56)


def test_cosine_guards(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 0.0])],
        "a array<double>, b array<double>",
    ).coalesce(1)
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, math.sqrt(0.5)])


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").coalesce(1)
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def brute(rows, queries, k, group=None):
    out = set()
    groups = {None} if group is None else {r[2] for r in rows}
    for qid, q in queries:
        for g in groups:
            scored = []
            for rid, v, label in rows:
                if g is not None and label != g:
                    continue
                scale = np.linalg.norm(v) * np.linalg.norm(q) if len(v) == len(q) else 0
                scored.append((-round(float(np.dot(v, q) / scale), 9) if scale else 0.0, rid))
            for rank, (score, rid) in enumerate(sorted(scored)[:k], start=1):
                out.add((qid, rid, g, rank, round(-score, 6)))
    return out


@pytest.fixture(scope="module")
def store():
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "abc"[i % 3]) for i in range(300)]
    rows += [(300 + i, rows[i][1], "a") for i in range(40)]  # copies, so scores tie
    rows += [(340, [0.0] * 6, "b"), (341, [1.0, 2.0], "c")]
    queries = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(9)] + [(9, rows[5][1])]
    return rows, queries


@pytest.mark.parametrize("group", [None, "label"])
@pytest.mark.parametrize("block_bytes", [10**6, 8 * 6 * 3])
def test_batched_search_equals_brute_force(spark, store, group, block_bytes):
    rows, queries = store
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>").coalesce(1)
    found = search.nearest_batch(chunks, asked, 7, group_col=group, block_bytes=block_bytes)
    got = {(r["query_id"], r["id"], r["group"] if group else None, r["rank"], round(r["score"], 6)) for r in found.collect()}
    assert got == brute(rows, queries, 7, group)


def test_text_ids_and_single_query(spark, store):
    rows, queries = store
    named = [(f"c{i:04d}", v, label) for i, v, label in rows]
    chunks = spark.createDataFrame(named, "chunk_id string, vector array<double>, phase string").repartition(3)
    asked = spark.createDataFrame(queries[:2], "query_id long, query_vector array<double>").coalesce(1)
    batch = search.nearest_batch(chunks, asked, 5).filter("query_id = 0").orderBy("rank").collect()
    single = search.nearest(chunks, queries[0][1], 5).collect()
    assert [r["id"] for r in batch] == [r["chunk_id"] for r in single]
    assert [r["score"] for r in batch] == pytest.approx([r["score"] for r in single])


def test_search_text_in_phases(spark):
    texts = [("1", "phase1", "table customer column"), ("2", "phase2", "order revenue"), ("3", "phase3", "customer table")]
    chunks = spark.createDataFrame(texts, "chunk_id string, phase string, content string").withColumn(
        "vector", vectors.embed_tfidf(F.col("content"), stats=False)
    )
    embedder = lambda c: vectors.embed_tfidf(c, stats=False)
    assert [r["chunk_id"] for r in search.search_text(chunks, "order revenue", embedder, 1).collect()] == ["2"]
    only = search.search_text(chunks, "order revenue", embedder, 5, ["phase1", "phase3"]).collect()
    assert {r["chunk_id"] for r in only} == {"1", "3"}
    queries = spark.range(0, 1, 1, 1).select(F.lit(1).alias("query_id"), embedder(F.lit("table")).alias("query_vector"))
    text = search.relevant_knowledge(chunks, queries).first()["knowledge"].split("\n\n")
    assert text[0] == "Phase 1 - Schema Analysis: table customer column" and len(text) == 3


def test_repeated_query_ids_are_refused(spark, store):
    rows, _ = store
    chunks = spark.createDataFrame(rows[:5], "chunk_id long, vector array<double>, label string")
    asked = spark.createDataFrame([(1, rows[0][1])] * 9, "query_id long, query_vector array<double>").coalesce(1)
    search.MOST_SPLITS, before = 2, search.MOST_SPLITS
    try:
        with pytest.raises(ValueError):
            search.nearest_batch(chunks, asked, 2, block_bytes=48)
    finally:
        search.MOST_SPLITS = before
