"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, jaccard_join, kd_search, language_id, licenses, lm_scoring, negatives, pieces, quality, resampling,
    substrings, transcripts, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODEL_FILE = "piece_bpe_32k.model"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql.strip()
        return function

    return add


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_benchmark_decontamination(spark, root):
    """Every benchmark item found in every document within a tenth of its length in edits."""
    return decontaminate.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query()
def op4_lm_scoring(spark, root):
    return lm_scoring.lm_score(table(spark, root, "documents"))


@query()
def op5_quality(spark, root):
    return quality.quality(table(spark, root, "documents"), table(spark, root, "labels"))


@query()
def op6_language_id(spark, root):
    return language_id.language_id(table(spark, root, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM grams),
tokens AS (SELECT doc_id, unnest(s) AS g FROM grams),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
)
SELECT sizes.doc_id, n AS n_shingles, min(reach.b) AS component_id
FROM sizes JOIN reach ON reach.a = sizes.doc_id GROUP BY sizes.doc_id, n
"""


@query(JACCARD_SQL)
def op9_ngram_jaccard_join(spark, root):
    return jaccard_join.jaccard_components(table(spark, root, "documents"), words=4, percent=85)


@query()
def op10_sentencepiece(spark, root):
    """Encode and decode every document: token count, digest of the ids, and whether the text came back."""
    path = model_path()
    documents = table(spark, root, "documents")
    coded = pieces.encode(documents.select("doc_id", "text"), path, keep_text=True)
    return pieces.decode(coded, path).select(
        "doc_id", "n_bytes", "n_tokens",
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_digest"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


WARC_SQL = """
WITH pages AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), heads AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM pages WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM pages LEFT JOIN heads ON d = payload_digest
"""


@query(WARC_SQL)
def op7_warc(spark, root):
    return warc.round_trip(table(spark, root, "pages")).drop("url")


TOP_K_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(TOP_K_SQL)
def op3_exact_topk(spark, root):
    vectors = table(spark, root, "embeddings")
    return kd_search.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query(licenses.scan_sql())
def op1_license_scan(spark, root):
    return licenses.scan(table(spark, root, "documents"), licenses.known_digests(spark))


@query()
def op8_chat_format(spark, root):
    return transcripts.chat_format(table(spark, root, "conversations"))


REPEATS_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM places
), least AS (
  SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN least USING (h), range(50) steps(k) WHERE low < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.i) AS n_removed,
    string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query(REPEATS_SQL)
def op11_substring_dedup(spark, root):
    """Words left of every document after passages of 50 words that a smaller document has, as a digest."""
    kept = substrings.remove_repeats(table(spark, root, "documents"), words=50)
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
  FROM pairs WHERE same
), negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND place <= 5
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


@query(NEGATIVES_SQL)
def op12_hard_negatives(spark, root):
    """Hard negatives of every hundredth vector; a seventh of the labels are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, root, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80, scale=256)


RESAMPLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, 0 AS target, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL SELECT item_id, 1, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), words AS (SELECT doc_id, target, unnest(w) AS word FROM texts),
step AS (
  SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), nibbles AS (
  SELECT word, list_transform(range(length(hex(word))),
    lambda i: instr('0123456789ABCDEF', hex(word)[(i // 2) * 2 + 2 - i % 2])::BIGINT - 1) AS x
  FROM (SELECT DISTINCT word FROM words)
), buckets AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], x),
    lambda c, y: xor(t[(xor(c, y) & 15) + 1], c >> 4)), 4294967295) % 10000 AS bucket
  FROM nibbles, step
), counts AS (
  SELECT bucket, sum(1 - target) AS s, sum(target) AS t FROM words JOIN buckets USING (word) GROUP BY bucket
), sums AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + 10000) / ((c.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain
  FROM counts c, sums a
), weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


@query(RESAMPLE_SQL)
def op13_target_resampling(spark, root):
    """A tenth of the documents, drawn for their likeness to the benchmark's words."""
    return resampling.resample(table(spark, root, "documents"), table(spark, root, "benchmark"), percent=10, seed=2024)
