"""Registered queries over texts, JSON and vectors, and the knowledge store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions.classify import business_area, dimension_class
from ..functions.jsontext import findings_text, json_lines, json_outline
from ..functions.vectors import VOCABULARY, cosine, embed_charstats, embed_hash, embed_tfidf, l2_normalize
from ..operators import business, chunks, search
from ..sources import knowledge
from ..sources.staging import small_side, spread
from .lake import open_lake
from .registry import query

SIZE, OVERLAP = 20, 5
TRIM = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
CHUNK_CTES = f"""
l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT doc_id, lang, lines, greatest(1, ceil((len(lines) - {OVERLAP}) / {SIZE - OVERLAP}.0))::BIGINT AS cnt FROM l),
c AS (SELECT doc_id, lang, lines, unnest(range(cnt)) AS chunk_no FROM n),
pieces AS (SELECT doc_id, lang, chunk_no::INT AS chunk_no, regexp_replace(array_to_string(
    lines[chunk_no * {SIZE - OVERLAP} + 1 : chunk_no * {SIZE - OVERLAP} + {SIZE}], chr(10)), '{TRIM}', '', 'g') AS content FROM c),
chunked AS (SELECT * FROM pieces WHERE content <> '')
"""
CENTROID_CTES = """
x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY label, pos),
q AS (SELECT label AS query_id, list(v ORDER BY pos) AS qv FROM m GROUP BY label)
"""


def _documents(spark, root):
    return spread(open_lake(spark, root, "documents")["documents"])


def _chunks(docs, size=SIZE, overlap=OVERLAP):
    return chunks.chunk_documents(docs, "text", F.col("doc_id"), F.col("lang"), size, overlap)


@query(f"WITH {CHUNK_CTES} SELECT doc_id::VARCHAR AS source, lang AS phase, chunk_no, content FROM chunked")
def chunk_lines(spark, root):
    return _chunks(_documents(spark, root)).select("source", "phase", "chunk_no", "content")


@query(
    "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total "
    "FROM embeddings WHERE label <> 3"
)
def vector_scan(spark, root):
    vectors = open_lake(spark, root, "embeddings")["embeddings"]
    text = F.when(F.col("label") == 3, F.lit("not a vector")).otherwise(F.to_json("embedding"))
    stored = knowledge.decode_vectors(vectors.select("vec_id", text.alias("vector")), "vector")
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return stored.select(
        "vec_id", F.size("vector").cast("bigint").alias("dims"), F.round(total, 4).alias("total")
    )


@query(f"WITH {CHUNK_CTES} SELECT lang AS phase, count(*) AS chunk_count FROM chunked WHERE lang <> 'fr' GROUP BY lang")
def knowledge_delete(spark, root):
    rows = _chunks(_documents(spark, root)).withColumn("metadata", F.create_map(F.lit("phase"), "phase"))
    return knowledge.knowledge_stats(knowledge.without_metadata(rows, "phase", "fr"))


@query(
    f"""
WITH {CHUNK_CTES},
h AS (SELECT sha256(content) AS content_hash, doc_id, lang, chunk_no, content FROM chunked),
stored AS (SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY lang, doc_id::VARCHAR, chunk_no) AS rn
          FROM h WHERE content_hash NOT IN (SELECT content_hash FROM stored))
SELECT content_hash, lang AS phase, doc_id::VARCHAR AS source, chunk_no, content FROM fresh WHERE rn = 1
"""
)
def index_update(spark, root):
    docs = _documents(spark, root)
    labelled = docs.join(open_lake(spark, root, "labels")["labels"].select("doc_id"), "doc_id", "left_semi")
    stored = knowledge.hashed(_chunks(labelled))
    fresh = knowledge.new_chunks(knowledge.hashed(_chunks(docs)), stored)
    return fresh.select("content_hash", "phase", "source", "chunk_no", "content")


@query(
    f"WITH {CHUNK_CTES} SELECT lang AS phase, count(*) AS chunk_count, sum(length(content))::BIGINT AS characters "
    "FROM chunked GROUP BY lang UNION ALL SELECT 'total', count(*), sum(length(content))::BIGINT FROM chunked"
)
def knowledge_export(spark, root):
    rows = _chunks(_documents(spark, root))
    counts = rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content").cast("bigint")).alias("characters")
    )
    total = counts.agg(F.sum("chunk_count").alias("chunk_count"), F.sum("characters").alias("characters"))
    return counts.unionByName(total.withColumn("phase", F.lit("total")))


@query(
    "SELECT 'phase' AS grouping, lang AS name, count(*) AS chunk_count FROM documents GROUP BY lang "
    "UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"
)
def knowledge_stats(spark, root):
    docs = _documents(spark, root).select(F.col("lang").alias("phase"), "source")
    by_phase = knowledge.knowledge_stats(docs).select(F.lit("phase").alias("grouping"), F.col("phase").alias("name"), "chunk_count")
    by_source = knowledge.source_stats(docs).select(
        F.lit("source").alias("grouping"), F.col("source").alias("name"), "chunk_count"
    )
    return by_phase.unionByName(by_source)


@query(
    f"WITH {CHUNK_CTES} SELECT 'phase' AS grouping, lang AS name, count(*) AS chunk_count FROM chunked GROUP BY lang "
    "UNION ALL SELECT 'source', doc_id::VARCHAR, count(*) FROM chunked GROUP BY doc_id "
    "UNION ALL SELECT 'total', NULL, count(*) FROM chunked"
)
def knowledge_chunk_counts(spark, root):
    """Chunks per phase, per source and in all."""
    return knowledge.chunk_counts(_chunks(_documents(spark, root)))


@query(
    """
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text
  WHEN strpos(substr(text, 1, 200), '.') > 0 AND 200 - strpos(reverse(substr(text, 1, 200)), '.') > 50
    THEN substr(text, 1, 201 - strpos(reverse(substr(text, 1, 200)), '.'))
  ELSE substr(text, 1, 200) || '...' END AS summary FROM documents
"""
)
def text_summary(spark, root):
    return _documents(spark, root).select("doc_id", text_functions.text_summary(F.col("text")).alias("summary"))


@query(
    """
WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' ' || user_id || ' rows' WHEN 'view' THEN '-' || user_id
  WHEN 'signup' THEN user_id || 'x' || user_id WHEN 'error' THEN 'none ' || user_id ELSE user_id::VARCHAR END AS s FROM events)
SELECT event_id, coalesce(try_cast(nullif(regexp_extract(trim(s), '^([0-9]+|[+-][0-9]+$)', 1), '') AS BIGINT), 0) AS number FROM t
"""
)
def leading_number(spark, root):
    kind, user = F.col("event_type"), F.col("user_id")
    raw = (
        F.when(kind == "click", F.concat(F.lit(" "), user, F.lit(" rows")))
        .when(kind == "view", F.concat(F.lit("-"), user))
        .when(kind == "signup", F.concat(user, F.lit("x"), user))
        .when(kind == "error", F.concat(F.lit("none "), user))
        .otherwise(user.cast("string"))
    )
    events = open_lake(spark, root, "events")["events"]
    return events.select("event_id", text_functions.leading_number(raw).alias("number"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || chr(10) AS lines FROM events")
def json_to_lines(spark, root):
    return open_lake(spark, root, "events")["events"].select("event_id", json_lines(F.col("props")).alias("lines"))


# Six levels, arrays of objects, texts that start like JSON, and bodies that are none.
BODY = """
CASE WHEN doc_id % 7 = 0 THEN concat('[broken ', source) ELSE concat('{"a": {"b": {"c": {"d": {"e": {"f": ', doc_id,
  '}}}}}, "list": [{"lang": "', lang, '"}, {"lang": "[', source, '"}], "note": "{', lang, '", "none": null}') END
"""


@query(
    """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '[broken ' || source ELSE 'a: b: c: d: e: f: ' || doc_id || repeat(chr(10), 6)
  || 'list: [0]: lang: ' || lang || repeat(chr(10), 2) || '[1]: lang: [' || source || repeat(chr(10), 3)
  || 'note: {' || lang || chr(10) || 'none: <nil>' || chr(10) END AS lines FROM documents
"""
)
def json_lines_deep(spark, root):
    return _documents(spark, root).select("doc_id", json_lines(F.expr(BODY)).alias("lines"))


@query(
    """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '[broken ' || source || chr(10) ELSE array_to_string(['a:', '  b:', '    c:',
  '      d:', '        e:', '          f:', '            ' || doc_id, 'list:', '  [0]:', '    lang:', '      ' || lang,
  '  [1]:', '    lang:', '      [' || source, 'note:', '  {' || lang, 'none:', '  <nil>', ''], chr(10)) END AS outline
FROM documents
"""
)
def json_outline_deep(spark, root):
    return _documents(spark, root).select("doc_id", json_outline(F.expr(BODY)).alias("outline"))


@query(
    "SELECT json_extract_string(props, '$.k')::INT AS k, event_type, count(*) AS n, "
    "sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL"
)
def json_props(spark, root):
    events = open_lake(spark, root, "events")["events"]
    k = F.get_json_object("props", "$.k").cast("int")
    return events.groupBy(k.alias("k"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


RESPONSE_SCHEMA = (
    "business_logic_summary string, table_categories map<string,array<string>>, "
    "key_business_processes array<string>, data_flow_patterns array<string>, recommendations array<string>"
)


@query(
    """
WITH r AS (SELECT doc_id, text || chr(10) || '{"business_logic_summary": "' || source || '", "key_business_processes": ["'
  || lang || '", "' || n_chars || '"], "table_categories": {"a": ["' || lang || '"]}} done' AS body FROM documents),
j AS (SELECT doc_id, regexp_extract(body, '(?s)\\{.*\\}', 0) AS o FROM r)
SELECT doc_id, json_extract_string(o, '$.business_logic_summary') AS summary,
  json_array_length(o, '$.key_business_processes')::INT AS processes,
  json_extract_string(o, '$.table_categories.a[0]') AS first_table FROM j
"""
)
def json_from_text(spark, root):
    body = F.concat(
        "text", F.lit('\n{"business_logic_summary": "'), "source", F.lit('", "key_business_processes": ["'), "lang",
        F.lit('", "'), "n_chars", F.lit('"], "table_categories": {"a": ["'), "lang", F.lit('"]}} done'),
    )
    found = text_functions.json_from_text(body, RESPONSE_SCHEMA)
    return _documents(spark, root).select("doc_id", found.alias("r")).select(
        "doc_id",
        F.col("r.business_logic_summary").alias("summary"),
        F.size("r.key_business_processes").alias("processes"),
        F.element_at("r.table_categories", "a")[0].alias("first_table"),
    )


@query(
    """
WITH r AS (SELECT doc_id, CASE lang
  WHEN 'en' THEN '```sql' || chr(10) || 'SELECT text FROM ' || source || chr(10) || '  WHERE doc_id = ' || doc_id || ';' || chr(10) || '-- ' || n_chars || chr(10) || '```'
  WHEN 'de' THEN 'Here it is:' || chr(10) || 'select n_chars from ' || source || chr(10) || 'limit 5'
  WHEN 'fr' THEN '  SELECT ' || doc_id || '; '
  ELSE 'no query for ' || source END AS body FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(body), '^```sql', ''), '^```', ''), '```$', '') AS s FROM r),
l AS (SELECT doc_id, s, list_transform(string_split(s, chr(10)), lambda t: trim(t)) AS lines FROM b),
p AS (SELECT *, coalesce(list_position(list_transform(lines, lambda t: upper(t) LIKE 'SELECT%'), true), 0) AS start FROM l),
t AS (SELECT *, lines[start + 1 :] AS rest FROM p),
u AS (SELECT *, coalesce(list_position(list_transform(rest, lambda t: contains(t, ';')), true), 0) AS stop FROM t)
SELECT doc_id, regexp_replace(trim(CASE WHEN start = 0 THEN s ELSE array_to_string(list_concat([lines[start]],
  CASE WHEN stop = 0 THEN rest ELSE rest[1 : stop] END), ' ') END), ';$', '') AS query_text FROM u
"""
)
def sql_from_text(spark, root):
    lang = F.col("lang")
    body = (
        F.when(
            lang == "en",
            F.concat(
                F.lit("```sql\nSELECT text FROM "), "source", F.lit("\n  WHERE doc_id = "), "doc_id",
                F.lit(";\n-- "), "n_chars", F.lit("\n```"),
            ),
        )
        .when(lang == "de", F.concat(F.lit("Here it is:\nselect n_chars from "), "source", F.lit("\nlimit 5")))
        .when(lang == "fr", F.concat(F.lit("  SELECT "), "doc_id", F.lit("; ")))
        .otherwise(F.concat(F.lit("no query for "), "source"))
    )
    return _documents(spark, root).select("doc_id", text_functions.sql_from_text(body).alias("query_text"))


@query(
    """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '{"tables": {"' || source || '_en": {"n": 1}, "not a name": {}}}'
  ELSE 'Foreign table key' || chr(10) || '表格 ' || source || '.' || chr(10) || text END AS body, lang FROM documents),
k AS (SELECT unnest(json_keys(body, '$.tables')) AS name FROM d WHERE lang = 'en'),
l AS (SELECT unnest(string_split(body, chr(10))) AS line FROM d WHERE lang <> 'en'),
w AS (SELECT list_filter(list_transform(regexp_split_to_array(trim(line), '\\s+'), lambda t: trim(t, '.,;:"''')),
  lambda t: regexp_matches(t, '^[A-Za-z0-9_]{1,50}$'))[1] AS name FROM l
  WHERE (contains(lower(line), 'table') OR contains(line, '表格')) AND NOT regexp_matches(lower(line), 'constraint|foreign|primary|unique'))
SELECT DISTINCT name FROM (SELECT name FROM k WHERE regexp_matches(name, '^[A-Za-z0-9_]{1,50}$') UNION ALL SELECT name FROM w)
WHERE name IS NOT NULL
"""
)
def names_from_text(spark, root):
    body = F.when(
        F.col("lang") == "en",
        F.concat(F.lit('{"tables": {"'), "source", F.lit('_en": {"n": 1}, "not a name": {}}}')),
    ).otherwise(F.concat(F.lit("Foreign table key\n表格 "), "source", F.lit(".\n"), "text"))
    names = text_functions.names_in_text(body)
    return _documents(spark, root).select(F.explode(names).alias("name")).distinct()


def _vector_digest(vector, *keep):
    """A few numbers that fix a vector: a position-weighted sum, its largest value, non-zeros."""
    weighted = F.aggregate(
        F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda total, x: total + x
    )
    return [
        *keep,
        F.size(vector).cast("bigint").alias("dims"),
        F.round(weighted, 5).alias("weighted_sum"),
        F.round(F.array_max(vector), 6).alias("largest"),
        F.size(F.filter(vector, lambda x: x != 0)).cast("bigint").alias("non_zero"),
    ]


DIGEST_SQL = """
SELECT doc_id, len(v)::BIGINT AS dims, round(list_sum(list_transform(v, lambda x, i: x * i)), 5) AS weighted_sum,
  round(list_max(v), 6) AS largest, len(list_filter(v, lambda x: x <> 0))::BIGINT AS non_zero FROM unit
"""
UNIT_CTE = """
unit AS (SELECT doc_id, CASE WHEN n > 0 THEN list_transform(raw, lambda x: x / n) ELSE raw END AS v FROM
  (SELECT doc_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS n FROM built))
"""


@query(
    f"""
WITH h AS (SELECT doc_id, sha256(text) AS d FROM documents),
built AS (SELECT doc_id, list_concat(list_transform(range(8), lambda i: ('0x' || substr(d, (i * 8 + 1)::BIGINT, 8))::BIGINT::DOUBLE
  / 18446744073709551616.0::DOUBLE), list_transform(range(248), lambda i: 0.0::DOUBLE)) AS raw FROM h),
{UNIT_CTE}
{DIGEST_SQL}
""",
    name="embed_hash",
)
def embed_hash_vectors(spark, root):
    vectors = _documents(spark, root).select("doc_id", embed_hash(F.col("text")).alias("v"))
    return vectors.select(*_vector_digest(F.col("v"), "doc_id"))


@query(
    f"""
WITH s AS (SELECT doc_id, text, strlen(text) AS n FROM documents),
built AS (SELECT doc_id, list_concat([n / 1000.0::DOUBLE], list_transform(
  list_concat([' ', '.', ','], string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '')),
  lambda ch: CASE WHEN n > 0 THEN (length(text) - length(replace(text, ch, '')))::DOUBLE / n ELSE 0.0::DOUBLE END),
  list_transform(range(328), lambda i: 0.0::DOUBLE)) AS raw FROM s),
{UNIT_CTE}
{DIGEST_SQL}
""",
    name="embed_charstats",
)
def embed_charstats_vectors(spark, root):
    vectors = _documents(spark, root).select("doc_id", embed_charstats(F.col("text")).alias("v"))
    return vectors.select(*_vector_digest(F.col("v"), "doc_id"))


_SLOTS = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
_LAST = {word: i for i, word in enumerate(VOCABULARY)}
_LIVE = "[" + ", ".join("true" if _LAST[w] == i else "false" for i, w in enumerate(VOCABULARY)) + "]"

def _tfidf_digest(source: str) -> str:
    """The digest of TF-IDF vectors of ``(doc_id, body)`` rows, in SQL."""
    return f"""
c AS (SELECT doc_id, translate(lower(body), '.,:;!?', '      ') AS t FROM {source}),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\s\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM c),
k AS (SELECT *, list_filter(ws, lambda x: list_contains({_SLOTS}, x)) AS known, len(ws) AS n FROM w),
f AS (SELECT *, list_transform({_SLOTS}, lambda term, i: CASE WHEN {_LIVE}[i] AND len(known) > 0
    THEN len(list_filter(known, lambda x: x = term))::DOUBLE / len(known)
      * CASE WHEN contains(term, 'customer') OR contains(term, 'product') THEN 1.0 ELSE 2.0 END
    ELSE 0.0::DOUBLE END) AS tf FROM k),
r AS (SELECT *, list_transform(range(246), lambda i: (CASE WHEN i < {len(VOCABULARY)} THEN tf[i + 1] ELSE 0.0 END)
    + CASE WHEN i < n THEN 0.1::DOUBLE * i / n ELSE 0.0 END) AS ramp FROM f),
built AS (SELECT doc_id, list_concat(ramp, [strlen(t) / 1000.0::DOUBLE, n / 100.0::DOUBLE, strlen(t)::DOUBLE / (n + 1),
    len(list_distinct(ws))::DOUBLE / (n + 1)], list_transform(['分析', '查詢', '銷售', '客戶', '產品', '數據'],
    lambda x: (length(t) - length(replace(t, x, '')))::DOUBLE / length(x) / 10.0::DOUBLE)) AS raw FROM r),
{UNIT_CTE}
{DIGEST_SQL}
"""


@query(
    "WITH d AS (SELECT doc_id, text || ' Sales by customer and order' AS body FROM documents), " + _tfidf_digest("d"),
    name="embed_tfidf",
)
def embed_tfidf_vectors(spark, root):
    text = F.concat("text", F.lit(" Sales by customer and order"))
    vectors = _documents(spark, root).select("doc_id", embed_tfidf(text).alias("v"))
    return vectors.select(*_vector_digest(F.col("v"), "doc_id"))


@query(
    f"WITH d AS (SELECT doc_id, regexp_replace(text, '{TRIM}', '', 'g') AS body FROM documents "
    f"WHERE regexp_replace(text, '{TRIM}', '', 'g') <> ''), q AS (WITH {_tfidf_digest('d')}) "
    "SELECT d.doc_id::VARCHAR AS source, sha256(body) AS content_hash, 256::BIGINT AS dims, weighted_sum FROM d JOIN q USING (doc_id)"
)
def index_build(spark, root):
    rows = knowledge.build_store_rows(_chunks(_documents(spark, root), 1000, 200))
    return rows.select("source", "content_hash", *_vector_digest(F.col("vector"))[:2])


@query(
    f"WITH {CHUNK_CTES}, d AS (SELECT doc_id::VARCHAR || '#' || chunk_no AS doc_id, doc_id::VARCHAR AS source, chunk_no, "
    f"content AS body FROM chunked), q AS (WITH {_tfidf_digest('d')}) "
    "SELECT source, chunk_no, sha256(body) AS content_hash, 256::BIGINT AS dims, weighted_sum FROM d JOIN q USING (doc_id)"
)
def index_build_windows(spark, root):
    """Store rows of documents that are split into many overlapping windows."""
    rows = knowledge.build_store_rows(_chunks(_documents(spark, root)))
    return rows.select("source", "chunk_no", "content_hash", *_vector_digest(F.col("vector"))[:2])


@query(
    f"""
WITH d AS (SELECT event_id AS doc_id, 'Phase: phase2' || chr(10)
  || 'Description: AI-powered business logic analysis with LLM insights and recommendations' || chr(10)
  || 'Timestamp: ' || ts::VARCHAR || chr(10) || chr(10) || 'k:' || chr(10) || '  ' || json_extract_string(props, '$.k') AS body
  FROM events), q AS (WITH {_tfidf_digest('d')})
SELECT 'phase_phase2_' || d.doc_id AS source, 'phase2' AS phase, body AS content, weighted_sum FROM d JOIN q USING (doc_id)
"""
)
def knowledge_store(spark, root):
    events = spread(open_lake(spark, root, "events")["events"])
    found = events.select(
        F.concat(F.lit("phase_phase2_"), "event_id").alias("source"),
        findings_text("phase2", F.col("props"), F.col("ts")).alias("text"),
    )
    rows = chunks.chunk_documents(found, "text", F.col("source"), F.lit("phase2"))
    stored = knowledge.build_store_rows(rows, timestamp=F.lit("2024-01-01 00:00:00"))
    return stored.select("source", "phase", "content", _vector_digest(F.col("vector"))[1])


def _vectors(spark, root):
    return open_lake(spark, root, "embeddings")["embeddings"]


@query(
    f"WITH {CENTROID_CTES} SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score "
    "FROM embeddings JOIN q ON query_id = label"
)
def cosine_pairs(spark, root):
    vectors = _vectors(spark, root)
    centers = search.group_centroids(vectors, "label", "embedding").withColumnRenamed("group", "label")
    score = F.round(cosine(F.col("embedding"), F.col("centroid")), 6)
    centers = small_side(centers, F.size("centroid") * 8 + 64)
    return vectors.join(centers, "label").select("vec_id", "label", score.alias("score"))


@query(
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: x / n * i)), 6) AS weighted_sum FROM (SELECT vec_id, "
    "embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    name="l2_normalize",
)
def l2_normalize_vectors(spark, root):
    unit = _vectors(spark, root).select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda total, x: total + x)
    return unit.select("vec_id", F.round(weighted, 6).alias("weighted_sum"))


def _centers(spark, root):
    centers = search.group_centroids(_vectors(spark, root), "label", "embedding")
    return centers.select(F.col("group").alias("query_id"), F.col("centroid").alias("query_vector"))


def _top(where: str = "true", partition: str = "query_id", k: int = 5, group: str = "") -> str:
    return f"""
WITH {CENTROID_CTES},
s AS (SELECT query_id, vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS score
      FROM embeddings, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT query_id, id, {group} rank, round(score, 6) AS score FROM r WHERE rank <= {k}
"""


def _rounded(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(_top())
def vector_topk(spark, root):
    vectors = _vectors(spark, root)
    return _rounded(search.nearest_batch(vectors, _centers(spark, root), 5, "vec_id", "embedding"))


@query(_top("label = 1", k=10))
def vector_topk_filtered(spark, root):
    vectors = _vectors(spark, root).filter("label = 1")
    return _rounded(search.nearest_batch(vectors, _centers(spark, root), 10, "vec_id", "embedding"))


@query(_top("label IN (1, 2, 3)"))
def vector_topk_multi(spark, root):
    vectors = _vectors(spark, root).filter(F.col("label").isin(1, 2, 3))
    return _rounded(search.nearest_batch(vectors, _centers(spark, root), 5, "vec_id", "embedding"))


@query(_top("true", "query_id, label", 1, 'label AS "group",'))
def topk_per_phase(spark, root):
    found = search.nearest_batch(
        _vectors(spark, root), _centers(spark, root), 1, "vec_id", "embedding", group_col="label"
    )
    return _rounded(found)


PHASE_SQL = "'phase' || (1 + id % 3)"


@query(
    "SELECT query_id, string_agg(title || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END, "
    "chr(10) || chr(10) ORDER BY \"group\") AS knowledge FROM ("
    + _top("vec_id IN (SELECT doc_id FROM documents)", f"query_id, {PHASE_SQL}", 1, f'{PHASE_SQL} AS "group",')
    + ") JOIN documents ON id = doc_id JOIN (VALUES "
    + ", ".join(f"('{phase}', '{title}')" for phase, title in search.PHASE_TITLES.items())
    + ") AS titles(phase, title) ON phase = \"group\" GROUP BY query_id"
)
def relevant_knowledge(spark, root):
    """The text for each class centre from a store whose chunks are documents in three phases."""
    phase = F.concat(F.lit("phase"), 1 + F.col("vec_id") % 3)
    vectors = _vectors(spark, root).select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), phase.alias("phase")
    )
    contents = _documents(spark, root).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return search.relevant_knowledge(vectors.join(contents, "chunk_id"), _centers(spark, root))


EVENT_NAMES = {
    "purchase": "order_items", "signup": "customers", "view": "product_pages", "click": "cart_clicks", "error": "error_log",
}
AREA_CTE = """
named AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'order_items' WHEN 'signup' THEN 'customers'
    WHEN 'view' THEN 'product_pages' WHEN 'click' THEN 'cart_clicks' ELSE 'error_log' END AS name,
  CASE WHEN value > 40 THEN '庫存 ' WHEN value > 30 THEN '評論 ' WHEN value > 20 THEN '運送 ' WHEN value > 10 THEN '促銷 ' ELSE '' END || props AS body
  FROM events),
areas AS (SELECT event_id, user_id, CASE
  WHEN contains(name, 'customer') OR contains(body, '顧客') OR contains(body, '客戶') THEN 'customer_management'
  WHEN contains(name, 'product') OR contains(name, 'categories') OR contains(body, '商品') THEN 'product_management'
  WHEN contains(name, 'order') OR contains(name, 'cart') OR contains(body, '訂單') THEN 'order_management'
  WHEN contains(name, 'inventory') OR contains(body, '庫存') THEN 'inventory_management'
  WHEN contains(name, 'coupon') OR contains(name, 'promo') OR contains(body, '優惠') OR contains(body, '促銷') THEN 'marketing_promotion'
  WHEN contains(name, 'review') OR contains(body, '評論') THEN 'content_reviews'
  WHEN contains(name, 'shipment') OR contains(name, 'shipping') OR contains(body, '運送') THEN 'shipping_logistics'
  ELSE 'other' END AS area FROM named)
"""


def _areas(spark, root):
    name = None
    for kind, label in EVENT_NAMES.items():
        hit = F.col("event_type") == kind
        name = F.when(hit, label) if name is None else name.when(hit, label)
    value = F.col("value")
    lead = (
        F.when(value > 40, "庫存 ").when(value > 30, "評論 ").when(value > 20, "運送 ").when(value > 10, "促銷 ").otherwise("")
    )
    events = open_lake(spark, root, "events")["events"]
    return events.select("event_id", "user_id", business_area(name, F.concat(lead, "props")).alias("area"))


@query(f"WITH {AREA_CTE} SELECT event_id, area FROM areas")
def classify_business(spark, root):
    return _areas(spark, root).select("event_id", "area")


@query(
    f"""
WITH {AREA_CTE}, f AS (SELECT user_id, bool_or(area = 'order_management') AS o, bool_or(area = 'product_management') AS p,
  bool_or(area = 'customer_management') AS c, bool_or(area = 'shipping_logistics') AS s,
  bool_or(area = 'inventory_management') AS i FROM areas GROUP BY user_id)
SELECT user_id, CASE WHEN o AND p AND c AND s THEN '電商平台 (E-commerce Platform)'
  WHEN o AND p AND c THEN '零售/銷售系統 (Retail/Sales System)'
  WHEN i AND p THEN '庫存管理系統 (Inventory Management System)' ELSE '通用商業系統 (General Business System)' END AS domain FROM f
"""
)
def infer_domain(spark, root):
    return business.infer_domain(_areas(spark, root), "user_id")


@query(
    f"""
WITH {AREA_CTE}, labels_of(area, kind, label) AS (VALUES
  ('customer_management', 'process', '顧客管理 (Customer Management)'), ('customer_management', 'entity', '顧客 (Customer)'),
  ('product_management', 'process', '商品目錄管理 (Product Catalog Management)'), ('product_management', 'entity', '商品 (Product)'),
  ('product_management', 'entity', '商品分類 (Category)'), ('order_management', 'process', '訂單處理 (Order Processing)'),
  ('order_management', 'process', '購物車管理 (Shopping Cart Management)'), ('order_management', 'entity', '訂單 (Order)'),
  ('order_management', 'entity', '訂單項目 (Order Item)'), ('inventory_management', 'process', '庫存管理 (Inventory Management)'),
  ('inventory_management', 'entity', '庫存交易 (Inventory Transaction)'),
  ('marketing_promotion', 'process', '行銷活動管理 (Marketing Campaign Management)'), ('marketing_promotion', 'entity', '優惠券 (Coupon)'),
  ('content_reviews', 'process', '用戶評論管理 (User Review Management)'), ('content_reviews', 'entity', '評論 (Review)'),
  ('shipping_logistics', 'process', '物流運送管理 (Shipping & Logistics Management)'), ('shipping_logistics', 'entity', '運送 (Shipment)'))
SELECT DISTINCT user_id, kind, label FROM areas JOIN labels_of USING (area)
"""
)
def business_labels(spark, root):
    return business.business_labels(_areas(spark, root), "user_id")


TEXT_PAIRS = (
    ("date", "area", "dates and areas"), ("the", "of", "English words"), ("der", "und", "German words"),
    ("que", "los", "Spanish words"), ("les", "des", "French words"),
)


@query(
    "WITH t AS (SELECT source, lower(text) AS b FROM documents), p(a, c, relation) AS (VALUES "
    + ", ".join(f"('{a}', '{c}', '{label}')" for a, c, label in TEXT_PAIRS)
    + ") SELECT DISTINCT source, relation FROM t JOIN p ON contains(b, a) AND contains(b, c)"
)
def keyword_pairs(spark, root):
    return business.keyword_pairs(_documents(spark, root), "text", "source", TEXT_PAIRS)


@query(
    """
WITH t AS (SELECT doc_id, lower(source) AS n, lower(text) AS b, CASE WHEN n_chars > 20000 THEN 'time' ELSE lang END AS kind FROM documents)
SELECT doc_id, CASE WHEN kind = 'time' THEN 'time'
  WHEN regexp_matches(n || chr(10) || b, 'customer|user|person|people|client|supplier|vendor|employee|staff|member') THEN 'people'
  WHEN regexp_matches(n || chr(10) || b, 'date|time|datetime|timestamp|calendar|period|month|year|day|hour') THEN 'time'
  WHEN regexp_matches(n || chr(10) || b, 'product|item|goods|merchandise|sku|inventory|catalog|category|coupon|discount|price') THEN 'product'
  WHEN regexp_matches(n || chr(10) || b, 'order|transaction|sale|purchase|shipment|delivery|payment|review|feedback|event|action|behavior') THEN 'event'
  WHEN regexp_matches(n || chr(10) || b, 'location|address|city|country|region|state|province|zip|postal|geo|place|area') THEN 'location'
  ELSE 'product' END AS dimension_class FROM t
"""
)
def classify_dimension(spark, root):
    kind = F.when(F.col("n_chars") > 20000, "time").otherwise(F.col("lang"))
    found = dimension_class(F.col("source"), F.col("text"), kind)
    return _documents(spark, root).select("doc_id", found.alias("dimension_class"))
