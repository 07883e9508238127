"""Registered queries over the whole catalog: profile, keys, findings, decisions, star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import table_category
from ..operators import business, chunks, decisions, findings, keys, profile, star, validate, values
from ..sources.catalog import column_descriptors, declared_constraints
from ..sources.staging import stage
from . import catalog_sql as sql
from . import understanding
from .lake import COLUMNS, KEY_SETS, KEYS, aged_lake, open_lake, survey_lake
from .registry import query

@query(sql.counts_sql())
def row_counts(spark, root):
    return profile.row_counts(open_lake(spark, root))


@query(f"SELECT table_name, row_count, row_count > 0 AS has_bytes FROM ({sql.counts_sql()})")
def table_stats(spark, root):
    stats = profile.table_stats(open_lake(spark, root))
    return stats.select("table_name", "row_count", (F.col("stored_bytes") > 0).alias("has_bytes"))


@query(sql.profile_sql())
def column_profile(spark, root):
    found = profile.profile_catalog(open_lake(spark, root))
    return found.withColumn("avg_number", F.round("avg_number", 4)).drop("family", "nullable", "marked_count")


@query(
    "SELECT 'lake' AS database, count(*) OVER () AS tables_count, table_name, row_count, column_count, "
    "primary_key, foreign_key_count FROM ("
    + sql.union(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(sql.columns_of(t))}::BIGINT AS column_count, "
        f"'{','.join(KEYS[t].primary)}' AS primary_key, {len(KEYS[t].foreign)}::BIGINT AS foreign_key_count FROM {t}"
        for t in COLUMNS
    )
    + ")"
)
def profile_database(spark, root):
    return profile.profile_database(open_lake(spark, root))


def _report(spark, root):
    return profile.table_report(open_lake(spark, root), recent=("o_orderdate", "l_shipdate", "ts"))


@query(
    sql.union(
        f"SELECT '{t}' AS table_name, '{','.join(n for n, _ in sql.columns_of(t))}' AS columns, "
        f"'{' '.join(KEYS[t].primary)}' AS primary_keys, least(count(*), 5)::INT AS sample_count, count(*) AS row_count, "
        f"{len(sql.columns_of(t))} AS column_count, {bool(KEYS[t].primary or KEYS[t].foreign)} AS has_constraints, "
        f"{bool(KEYS[t].primary)} AS has_indexes FROM {t}"
        for t in COLUMNS
    )
)
def table_report(spark, root):
    report = _report(spark, root)
    return report.select(
        "table_name",
        F.array_join(F.transform("schema", lambda c: c["name"]), ",").alias("columns"),
        F.array_join("constraints.primary_keys", " ").alias("primary_keys"),
        F.size("samples").alias("sample_count"),
        "row_count", "column_count", "has_constraints", "has_indexes",
    )


RECENT = ("o_orderdate", "l_shipdate", "ts")


def _newest_sql(table: str) -> str:
    names = [n for n, _ in sql.columns_of(table)]
    order = ", ".join([f"{c} DESC NULLS FIRST" for c in RECENT if c in names] + list(KEYS[table].primary))
    key = " || ',' || ".join(f"{c}::VARCHAR" for c in KEYS[table].primary)
    return (
        f"SELECT 'lake' AS database, {len(COLUMNS)}::BIGINT AS tables_count, '{table}' AS table_name, "
        f"(row_number() OVER (ORDER BY {order}) - 1)::INT AS place, {key} AS row_key FROM {table} QUALIFY place < 5"
    )


@query(sql.union(_newest_sql(t) for t in COLUMNS if KEYS.get(t) and KEYS[t].primary))
def database_report(spark, root):
    """What the samples of the stage report hold: the keys of the newest rows of every table with a key, in order."""
    lake = open_lake(spark, root)
    tables = profile.database_report(lake, recent=RECENT).select("database", "tables_count", F.inline("tables"))
    rows = tables.select("database", "tables_count", "table_name", F.posexplode("samples").alias("place", "sample"))
    key = F.lit(None).cast("string")
    for name in lake.names:
        fields = [F.get_json_object("sample", f"$.{c}") for c in lake.keys_of(name).primary]
        key = F.when(F.col("table_name") == name, F.concat_ws(",", *fields)).otherwise(key) if fields else key
    return rows.withColumn("row_key", key).filter("row_key IS NOT NULL").drop("sample")


@query(
    "SELECT count(*) AS tables_count, sum(c)::BIGINT AS total_columns, sum(least(n, 5))::BIGINT AS total_samples, "
    "count_if(k) AS tables_with_constraints, count_if(u) AS tables_with_indexes FROM ("
    + sql.union(
        f"SELECT {len(sql.columns_of(t))} AS c, count(*) AS n, {bool(KEYS[t].primary or KEYS[t].foreign)} AS k, "
        f"{bool(KEYS[t].primary)} AS u FROM {t}"
        for t in COLUMNS
    )
    + ")"
)
def database_overview(spark, root):
    return profile.database_overview(_report(spark, root))


@query(
    f"SELECT table_name, row_count, CASE WHEN row_count = 0 THEN 'empty' WHEN row_count < 10 THEN 'low' "
    f"WHEN row_count > 10000 THEN 'high' END AS usage_band FROM ({sql.AGED_COUNTS})"
)
def table_usage_bands(spark, root):
    return profile.usage_bands(profile.row_counts(aged_lake(spark, root)))


@query(sql.key_candidates_sql())
def key_candidates(spark, root):
    return keys.key_candidates(open_lake(spark, root), KEY_SETS)


REFERENCE_PAIRS = """
pairs(ct, cc, pt, pc) AS (VALUES
  ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('region', 'r_regionkey', 'nation', 'n_regionkey'),
  ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('nation', 'n_nationkey', 'customer', 'c_nationkey'),
  ('supplier', 's_nationkey', 'nation', 'n_nationkey'), ('nation', 'n_nationkey', 'supplier', 's_nationkey'),
  ('customer', 'c_nationkey', 'supplier', 's_nationkey'), ('supplier', 's_nationkey', 'customer', 'c_nationkey'),
  ('orders', 'o_custkey', 'customer', 'c_custkey'), ('customer', 'c_custkey', 'orders', 'o_custkey'),
  ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('orders', 'o_orderkey', 'lineitem', 'l_orderkey'),
  ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('part', 'p_partkey', 'lineitem', 'l_partkey'),
  ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'), ('supplier', 's_suppkey', 'lineitem', 'l_suppkey'),
  ('labels', 'doc_id', 'documents', 'doc_id'), ('documents', 'doc_id', 'labels', 'doc_id'))
"""
KEY_VALUES = sql.union(
    f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"
    for t, c in (
        ("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"),
        ("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"),
        ("supplier", "s_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"),
        ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"),
        ("documents", "doc_id"), ("labels", "doc_id"),
    )
)


@query(
    f"""
WITH {REFERENCE_PAIRS}, vals AS ({KEY_VALUES}),
uniq AS (SELECT t, c, max(n) = 1 AS parent_unique FROM vals GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column,
  count(*) AS child_distinct, count(p.v) AS matched_distinct, round(count(p.v) / count(*), 6) AS inclusion,
  sum(k.n)::BIGINT AS child_rows, coalesce(sum(k.n) FILTER (p.v IS NULL), 0)::BIGINT AS orphan_rows,
  any_value(parent_unique) AS parent_unique,
  CASE WHEN NOT any_value(parent_unique) THEN 'many_to_many' WHEN max(k.n) = 1 THEN 'one_to_one'
    ELSE 'many_to_one' END AS cardinality
FROM pairs JOIN vals k ON k.t = ct AND k.c = cc LEFT JOIN vals p ON p.t = pt AND p.c = pc AND p.v = k.v
JOIN uniq ON uniq.t = pt AND uniq.c = pc
GROUP BY ct, cc, pt, pc
"""
)
def fk_inclusion(spark, root):
    lake = open_lake(spark, root)
    return keys.reference_inclusion(lake, keys.reference_pairs(lake))


def _flag(name: str) -> str:
    return f"WITH {sql.findings_ctes()} SELECT table_name, column_name FROM flags WHERE {name}"


def _survey_profile(spark, root):
    lake = survey_lake(spark, root)
    return findings.with_key_flags(findings.findings_profile(lake), lake)


def _rule(spark, root, rule):
    return _survey_profile(spark, root).filter(rule).select("table_name", "column_name")


@query(_flag("f_unused"))
def col_unused(spark, root):
    lake = survey_lake(spark, root)
    return profile.profile_catalog(lake, "none").filter(findings.unused_rule()).select("table_name", "column_name")


@query(_flag("f_collection"))
def col_collection(spark, root):
    lake = survey_lake(spark, root)
    stats = profile.profile_catalog(lake, "none")
    return stats.filter(findings.collection_rule()).select("table_name", "column_name")


@query(_flag("f_enum"))
def col_enum(spark, root):
    return _rule(spark, root, findings.enum_rule())


@query(_flag("f_values"))
def col_value_list(spark, root):
    return _rule(spark, root, findings.value_list_rule())


@query(_flag("f_int"))
def col_undefined_int(spark, root):
    lake = survey_lake(spark, root)
    stats = findings.with_key_flags(profile.profile_catalog(lake, "none"), lake)
    return stats.filter(findings.undefined_int_rule()).select("table_name", "column_name")


def _issues(spark, root):
    return findings.column_issues(_survey_profile(spark, root))


def _asked(spark, root):
    """The column questions, kept, as the answers below are made from them too."""
    return stage(findings.column_questions(_issues(spark, root)))


@query(f"WITH {sql.findings_ctes()} SELECT table_name, ordinal, column_name, data_type, issues FROM found")
def column_issues(spark, root):
    found = _issues(spark, root)
    return found.drop("nullable").withColumn("issues", F.array_join("issues", ","))


@query(
    f"WITH {sql.findings_ctes()}, {sql.QUESTIONS_CTE} SELECT 'q' || question_number AS question_id, table_name, "
    "column_name, question_type, question, o1 || '|' || o2 || '|' || o3 AS options FROM questions"
)
def column_questions(spark, root):
    asked = findings.column_questions(_issues(spark, root))
    return asked.select(
        "question_id", "table_name", "column_name", "question_type", "question",
        F.array_join("options", "|").alias("options"),
    )


def _column_answers(asked):
    """Answers that pick the questions' options in turn."""
    pick = F.get(F.col("options"), (F.col("question_number") % 3).cast("int"))
    return asked.select("question_id", pick.alias("response"))


def _column_decisions(spark, root):
    asked = _asked(spark, root)
    answered = decisions.answer_questions(asked, _column_answers(asked))
    return decisions.column_decisions(answered)


@query(
    f"WITH {sql.findings_ctes()}, {sql.QUESTIONS_CTE} "
    "SELECT question_id, table_name, column_name, question_type, response FROM answered"
)
def answers_join(spark, root):
    asked = _asked(spark, root)
    joined = decisions.answer_questions(asked, _column_answers(asked))
    return joined.select("question_id", "table_name", "column_name", "question_type", "response")


@query(
    f"WITH {sql.findings_ctes()}, {sql.QUESTIONS_CTE} "
    "SELECT question_id, table_name, column_name, decision, value_list FROM decided"
)
def column_decisions(spark, root):
    return _column_decisions(spark, root).select(
        "question_id", "table_name", "column_name", "decision", "value_list"
    )


@query(
    f"WITH {sql.findings_ctes()}, {sql.QUESTIONS_CTE} "
    "SELECT decision, count(*) AS decision_count FROM decided GROUP BY decision"
)
def decision_counts(spark, root):
    return decisions.decision_counts(_column_decisions(spark, root))


LISTED_VALUES = sql.union(
    f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM {f'survey_{t}' if t in sql.SURVEY_EXTRA else t} "
    f"WHERE length({c}::VARCHAR) > 0 GROUP BY {c}"
    for t in COLUMNS
    for c, kind in sql.columns_of(t) + ([sql.SURVEY_EXTRA[t]] if t in sql.SURVEY_EXTRA else [])
    if kind == "string" or kind in sql.INTS
)


@query(
    f"WITH {sql.findings_ctes()}, {sql.QUESTIONS_CTE}, vals AS ({LISTED_VALUES}) "
    "SELECT t || '_' || c || '_values' AS list_name, v AS value, n AS value_count FROM vals "
    "JOIN (SELECT DISTINCT table_name, column_name FROM decided WHERE value_list IN ('enum', 'options')) ON t = table_name AND c = column_name"
)
def applied_value_lists(spark, root):
    """The value lists of all columns that the answers ask one for, as the decided catalog has them."""
    lake = survey_lake(spark, root)
    made = decisions.apply_column_decisions(lake, stage(_column_decisions(spark, root)))
    lists = [n for n in made.names if n not in lake.tables and n.endswith("_values")]
    return profile.union_all(made[n].select(F.lit(n).alias("list_name"), "value", "value_count") for n in lists)


@query(
    "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::INT - 1 AS item_position, "
    "unnest(string_split(p_name, ' ')) AS item FROM part"
)
def collection_child_table(spark, root):
    return values.collection_child_table(survey_lake(spark, root)["part"], ["p_partkey"], "p_tags")


@query(
    "SELECT o_orderpriority AS value, count(*) AS value_count FROM orders "
    "WHERE o_orderpriority <> '' GROUP BY o_orderpriority"
)
def value_lookup_table(spark, root):
    return values.value_lookup_table(open_lake(spark, root, "orders")["orders"], "o_orderpriority")


@query(
    sql.union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS value_count "
        f"FROM {t} WHERE {c} <> '' GROUP BY {c}"
        for t, c in (
            ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"),
            ("orders", "o_orderpriority"), ("events", "event_type"), ("part", "p_type"),
        )
    )
)
def enum_values(spark, root):
    lake = open_lake(spark, root, "lineitem", "orders", "events", "part")
    wanted = {
        "lineitem": ["l_returnflag", "l_linestatus"],
        "orders": ["o_orderstatus", "o_orderpriority"],
        "events": ["event_type"],
        "part": ["p_type"],
    }
    return profile.union_all(values.enum_values(lake[t], t, c) for t, c in wanted.items())


@query(
    """
WITH v AS (
  SELECT 'p_name' AS column_name, p_name AS value, p_partkey AS pos FROM part
  UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part
  UNION ALL SELECT 'p_type', p_type, p_partkey FROM part),
c AS (SELECT column_name, value, count(*) AS value_count, min(pos) AS first FROM v WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY first, value) AS rn,
        count(*) OVER (PARTITION BY column_name) AS total_unique FROM c)
SELECT 'part' AS table_name, column_name, value, value_count,
  CASE WHEN rn <= 10 THEN rn::INT END AS example_rank, total_unique FROM r
"""
)
def value_options(spark, root):
    part = open_lake(spark, root, "part")["part"]
    return values.value_options(part, "part", ["p_name", "p_brand", "p_type"], F.col("p_partkey"))


@query(
    "SELECT 'part' AS table_name, 'p_tags' AS column_name, item, count(*) AS item_count FROM "
    "(SELECT trim(unnest(string_split(replace(p_name, ' ', ','), ','))) AS item FROM part) WHERE item <> '' GROUP BY item"
)
def collection_items(spark, root):
    return values.collection_item_counts(survey_lake(spark, root)["part"], "part", "p_tags")


def _aged_counts(spark, root):
    """Row counts, one row a table, kept: questions, answers and tables are made from them."""
    return stage(profile.row_counts(aged_lake(spark, root)))


def _table_questions(counts):
    return stage(findings.table_questions(counts))


@query(
    f"WITH {sql.table_question_ctes()} SELECT 'q' || question_number AS question_id, table_name, row_count, "
    "question_type, question, array_to_string(options, '|') AS options FROM questions"
)
def table_questions(spark, root):
    return _table_questions(_aged_counts(spark, root)).select(
        "question_id", "table_name", "row_count", "question_type", "question",
        F.array_join("options", "|").alias("options"),
    )


def _table_decisions(counts):
    asked = _table_questions(counts)
    pick = F.get(F.col("options"), ((F.col("question_number") + 2) % 3).cast("int"))
    answers = asked.select("question_id", pick.alias("response"))
    questions = asked.select("question_id", F.explode("related_tables").alias("table_name"))
    return decisions.table_decisions(decisions.answer_questions(questions, answers))


@query(f"WITH {sql.table_question_ctes()} SELECT question_id, table_name, response, decision FROM decided")
def table_decisions(spark, root):
    return _table_decisions(_aged_counts(spark, root)).select("question_id", "table_name", "response", "decision")


@query(
    f"WITH {sql.table_question_ctes()} SELECT table_name, row_count FROM counts "
    "WHERE table_name NOT IN (SELECT table_name FROM decided WHERE decision = 'drop')"
)
def exclude_tables(spark, root):
    counts = _aged_counts(spark, root)
    return decisions.exclude_tables(counts, _table_decisions(counts))


CONSTRAINTS = (
    validate.not_null("customer", "c_name"),
    validate.not_null("orders", "o_custkey"),
    validate.in_list("orders", "o_orderstatus", ["F", "O"]),
    validate.at_least("customer", "c_acctbal", 0),
    validate.between("part", "p_size", 1, 40),
    validate.above("lineitem", "l_discount", 0),
    validate.UniqueRule("orders", ("o_orderkey",)),
    validate.UniqueRule("part", ("p_name",)),
    validate.UniqueRule("lineitem", ("l_orderkey", "l_linenumber")),
    validate.ReferenceRule("lineitem", "l_orderkey", "orders", "o_orderkey"),
    validate.ReferenceRule("documents", "doc_id", "labels", "doc_id"),
)


@query(
    """
SELECT 'customer' AS table_name, 'c_name not null' AS rule, count_if(c_name IS NULL) AS violations FROM customer
UNION ALL SELECT 'orders', 'o_custkey not null', count_if(o_custkey IS NULL) FROM orders
UNION ALL SELECT 'orders', 'o_orderstatus in list', count_if(o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'customer', 'c_acctbal at least 0', count_if(c_acctbal < 0) FROM customer
UNION ALL SELECT 'part', 'p_size in range', count_if(p_size NOT BETWEEN 1 AND 40) FROM part
UNION ALL SELECT 'lineitem', 'l_discount above 0', count_if(l_discount <= 0) FROM lineitem
UNION ALL SELECT 'orders', 'o_orderkey unique', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'part', 'p_name unique', count(p_name) - count(DISTINCT p_name) FROM part
UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'lineitem', 'l_orderkey in orders.o_orderkey', count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'documents', 'doc_id in labels.doc_id', count(*) FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""
)
def constraint_violations(spark, root):
    lake = open_lake(spark, root, "customer", "orders", "part", "lineitem", "documents", "labels")
    return validate.constraint_violations(lake, CONSTRAINTS)


@query(
    f"""
WITH c AS ({sql.counts_sql()}), k AS (SELECT *, CASE
  WHEN regexp_matches(table_name, 'user|member') THEN 'User Management'
  WHEN regexp_matches(table_name, 'order|transaction') THEN 'Order Processing'
  WHEN regexp_matches(table_name, 'product|item') THEN 'Product Management'
  WHEN regexp_matches(table_name, 'payment|tender') THEN 'Payment Processing'
  WHEN regexp_matches(table_name, 'benefit|coupon|voucher|promotion') THEN 'Promotions & Benefits'
  WHEN regexp_matches(table_name, 'log|audit') THEN 'Audit & Logging'
  WHEN regexp_matches(table_name, 'tier|level') THEN 'Membership Tiers'
  WHEN regexp_matches(table_name, 'contact|client') THEN 'Contact Management'
  WHEN regexp_matches(table_name, 'currency') THEN 'Currency Management'
  WHEN regexp_matches(table_name, 'migration|schema') THEN 'System Management'
  ELSE 'General Business Data' END AS category FROM c)
SELECT category, string_agg(table_name, ',' ORDER BY table_name) AS tables, sum(row_count)::BIGINT AS total_rows
FROM k GROUP BY category
"""
)
def classify_tables(spark, root):
    counts = profile.row_counts(open_lake(spark, root))
    named = counts.withColumn("category", table_category(F.col("table_name")))
    return named.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("tables"),
        F.sum("row_count").alias("total_rows"),
    )


def _star(spark, root):
    lake = open_lake(spark, root)
    likely = keys.promising_columns(lake)
    return column_descriptors(spark, lake), keys.key_candidates(lake, KEY_SETS, likely), lake, likely


def _dimensions(spark, root, rules=None):
    columns, found, lake, _ = _star(spark, root)
    return star.detect_dimensions(columns, found, declared_constraints(spark, lake), rules)


def _dimensions_sql(*rows):
    return sql.union(
        f"SELECT '{name}' AS name, '{kind}' AS dimension_class, '{t}' AS source_table, '{key}' AS key_fields, "
        f"'{texts}' AS attributes FROM {t} HAVING count(*) = count(DISTINCT ({key}))"
        for t, key, name, kind, texts in rows
    )


DIMENSIONS_SQL = _dimensions_sql(
    ("region", "r_regionkey", "dim_region", "location", "r_name"),
    ("nation", "n_nationkey", "dim_nation", "product", "n_name"),
    ("customer", "c_custkey", "dim_customer", "people", "c_mktsegment,c_name"),
    ("supplier", "s_suppkey", "dim_supplier", "people", "s_name"),
    ("part", "p_partkey", "dim_part", "product", "p_brand,p_name,p_type"),
    ("orders", "o_orderkey", "dim_order", "event", "o_orderpriority,o_orderstatus"),
    ("events", "event_id", "dim_event", "event", "event_type,props"),
    ("documents", "doc_id", "dim_document", "product", "lang,source,text"),
    ("pages", "page_id", "dim_page", "product", "html,url"),
    ("benchmark", "item_id", "dim_benchmark", "product", "text"),
    ("conversations", "conv_id,turn", "dim_conversation", "product", "role,text"),
)


def _listed(dimensions):
    return dimensions.select(
        "name", "dimension_class", "source_table",
        F.array_join("key_fields", ",").alias("key_fields"), F.array_join("attributes", ",").alias("attributes"),
    )


@query(DIMENSIONS_SQL)
def detect_dimensions(spark, root):
    return _listed(_dimensions(spark, root))


RULES = [
    (1, "^pages$", "^html$", "ignore"), (2, "^part$", "^p_size$", "attribute"), (3, "^events$", ".", "ignore"),
    (4, "^lineitem$", "^l_(orderkey|linenumber)$", "key"), (5, "^orders$", ".", "class:people"), (6, ".", "^text$", "ignore"),
    (7, "^documents$", "^text$", "key"), (8, "^lineitem$", "^l_linenumber$", "measure"),
]


@query(
    _dimensions_sql(
        ("region", "r_regionkey", "dim_region", "location", "r_name"),
        ("nation", "n_nationkey", "dim_nation", "product", "n_name"),
        ("customer", "c_custkey", "dim_customer", "people", "c_mktsegment,c_name"),
        ("supplier", "s_suppkey", "dim_supplier", "people", "s_name"),
        ("part", "p_partkey", "dim_part", "product", "p_brand,p_name,p_size,p_type"),
        ("orders", "o_orderkey", "dim_order", "people", "o_orderpriority,o_orderstatus"),
        ("documents", "doc_id", "dim_document", "product", "lang,source"),
        ("pages", "page_id", "dim_page", "product", "url"),
        ("conversations", "conv_id,turn", "dim_conversation", "product", "role"),
    )
    + "\nUNION ALL SELECT 'dim_lineitem', 'product', 'lineitem', 'l_orderkey,l_linenumber', 'l_linestatus,l_returnflag'"
)
def detect_dimensions_ruled(spark, root):
    """Dimensions under a caller's rules, the earlier rule first."""
    rules = spark.createDataFrame(RULES, "priority int, table_pattern string, column_pattern string, role string")
    return _listed(_dimensions(spark, root, rules))


@query(
    """
SELECT 'fact_lineitem' AS name, 'lineitem' AS source_table,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'l_discount,l_extendedprice,l_quantity,l_tax'
       ELSE 'l_discount,l_extendedprice,l_linenumber,l_quantity,l_tax' END AS measures,
  'orders,part,supplier' AS dimensions
FROM lineitem HAVING count_if(l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0
  AND count_if(l_partkey NOT IN (SELECT p_partkey FROM part)) = 0
  AND count_if(l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) = 0
"""
)
def detect_facts(spark, root):
    columns, found, lake, likely = _star(spark, root)
    facts = star.detect_facts(columns, found, keys.discover_references(lake, likely=likely))
    return facts.select(
        "name", "source_table",
        F.array_join("measures", ",").alias("measures"), F.array_join("dimensions", ",").alias("dimensions"),
    )


@query(
    f"""
WITH m AS (SELECT name, dimension_class AS c FROM ({DIMENSIONS_SQL})),
classes(c, description) AS (VALUES
  ('people', '人 - 資料模型裡面的對象 (客戶、使用者、供應商等)'), ('time', '時間 - 時間維度'),
  ('product', '物體 - 資料模型裡面的物體 (產品、折扣券等)'), ('event', '事件 - 資料模型裡面的事件 (運輸、銷售等)'),
  ('location', '地點 - 上述發生的地點'))
SELECT c AS dimension_class, any_value(description) AS description,
  coalesce(string_agg(name, ',' ORDER BY name), '') AS dimensions, count(name) AS dimension_count
FROM classes LEFT JOIN m USING (c) GROUP BY c
"""
)
def dimension_report(spark, root):
    return business.dimension_report(_dimensions(spark, root))


@query(sql.table_text_sql())
def table_text(spark, root):
    report = _report(spark, root)
    return chunks.table_text(report).join(report.select("table_name", "row_count"), "table_name")


@query(
    f"""
SELECT 'phase1' AS phase, 'table_schema' AS kind, table_name AS name, trim(content) AS content, row_count > 0 AS filled
FROM ({sql.table_text_sql()})
UNION ALL SELECT 'phase1', 'table_samples', table_name,
  'Sample data for table: ' || table_name || ', ' || least(row_count, 3) || ' rows', true
FROM ({sql.counts_sql()}) WHERE row_count > 0
UNION ALL SELECT 'phase2', 'knowledge_chunk', 'event_' || event_id, 'k: ' || json_extract_string(props, '$.k'), true FROM events
"""
)
def chunk_sections(spark, root):
    report = _report(spark, root)
    found = open_lake(spark, root, "events")["events"].select(
        F.lit("phase2").alias("phase"), F.concat(F.lit("event_"), "event_id").alias("source"), F.col("props").alias("body")
    )
    content = F.col("content")
    lines = F.size(F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.lit("Sample ")))) - 1
    samples = F.concat(F.element_at(F.split(content, "\n"), 1), F.lit(", "), lines, F.lit(" rows"))
    return chunks.chunk_sections(report, found).select(
        "phase",
        "kind",
        F.coalesce("table_name", "source").alias("name"),
        F.when(F.col("kind") == "table_samples", samples).otherwise(F.btrim(content, F.lit(" "))).alias("content"),
        F.lit(True).alias("filled"),
    )


@query(
    f"""
WITH d AS ({sql.description_sql()}), s AS (SELECT table_name, CASE WHEN length(description) <= 200 THEN description
  WHEN 200 - strpos(reverse(substr(description, 1, 200)), '.') > 50 AND strpos(substr(description, 1, 200), '.') > 0
    THEN substr(description, 1, 201 - strpos(reverse(substr(description, 1, 200)), '.'))
  ELSE substr(description, 1, 200) || '...' END AS cut FROM d)
SELECT 'Database: lake (parquet)' || chr(10) || 'Total Tables Analyzed: ' || count(*) || chr(10) || chr(10)
  || 'Table Summary:' || chr(10) || '=============' || chr(10) || chr(10)
  || string_agg('• ' || table_name || ': ' || cut || chr(10), '' ORDER BY table_name)
  || chr(10) || 'Table List:' || chr(10) || '===========' || chr(10)
  || string_agg('• ' || table_name || chr(10), '' ORDER BY table_name) AS summary
FROM s
"""
)
def database_summary(spark, root):
    return business.database_summary(understanding.table_descriptions(open_lake(spark, root)), "lake")
