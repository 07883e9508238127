"""DuckDB SQL for catalog-wide checks, written from the lake's column lists."""

from __future__ import annotations

from .lake import COLUMNS, KEYS

INTS = ("tinyint", "smallint", "int", "bigint")
TEMPLATE_ORDER = (
    "potentially_unused", "potential_collection", "enum_usage", "undefined_int", "value_collection_needed",
)


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in COLUMNS[table].split(", ")]


def family(kind: str) -> str:
    if kind in INTS or kind in ("double", "float"):
        return "number"
    return {"string": "text", "timestamp_ntz": "time"}.get(kind, "array" if kind.startswith("array") else "other")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def profile_sql() -> str:
    rows = []
    for table in COLUMNS:
        for ordinal, (name, kind) in enumerate(columns_of(table), start=1):
            fam = family(kind)
            number, text, time = fam == "number", fam == "text", fam == "time"
            rows.append(
                f"SELECT '{table}' AS table_name, {ordinal} AS ordinal, '{name}' AS column_name, "
                f"'{kind}' AS data_type, count(*) AS row_count, count(*) - count({name}) AS null_count, "
                f"{f'count_if({name} = chr(0) || chr(0) OR length({name}) = 0)' if text else '0'}::BIGINT AS empty_count, "
                f"count(DISTINCT {name}) AS distinct_count, "
                f"{f'min({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS min_number, "
                f"{f'max({name})::DOUBLE' if number else 'NULL::DOUBLE'} AS max_number, "
                f"{f'round(avg({name}), 4)' if number else 'NULL::DOUBLE'} AS avg_number, "
                f"{f'min({name})' if text else 'NULL::VARCHAR'} AS min_text, "
                f"{f'max({name})' if text else 'NULL::VARCHAR'} AS max_text, "
                f"{f'min({name})::VARCHAR' if time else 'NULL::VARCHAR'} AS min_time, "
                f"{f'max({name})::VARCHAR' if time else 'NULL::VARCHAR'} AS max_time FROM {table}"
            )
    return union(rows)


SURVEY_VIEWS = """
survey_orders AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
                            THEN 'call first' END AS o_note FROM orders),
survey_part AS (SELECT *, replace(p_name, ' ', ',') AS p_tags FROM part)
"""
SURVEY_EXTRA = {"orders": ("o_note", "string"), "part": ("p_tags", "string")}


def findings_ctes() -> str:
    """CTEs ``survey_*``, ``prof`` (counts per column), ``flags`` and ``found`` (issues per column)."""
    rows = []
    for table in COLUMNS:
        columns = columns_of(table) + ([SURVEY_EXTRA[table]] if table in SURVEY_EXTRA else [])
        source = f"survey_{table}" if table in SURVEY_EXTRA else table
        primary = KEYS[table].primary
        foreign = [c for k in KEYS[table].foreign for c in k.columns]
        for ordinal, (name, kind) in enumerate(columns, start=1):
            fam = family(kind)
            text = fam == "text"
            filled = f"nullif({name}, '')" if text else name
            rows.append(
                f"SELECT '{table}' AS table_name, {ordinal} AS ordinal, '{name}' AS column_name, "
                f"'{kind}' AS data_type, '{fam}' AS family, {str(name in primary).lower()} AS in_primary, "
                f"{str(name in foreign).lower()} AS in_foreign, count(*) AS n, count({filled}) AS filled, "
                f"count(DISTINCT {filled}) AS uniq, "
                + (
                    f"count_if(regexp_matches({name}, '[,;\\[{{|]')) AS marked FROM {source}"
                    if text
                    else f"0::BIGINT AS marked FROM {source}"
                )
            )
    return f"""
{SURVEY_VIEWS},
prof AS ({union(rows)}),
flags AS (
  SELECT table_name, ordinal, column_name, data_type,
    coalesce(n > 0 AND (n - filled) / n > 0.8, false) AS f_unused,
    (family = 'array' OR (family = 'text' AND marked > 2)) AS f_collection,
    (family = 'text' AND n >= 5 AND uniq > 1 AND uniq < n // 5) AS f_enum,
    (n >= 3 AND filled >= 3 AND CASE
      WHEN regexp_matches(lower(column_name), 'status|type|state|gender|category') THEN uniq <= 20
      WHEN regexp_matches(lower(column_name), 'name|title|city|address') THEN uniq > 1 AND uniq <= n // 2
      WHEN list_contains(string_split(lower(column_name), '_'), 'id')
           AND NOT regexp_matches(lower(column_name), 'uuid|guid') THEN uniq > 1 AND uniq <= n // 3
      WHEN family = 'text' THEN uniq / filled > 0.1 AND uniq / filled < 0.9 AND uniq <= 50
      ELSE false END) AS f_values,
    (data_type IN ('tinyint', 'smallint', 'int', 'bigint') AND NOT in_primary AND NOT in_foreign) AS f_int
  FROM prof),
found AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN f_unused THEN 'potentially_unused' END, CASE WHEN f_collection THEN 'potential_collection' END,
      CASE WHEN f_enum THEN 'enum_usage' END, CASE WHEN f_values THEN 'value_collection_needed' END,
      CASE WHEN f_int THEN 'undefined_int' END], lambda x: x IS NOT NULL), ',') AS issues
  FROM flags WHERE f_unused OR f_collection OR f_enum OR f_values OR f_int)
"""


QUESTIONS_CTE = """
kinds(issue_order, question_type, head, middle, tail, o1, o2, o3) AS (VALUES
  (0, 'unused_column_check', '表格 ''', ''' 的欄位 ''', ''' 看起來可能沒有在使用（大量空值）。這個欄位是否還在被應用程序使用？',
   '不再使用，可以移除', '仍在使用', '需要進一步檢查'),
  (1, 'collection_check', '表格 ''', ''' 的欄位 ''', ''' 看起來像是儲存了多個值的集合。這個欄位是否應該轉換為關聯表格？',
   '應該轉換為關聯表格', '保持現狀', '需要進一步檢查'),
  (2, 'enum_check', '表格 ''', ''' 的欄位 ''', ''' 看起來使用了枚舉值。這個欄位的枚舉值是否完整定義？',
   '枚舉值完整', '枚舉值不完整，需要補充', '需要進一步檢查'),
  (3, 'int_definition_check', '表格 ''', ''' 的欄位 ''', ''' 使用了 int 類型但看起來沒有明確的定義。這個欄位是否需要更好的定義？',
   '需要更好的定義', '定義已經足夠', '需要進一步檢查'),
  (4, 'value_collection_check', '表格 ''', ''' 的欄位 ''', ''' 包含了多個不同的值。這個欄位是否需要搜集可用的值選項？',
   '需要搜集值選項', '不需要，值動態生成', '需要進一步檢查')),
asked AS (
  SELECT f.table_name, f.ordinal, f.column_name, k.issue_order, k.question_type,
    k.head || f.table_name || k.middle || f.column_name || k.tail AS question, k.o1, k.o2, k.o3
  FROM found f JOIN kinds k ON CASE k.issue_order WHEN 0 THEN f.f_unused WHEN 1 THEN f.f_collection
    WHEN 2 THEN f.f_enum WHEN 3 THEN f.f_int ELSE f.f_values END),
questions AS (
  SELECT *, row_number() OVER (ORDER BY table_name, ordinal, issue_order) AS question_number FROM asked),
answered AS (
  SELECT 'q' || question_number AS question_id, table_name, column_name, question_type,
    CASE question_number % 3 WHEN 0 THEN o1 WHEN 1 THEN o2 ELSE o3 END AS response FROM questions),
decided AS (
  SELECT *, CASE
    WHEN question_type = 'unused_column_check' AND (response LIKE '%不再使用%' OR response LIKE '%可以移除%') THEN 'remove'
    WHEN question_type = 'collection_check' AND response LIKE '%應該轉換%' THEN 'convert'
    WHEN question_type = 'enum_check' AND response LIKE '%枚舉值完整%' THEN 'enum'
    WHEN question_type = 'enum_check' AND response LIKE '%枚舉值不完整%' THEN 'define'
    WHEN question_type = 'int_definition_check' AND response LIKE '%需要更好的定義%' THEN 'define'
    WHEN question_type = 'value_collection_check' AND response LIKE '%需要搜集值選項%' THEN 'define'
    ELSE 'review' END AS decision,
  CASE
    WHEN question_type = 'collection_check' AND response LIKE '%應該轉換%' THEN 'items'
    WHEN question_type = 'enum_check' AND response LIKE '%枚舉值%' THEN 'enum'
    WHEN question_type = 'value_collection_check' AND response LIKE '%需要搜集值選項%' THEN 'options'
    ELSE 'none' END AS value_list
  FROM answered)
"""


def counts_sql(extra: str = "") -> str:
    rows = [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COLUMNS]
    return union(rows + ([extra] if extra else []))


AGED_COUNTS = counts_sql(
    "SELECT 'events_archive' AS table_name, count(*) AS row_count FROM events WHERE ts < TIMESTAMP '2000-01-01'"
)


def table_question_ctes() -> str:
    return f"""
counts AS ({AGED_COUNTS}),
asked AS (
  SELECT table_name, row_count,
    CASE WHEN row_count = 0 THEN 'empty_table_check' ELSE 'usage_check' END AS question_type,
    CASE WHEN row_count = 0 THEN '表格 ''' || table_name || ''' 是空的（0條記錄）。是否可以安全刪除這個表格？'
      ELSE '表格 ''' || table_name || ''' 只有 ' || row_count || ' 條記錄。這是否表示這個表格已經不再使用？' END AS question,
    CASE WHEN row_count = 0 THEN ['可以刪除', '保留（仍在使用）', '需要進一步檢查']
      ELSE ['不再使用，可以刪除', '仍在使用', '測試數據，可以清理'] END AS options
  FROM counts WHERE row_count < 10),
questions AS (
  SELECT *, row_number() OVER (ORDER BY question_type, table_name) AS question_number FROM asked),
decided AS (
  SELECT 'q' || question_number AS question_id, table_name, options[1 + (question_number + 2) % 3] AS response,
    CASE WHEN options[1 + (question_number + 2) % 3] LIKE '%刪除%' THEN 'drop'
      WHEN options[1 + (question_number + 2) % 3] LIKE '%保留%' OR options[1 + (question_number + 2) % 3] LIKE '%仍在使用%' THEN 'keep'
      ELSE 'review' END AS decision
  FROM questions)
"""


def key_candidates_sql() -> str:
    rows = []
    for table in COLUMNS:
        for name, kind in columns_of(table):
            if family(kind) in ("number", "text", "time"):
                rows.append(
                    f"SELECT '{table}' AS table_name, '{name}' AS key_columns, count(*) AS row_count, "
                    f"count(DISTINCT {name}) AS distinct_count, count(*) - count({name}) AS null_count FROM {table}"
                )
    for table, names in (("conversations", "conv_id,turn"), ("lineitem", "l_orderkey,l_linenumber")):
        first, second = names.split(",")
        rows.append(
            f"SELECT '{table}' AS table_name, '{names}' AS key_columns, count(*) AS row_count, "
            f"count(DISTINCT ({first}, {second})) AS distinct_count, "
            f"count_if({first} IS NULL OR {second} IS NULL) AS null_count FROM {table}"
        )
    return f"SELECT *, true AS is_key FROM ({union(rows)}) WHERE distinct_count = row_count AND null_count = 0 AND row_count > 0"


def table_text_sql() -> str:
    rows = []
    for table in COLUMNS:
        keys = KEYS[table]
        text = f"Table: {table}\nColumns:\n"
        text += "".join(f"  - {n} ({k}, nullable: true)\n" for n, k in columns_of(table))
        text += "Constraints:\n"
        if keys.primary:
            text += f"  Primary Keys: [{' '.join(keys.primary)}]\n"
        if keys.foreign:
            text += "  Foreign Keys:\n"
            text += "".join(f"    - {k.columns[0]} -> {k.ref_table}.{k.ref_columns[0]}\n" for k in keys.foreign)
        rows.append(f"SELECT '{table}' AS table_name, '{text}' AS content, count(*) AS row_count FROM {table}")
    return union(rows)


def description_sql() -> str:
    rows = []
    for table in COLUMNS:
        names = [n for n, _ in columns_of(table)]
        rows.append(
            f"SELECT '{table}' AS table_name, 'Table {table} holds ' || count(*) || ' rows in {len(names)} "
            f"columns. ' || 'They are {', '.join(names)}.' AS description FROM {table}"
        )
    return union(rows)


def inclusion_ctes() -> str:
    """CTEs ``vals`` (distinct values of each column as number or text), ``sizes`` and ``found`` (inclusions)."""
    rows, facts = [], []
    for table in COLUMNS:
        for name, kind in columns_of(table):
            fam = family(kind)
            if fam not in ("number", "text", "time"):
                continue
            value = f"{name}::DOUBLE + 0.0, NULL" if fam == "number" else f"NULL, '{fam}' || {name}::VARCHAR"
            rows.append(f"SELECT DISTINCT '{table}' AS t, '{name}' AS c, {value} FROM {table} WHERE {name} IS NOT NULL")
            facts.append(
                f"SELECT '{table}' AS t, '{name}' AS c, count(DISTINCT {name}) AS n, count(DISTINCT {name}) = count(*) AS u FROM {table}"
            )
    return f"""
vals(t, c, x, s) AS ({union(rows)}),
sizes AS (SELECT * FROM ({union(facts)}) WHERE n > 0),
shared AS (
  SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, count(*) AS n
  FROM vals a JOIN vals b ON a.x = b.x AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL
  UNION ALL
  SELECT a.t, a.c, b.t, b.c, count(*) FROM vals a JOIN vals b ON a.s = b.s AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL
),
found AS (
  SELECT child_table, child_column, parent_table, parent_column, k.n AS child_distinct, p.n AS parent_distinct,
    round(k.n / p.n, 6) AS coverage, p.u AS parent_unique
  FROM shared JOIN sizes k ON k.t = child_table AND k.c = child_column AND k.n = shared.n
  JOIN sizes p ON p.t = parent_table AND p.c = parent_column
)"""


def column_sets_sql(largest: int) -> str:
    """Minimal keys of one or two columns."""
    rows = []
    for table in COLUMNS:
        names = [n for n, kind in columns_of(table) if family(kind) in ("number", "text", "time")]
        sets = [(n,) for n in names] + ([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] if largest > 1 else [])
        for s in sets:
            null = " OR ".join(f"{n} IS NULL" for n in s)
            rows.append(
                f"SELECT '{table}' AS table_name, {list(s)} AS parts, count(*) AS row_count, "
                f"count(DISTINCT ({', '.join(s)})) AS n, count_if({null}) AS gaps FROM {table}"
            )
    return f"""
WITH sets AS ({union(rows)}),
keys AS (SELECT * FROM sets WHERE row_count > 0 AND n = row_count AND gaps = 0)
SELECT table_name, array_to_string(parts, ',') AS key_columns, len(parts)::INT AS set_size, row_count FROM keys k
WHERE NOT EXISTS (
  SELECT 1 FROM keys s WHERE s.table_name = k.table_name AND len(s.parts) < len(k.parts) AND list_has_all(k.parts, s.parts))
"""
