import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tabulight.functions import jsontext, text
from tabulight.functions.classify import dimension_class, table_category
from tabulight.operators import business, masking, values
from tabulight.plans import guarded


def apply(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").coalesce(1)
    return [r[1] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_leading_number(spark):
    cases = {"12 rows": 12, " 7": 7, "-5": -5, "+8": 8, "-5x": 0, "abc": 0, "": 0, "3.5": 3, "99999999999999999999": 0,
             "42": 42}
    assert apply(spark, text.leading_number, list(cases)) == list(cases.values())


def test_text_summary(spark):
    short, early = "a" * 200, "a" * 40 + "." + "b" * 300
    late = "a" * 100 + "." + "b" * 300
    at_51 = "a" * 51 + "." + "b" * 300
    got = apply(spark, text.text_summary, [short, early, late, at_51, "客" * 250])
    assert got == [short, early[:200] + "...", late[:101], at_51[:52], "客" * 200 + "..."]


def test_hard_cut(spark):
    assert apply(spark, text.hard_cut, ["a" * 500, "a" * 501]) == ["a" * 500, "a" * 500 + "..."]


def test_json_from_text(spark):
    schema = "business_logic_summary string, key_business_processes array<string>"
    body = 'Sure:\n{"business_logic_summary": "s", "key_business_processes": ["a", "b"]}\nDone'
    got = apply(spark, lambda c: text.json_from_text(c, schema), [body, "none", "} {"])
    assert got[0]["business_logic_summary"] == "s" and got[0]["key_business_processes"] == ["a", "b"]
    assert got[1] is None and got[2] is None


def test_sql_from_text(spark):
    cases = {
        "```sql\nSELECT a\nFROM t;\n```": "SELECT a FROM t",
        "Here:\nselect 1\n  from t\nwhere x; -- more\nand more": "select 1 from t where x; -- more",
        "SELECT 1;": "SELECT 1",
        "no query": "no query",
        "```\nSELECT 2\n```": "SELECT 2 ",
    }
    got = apply(spark, text.sql_from_text, list(cases))
    assert [g.strip() for g in got] == [c.strip() for c in cases.values()]


AUDIT = {
    "SELECT 1": (True, None),
    "select * from t": (True, None),
    "  \n SELECT 1": (True, None),
    "WITH x AS (SELECT 1) SELECT * FROM x": (False, None),
    "SELECT 1; DROP TABLE x": (False, "DROP"),
    "SELECT 'drop'": (True, None),
    "SELECT drop_date FROM t": (True, None),
    "DELETE FROM t": (False, "DELETE"),
    "SELECT (update) FROM t": (False, "UPDATE"),
}


def test_audit(spark):
    df = spark.createDataFrame([(q,) for q in AUDIT], "q string")
    assert {r[0]: (r[1], r[2]) for r in guarded.audit_queries(df, "q").collect()} == AUDIT


@pytest.mark.parametrize("query", AUDIT)
def test_guard_agrees_with_audit(query):
    if AUDIT[query][0]:
        assert guarded.check_read_only(query)
    else:
        with pytest.raises(guarded.UnsafeQuery):
            guarded.check_read_only(query)


def test_run_query(spark):
    spark.range(7).createOrReplaceTempView("seven")
    full = guarded.run_query(spark, "SELECT id FROM seven ORDER BY id", 7)
    assert full.row_count == 7 and not full.truncated and full.columns == ["id"]
    cut = guarded.run_query(spark, "SELECT id FROM seven ORDER BY id;", 6)
    assert cut.row_count == 6 and cut.truncated and cut.rows[0] == {"id": 0}
    assert tuple(guarded.query_outcome(spark, "SELECT id FROM seven", 6).first()) == (6, True)


def test_names_in_text(spark):
    cases = [
        '{"tables": {"users": {}, "bad name": {}, "orders_2": {}}}',
        "about table: users\nforeign table key x\n表格 orders.\nnothing here",
        '{"other": 1}',
        "表格 訂單",
    ]
    got = [sorted(x) for x in apply(spark, text.names_in_text, cases)]
    assert got == [["orders_2", "users"], ["about", "orders"], [], []]


def plain_chunks(body, size, overlap):
    lines, stride, out, start = body.split("\n"), size - overlap, [], 0
    while start == 0 or start + overlap < len(lines):
        out.append("\n".join(lines[start : start + size]).strip() or None)
        start += stride
    return out


def test_line_chunks(spark):
    rng = random.Random(4)
    bodies = ["", "\n\n\n", "one"] + [
        "\n".join(rng.choice(["", "x", " pad ", f"line {i}"]) for i in range(rng.randint(1, 60))) for _ in range(40)
    ]
    for size, overlap in ((10, 3), (5, 0), (7, 6), (1000, 200)):
        got = apply(spark, lambda c: text.line_chunks(c, size, overlap), bodies)
        assert got == [plain_chunks(b, size, overlap) for b in bodies]
    with pytest.raises(ValueError):
        text.line_chunks(F.col("x"), 5, 5)


def test_chunks_cover_all_lines(spark):
    body = "\n".join(f"line {i}" for i in range(95))
    got = apply(spark, lambda c: text.line_chunks(c, 20, 5), [body])[0]
    assert {line for chunk in got for line in chunk.split("\n")} == set(body.split("\n"))
    assert all(len(chunk.split("\n")) <= 20 for chunk in got)


def test_json_lines(spark):
    body = json.dumps({"a": 1, "b": {"c": "x", "d": [True, None]}, "e": []})
    got = apply(spark, jsontext.json_lines, [body, '"s"', "5"])
    assert got[0] == "a: 1\nb: c: x\nd: [0]: true\n[1]: <nil>\n\n\ne: \n"
    assert got[1:] == ["s", "5"]


def test_json_of_any_depth_and_odd_strings(spark):
    deep = "7"
    for _ in range(300):
        deep = '{"k": ' + deep + "}"
    bodies = [deep, '{"note":"[draft] text","k":1}', '{"x":"{curly","y":2.50}', "[broken", "", None, '[{"a":[]},"b"]']
    assert apply(spark, jsontext.json_lines, bodies) == [
        "k: " * 300 + "7" + "\n" * 300, "note: [draft] text\nk: 1\n", "x: {curly\ny: 2.50\n", "[broken", "", "<nil>",
        "[0]: a: \n\n[1]: b\n",
    ]
    outlined = apply(spark, jsontext.json_outline, bodies)
    assert outlined[0].endswith("  " * 300 + "7\n") and outlined[0].count("\n") == 301
    assert outlined[1:] == [
        "note:\n  [draft] text\nk:\n  1\n", "x:\n  {curly\ny:\n  2.50\n", "[broken\n", "\n", "<nil>\n",
        "[0]:\n  a:\n[1]:\n  b\n",
    ]


def test_line_chunks_of_long_texts_take_linear_time(spark):
    body = "\n".join(f"line {i}" for i in range(80_000))
    apply(spark, lambda c: text.line_chunks(c, 20, 5), [body[:1000]])
    started = time.time()
    got = apply(spark, lambda c: text.line_chunks(c, 20, 5), [body])[0]
    assert len(got) == 5333 and got[-1].endswith("line 79999") and time.time() - started < 10


def test_json_outline_and_header(spark):
    body = json.dumps({"a": 1, "b": {"c": "x"}, "l": [7]})
    assert apply(spark, jsontext.json_outline, [body])[0] == "a:\n  1\nb:\n  c:\n    x\nl:\n  [0]:\n    7\n"
    headed = apply(spark, lambda c: jsontext.findings_text("phase1", c, F.lit("now")), [body])[0]
    assert headed.startswith("Phase: phase1\nDescription: Database statistical analysis") and "\nTimestamp: now\n\na:" in headed


def test_collection_items(spark):
    cases = ["a, b,,c", "a;b", "x|y |", "one", "a;b,c", None]
    assert apply(spark, text.collection_items, cases) == [
        ["a", "b", "c"], ["a", "b"], ["x", "y"], ["one"], ["a;b", "c"], [],
    ]


def test_value_lists(spark):
    df = spark.createDataFrame(
        [(i, ["red", "", None, "blue", "red"][i % 5], "a,b" if i % 2 else "b") for i in range(20)],
        "id int, color string, tags string",
    ).coalesce(2)
    counts = {r["value"]: r["value_count"] for r in values.enum_values(df, "t", ["color"]).collect()}
    assert counts == {"red": 8, "blue": 4}
    options = values.value_options(df, "t", ["color", "id"], F.col("id"), examples=3).collect()
    by_value = {(r["column_name"], r["value"]): r for r in options}
    assert by_value[("color", "red")]["example_rank"] == 1 and by_value[("color", "blue")]["total_unique"] == 2
    assert by_value[("id", "2")]["example_rank"] == 3 and by_value[("id", "7")]["example_rank"] is None
    items = {r["item"]: r["item_count"] for r in values.collection_item_counts(df, "t", "tags").collect()}
    assert items == {"a": 10, "b": 20}
    examples = values.collection_examples(df, "tags", F.col("id"), 5).collect()
    assert [r["position"] for r in examples] == [0, 1, 2, 3, 4]
    child = values.collection_child_table(df, ["id"], "tags").collect()
    assert len(child) == 30 and (1, 1, "b") in [tuple(r) for r in child]


def test_masking(spark):
    df = spark.createDataFrame([("joe@x.org", "0912345678", "k", "Joe", 1)], "email string, phone string, api_key string, name string, n int")
    row = masking.mask_columns(df).first()
    assert row["email"] == "***@x.org" and row["phone"] == "******5678" and row["api_key"] == "***" and row["n"] == 1
    assert re.fullmatch("[0-9a-f]{64}", row["name"])


def test_categories(spark):
    names = ["order_items", "catalog", "UserLogins", "coupon_uses", "plain"]
    assert apply(spark, table_category, names) == [
        "Order Processing", "Audit & Logging", "User Management", "Promotions & Benefits", "General Business Data",
    ]
    kinds = apply(spark, lambda c: dimension_class(c, F.lit(None).cast("string")), ["dim_customer", "last_update", "city", "zzz", "sale"])
    assert kinds == ["people", "time", "location", "product", "event"]
    assert apply(spark, lambda c: dimension_class(F.lit("customer"), F.lit(""), c), ["event", "odd", None]) == ["event", "people", "people"]


def test_relations_and_summary(spark):
    texts = spark.createDataFrame([("訂單 屬於 顧客",), ("商品 分類 訂單",), ("訂單 顧客",)], "body string")
    found = {r[0] for r in business.keyword_pairs(texts, "body").collect()}
    assert found == {"顧客下訂單 (Customer places Orders)", "訂單包含商品 (Orders contain Products)", "商品屬於分類 (Products belong to Categories)"}
    tables = spark.createDataFrame([("b", "Second."), ("a", "x" * 300)], "table_name string, description string")
    lines = business.database_summary(tables, "db", "postgres").first()[0].split("\n")
    assert lines[0] == "Database: db (postgres)" and lines[1] == "Total Tables Analyzed: 2"
    assert lines[6] == "• a: " + "x" * 200 + "..." and lines[7] == "• b: Second." and lines[-2] == "• b"


def test_query_log_findings(spark):
    log = spark.createDataFrame(
        [("best sellers?", "SELECT 1", 3, None, "2024-01-01", "ok"), ("x", "", 0, "failed", "2024-01-02", None)],
        "query string, sql_query string, result_count int, error string, asked_at string, insights string",
    )
    found = [json.loads(r["body"]) for r in guarded.query_log_findings(log).collect()]
    assert [(f["has_error"], f["insights_generated"], f["result_count"]) for f in found] == [(False, True, 3), (True, False, 0)]
    assert found[0]["query"] == "best sellers?" and found[0]["phase"] == "marketing_query"


def test_json_with_half_surrogates_and_any_depth(spark):
    """Half of a pair is no character, in names and values; a body deeper than the parser goes is read all the same."""
    deep = '{"a":' * 30_000 + '["x", 1.50, null, {}]' + "}" * 30_000
    bodies = [
        '{"a":"\\ud800x","\\udfff":"\\ud83d\\ude00"}', deep, deep[:-1], deep + "]", deep.replace('"x"', '"\\q"'), deep.replace("1.50", "01"),
    ]
    lines = apply(spark, jsontext.json_lines, bodies)
    assert lines[0] == "a: \ufffdx\n\ufffd: \U0001f600\n"
    assert lines[1] == "a: " * 30_000 + "[0]: x\n[1]: 1.50\n[2]: <nil>\n[3]: \n" + "\n" * 30_000
    assert lines[2:] == bodies[2:]
    assert apply(spark, jsontext.json_outline, bodies[:1])[0] == "a:\n  \ufffdx\n\ufffd:\n  \U0001f600\n"
    for body in ('{"a": [1, {"b": "c,\\n"}], "d": -1.5E+3, "e": [[], {}, true, NaN]}', "[1,]", "{,}", '{"a" 1}', "[1 2]", "12.", "-", '"a"', ""):
        assert jsontext._parsed_deep(body) == jsontext._parsed(body), body
