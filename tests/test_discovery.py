"""Structure found in values alone, against brute force over small tables."""

import collections
import datetime as dt
import hashlib
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulight.operators import footers, heavy, inclusion, keys, pages, star, stored_profiles, unique_sets
from tabulight.sources import knowledge
from tabulight.sources.catalog import Catalog, TableKeys, column_descriptors, declared_constraints


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


PAIR = ("child_table", "child_column", "parent_table", "parent_column")


@pytest.fixture(scope="module")
def shop(spark):
    """Orders name their customer ``buyer`` and hold it as a decimal; a third of all orders are of one customer."""
    customers = spark.createDataFrame([(i, f"c{i}") for i in range(40)], "id int, label string")
    orders = spark.createDataFrame(
        [(100 + i, Decimal(7 if i % 3 == 0 else i % 25), f"c{i % 11}" if i % 5 else None, float(i) / 4) for i in range(120)],
        "number bigint, buyer decimal(12,2), note string, price double",
    )
    days = spark.createDataFrame(
        [(dt.date(2024, 1, 1 + i), dt.datetime(2024, 1, 1 + i), None) for i in range(9)], "day date, at timestamp_ntz, nothing int"
    )
    return Catalog({"customers": customers, "orders": orders, "days": days})


def test_a_renamed_reference_is_found(shop):
    found = rows_of(inclusion.inclusion_dependencies(shop), *PAIR)
    assert ("orders", "buyer", "customers", "id") in found  # another name, another number type
    assert ("orders", "note", "customers", "label") in found
    assert ("days", "day", "days", "at") in found and ("days", "at", "days", "day") in found
    assert not any("nothing" in pair for pair in found)  # a column without values refers to nothing
    assert ("customers", "id", "orders", "buyer") not in found
    best = {(r["child_table"], r["child_column"]): r for r in inclusion.value_references(shop).collect()}
    assert best["orders", "buyer"]["parent_table"] == "customers" and best["orders", "buyer"]["coverage"] == 0.625
    assert best["orders", "note"]["parent_column"] == "label"


def test_inclusions_of_many_columns_equal_brute_force(spark):
    """More columns than bits in a word, of mixed number types, with nulls, NaN and signed zeros."""
    rng = random.Random(5)
    kinds = ["int", "bigint", "double", "string", "float"]
    fields = [(f"c{i}", kinds[i % 5]) for i in range(70)]

    def value(i, kind):
        x = rng.choice([None, *range(-1, 1 + i % 7)])
        if x is None or kind in ("int", "bigint"):
            return x
        if kind == "string":
            return f"{'long ' * 20 if i % 2 else ''}{x}"
        return rng.choice([float(x), x + 0.5, -0.0, float("nan") if i % 3 == 0 else 0.0])

    rows = [tuple(value(i, k) for i, (_, k) in enumerate(fields)) for _ in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in fields))
    values = {}
    for i, (name, kind) in enumerate(fields):
        values[name] = {
            ("text", r[i]) if kind == "string" else "nan" if r[i] != r[i] else float(r[i]) for r in rows if r[i] is not None
        }
    expected = {
        (a, b) for a, b in itertools.permutations(values, 2) if values[a] and values[a] <= values[b]
    }
    found = inclusion.inclusion_dependencies(Catalog({"t": df}))
    assert rows_of(found, "child_column", "parent_column") == expected
    sizes = {(r["child_column"], r["child_distinct"]) for r in found.collect()}
    assert sizes <= {(n, len(v)) for n, v in values.items()}


def brute_keys(rows, names, largest):
    keys = []
    for size in range(1, largest + 1):
        for places in itertools.combinations(range(len(names)), size):
            parts = [tuple(r[i] for i in places) for r in rows]
            if any(set(k) <= set(places) for k in keys) or any(None in p for p in parts):
                continue
            if len(set(parts)) == len(parts):
                keys.append(places)
    return {",".join(names[i] for i in k) for k in keys}


@pytest.mark.parametrize("seed", range(3))
def test_minimal_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f"]
    rows = list({tuple(rng.randrange(n) for n in (4, 5, 3, 4, 6)) for _ in range(60)})
    rows = [(*r[:4], f"v{r[4]}" if seed else f"v{i}", None if i == 3 else i) for i, r in enumerate(rows)]
    twice = spark.createDataFrame([*rows, rows[0]], "a int, b int, c int, d bigint, e string, f int")
    once = spark.createDataFrame(rows, "a int, b int, c int, d bigint, e string, f int")
    none = once.limit(0)
    found = unique_sets.unique_column_sets(Catalog({"once": once, "twice": twice, "none": none}), largest=4)
    got = found.collect()
    assert {r["key_columns"] for r in got if r["table_name"] == "once"} == brute_keys(rows, names, 4)
    assert {r["key_columns"] for r in got if r["table_name"] != "once"} == set()
    assert all(r["set_size"] == len(r["key_columns"].split(",")) and r["row_count"] == len(rows) for r in got)


def test_repeats_in_a_share_of_a_large_table_spare_its_values(spark, monkeypatch):
    """A set that is unique but for one row in forty is counted over a share only; the key among the others is found."""
    odd = "CASE WHEN id % 40 = 1 THEN 0 ELSE CAST(id % 4 AS INT) END"
    large = spark.range(1 << 19).selectExpr("id DIV 4 AS a", f"{odd} AS b", "concat('v', id % 4) AS c")
    counted = []

    def key_checks(catalog, wanted):
        counted.append(wanted)
        return keys.key_checks(catalog, wanted)

    monkeypatch.setattr(unique_sets, "key_checks", key_checks)
    found = unique_sets.unique_column_sets(Catalog({"large": large}), largest=2).collect()
    assert [(r["key_columns"], r["row_count"]) for r in found] == [("a,c", 1 << 19)]
    assert counted == [{"large": [("a", "c")]}]


def test_keys_of_several_texts_stay_apart(spark):
    rows = [("1,2", "3", 1.0), ("1", "2,3", 1.0), ("1:1", "", 1.0), ("", "1:1", 1.0), ("x" * 70, "y", 1.0), ("x" * 70 + "y", "", 1.0)]
    df = spark.createDataFrame([*rows, *rows[:2]], "a string, b string, d double")
    row = keys.key_check(df, "t", ["a", "b", "d"]).first()
    assert (row["distinct_count"], row["null_count"], row["is_key"]) == (6, 0, False)


def test_heavy_values_equal_counting(spark):
    """Many rare values beside a few heavy ones, long texts, blanks, nulls, in tables of several files."""
    rng = random.Random(8)
    long = "x" * 80
    rows = [
        (rng.choice([1, 1, 1, 2, i]), rng.choice(["a", long, "", None, f"v{i}", f"w{i}"]), i, None) for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "n int, s string, id bigint, empty string").repartition(7)
    found = {
        (r["column_name"], r["value"], r["value_count"], r["filled_count"], r["is_digest"])
        for r in heavy.heavy_values(Catalog({"t": df}), one_in=20).collect()
    }
    expected = set()
    for at, name in enumerate(["n", "s", "id", "empty"]):
        filled = [r[at] for r in rows if r[at] not in (None, "")]
        for value, count in collections.Counter(filled).items():
            if count * 20 >= len(filled):
                digest = isinstance(value, str) and len(value) >= 64
                expected.add((name, hashlib.sha256(value.encode()).hexdigest() if digest else str(value), count, len(filled), digest))
    assert found == expected and len(found) == 4


def test_profiles_are_merged_and_only_new_files_read(spark, tmp_path):
    rng = random.Random(2)
    values = [(rng.choice([None, rng.gauss(0, 10)]), f"k{rng.randrange(3000)}") for _ in range(9000)]
    path, store = f"file://{tmp_path}/t", f"file://{tmp_path}/store"

    def write(part, mode):
        spark.createDataFrame(part, "x double, k string").coalesce(2).write.mode(mode).parquet(path)

    def lake():
        return Catalog({"t": spark.read.schema("x double, k string").parquet(path)})

    write(values[:4000], "overwrite")
    assert stored_profiles.refresh(spark, lake(), store) == 2
    assert stored_profiles.refresh(spark, lake(), store) == 0
    write(values[4000:], "append")
    assert stored_profiles.refresh(spark, lake(), store) == 2
    x, k = (r for r in stored_profiles.merged_profile(spark, lake(), store).orderBy("ordinal").collect())
    known = sorted(v for v, _ in values if v is not None)
    assert (x["row_count"], x["null_count"], x["min_number"], x["max_number"]) == (9000, 9000 - len(known), known[0], known[-1])
    assert abs(x["avg_number"] - sum(known) / len(known)) < 1e-9
    for share, found in zip((0.25, 0.5, 0.75), x["quartiles"], strict=True):
        assert abs(sum(v <= found for v in known) / len(known) - share) < 0.02
    assert abs(x["distinct_count"] - len(known)) < 0.08 * len(known)
    assert k["distinct_count"] == len({s for _, s in values}) and k["quartiles"] is None
    write(values[:100], "overwrite")  # all files are other ones now
    stored_profiles.refresh(spark, lake(), store)
    assert {r["row_count"] for r in stored_profiles.merged_profile(spark, lake(), store).collect()} == {100}


def test_rules_come_before_declared_keys_and_those_before_found_ones(spark):
    shape = "code string, number int, at timestamp, name string, body string, price double"
    tables = {t: spark.createDataFrame([], shape) for t in ("plain", "declared", "broken", "ruled", "texts")}
    lake = Catalog(tables, {t: TableKeys(("code",)) for t in ("declared", "broken", "ruled")})
    columns, declared = column_descriptors(spark, lake), declared_constraints(spark, lake)
    found = [(t, c) for t in tables for c in ("code", "number", "at")]
    found = [k for k in found if k != ("broken", "code") and not (k[0] == "texts" and k[1] != "code")]
    keys = spark.createDataFrame(found, "table_name string, key_columns string")
    rules = spark.createDataFrame(
        [
            (2, "^ruled$", "^(name|code)$", "key"), (1, "^ruled$", "^name$", "attribute"), (3, "^ruled$", "^body$", "ignore"),
            (4, "^ruled$", ".", "class:time"), (5, "^pl", "^price$", "attribute"), (6, "^pl", "^number$", "ignore"),
        ],
        "priority int, table_pattern string, column_pattern string, role string",
    )
    plain = {r["source_table"]: r for r in star.detect_dimensions(columns, keys, declared).collect()}
    assert {t: r["key_fields"] for t, r in plain.items()} == {"plain": ["number"], "declared": ["code"], "broken": ["number"], "ruled": ["code"]}
    ruled = {r["source_table"]: r for r in star.detect_dimensions(columns, keys, declared, rules).collect()}
    assert ruled["ruled"]["key_fields"] == ["code"] and ruled["ruled"]["attributes"] == ["name"]
    assert ruled["ruled"]["dimension_class"] == "time"
    assert ruled["plain"]["key_fields"] == ["at"] and ruled["plain"]["attributes"] == ["body", "code", "name", "price"]
    with pytest.raises(ValueError, match="unknown roles: kee"):
        star.column_roles(columns, rules.limit(1).withColumn("role", F.lit("kee")))
    references = spark.createDataFrame(
        [("ruled", "number", "a", "id"), ("ruled", "code", "b", "id")],
        "child_table string, child_column string, parent_table string, parent_column string",
    )
    more = rules.limit(0).unionByName(spark.createDataFrame([(1, "^ruled$", "^(number|name)$", "measure")], rules.schema))
    (fact,) = star.detect_facts(columns, keys, references, more).collect()
    assert fact["measures"] == ["name", "number", "price"]  # a rule's measures stay even if they refer to something


@pytest.mark.parametrize("recent,tiebreak", [(("b", "a"), ("c", "id")), ((), ("c", "id")), (("c",), ())])
def test_deep_pages_equal_a_full_sort(spark, recent, tiebreak):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice([None, *range(9)]), rng.choice([None, "x", "y", "é"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c string").repartition(3)
    top = (lambda r: r[2] if r[2] is not None else r[1]) if "b" in recent else (lambda r: r[3])
    low = lambda v: (v is not None, v if v is not None else 0)
    ordered = sorted(rows, key=lambda r: [low(r[3]), low(r[0])] if tiebreak else [])
    if recent:
        known = sorted({top(r) for r in rows} - {None}, reverse=True)
        ordered = sorted(ordered, key=lambda r: -1 if top(r) is None else known.index(top(r)))
    for offset in (0, 37, 199, 390, 399, 400, 1000):
        page = [tuple(r) for r in pages.deep_page(df, 25, offset, recent, tiebreak).collect()]
        assert all(r[4] == 400 for r in page)
        want = ordered[offset : offset + 25]
        if tiebreak:
            assert [r[:4] for r in page] == want
        else:  # equal rows come in any order
            assert [top(r) for r in page] == [top(r) for r in want]


def test_footers_answer_without_reading_pages(spark, tmp_path):
    rows = [(i, None if i % 4 else i, f"s{i}", dt.date(1970, 1, 1 + i % 9), [i]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, n int, s string, d date, parts array<int>")
    df.repartition(4).write.parquet(f"{tmp_path}/t")
    df.limit(0).write.parquet(f"{tmp_path}/none")
    found = footers.footer_stats(spark, {t: (f"file://{tmp_path}/{t}", df.schema) for t in ("t", "none")})
    got = {(r["table_name"], r["column_name"]): tuple(r)[3:] for r in found.collect()}
    assert got == {
        ("t", "id"): (50, 0, 0, 49), ("t", "n"): (50, 37, 0, 48), ("t", "s"): (50, 0, None, None), ("t", "d"): (50, 0, 0, 8),
        **{("none", c): (0, 0, None, None) for c in ("id", "n", "s", "d")},
    }
    session = footers.footer_session(spark)
    scan = session.read.schema(df.schema).parquet(f"file://{tmp_path}/t").selectExpr("count(*)", "min(id)")
    assert "PushedAggregation" in scan._jdf.queryExecution().executedPlan().toString()


def test_new_chunks_move_no_known_content(spark, tmp_path):
    """The digests of the store and of the candidates are compared; contents are shuffled after that, of new chunks alone."""
    rows = [("p", f"s{i % 5}", i % 7, f"text {i % 11}", "k", None) for i in range(60)]
    shape = "phase string, source string, chunk_no int, content string, kind string, table_name string"
    candidates = knowledge.hashed(spark.createDataFrame(rows, shape))
    stored = knowledge.hashed(spark.createDataFrame(rows[:4], shape)).select("content_hash")
    fresh = knowledge.new_chunks(candidates, stored)
    got = {r["content"]: (r["phase"], r["source"], r["chunk_no"]) for r in fresh.collect()}
    known = {r[3] for r in rows[:4]}
    assert got == {c: min(r[:3] for r in rows if r[3] == c) for c in {r[3] for r in rows} - known}
    assert fresh.count() == len(got) and fresh.columns == candidates.columns
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning(content_hash") <= 1
