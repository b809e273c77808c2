"""Audits by key domain, checked SQL text, payload pieces and the pivot over all items."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from stallboard.operators import audits, ordering
from stallboard.operators import quantity as Q
from stallboard.plans import reports as R
from stallboard.plans import sql_gate


def test_one_exchange_answers_a_key_domain(spark):
    rng = random.Random(1)
    parents = [(rng.choice([None, *range(20)]),) for _ in range(60)]
    one, two = ([(rng.choice([None, 3, 3, 3, *range(30)]),) for _ in range(n)] for n in (200, 90))
    frames = {"p": spark.createDataFrame(parents, "k int"), "a": spark.createDataFrame(one, "f int"), "b": spark.createDataFrame(two, "g int")}
    domain = audits.Domain("p", "k", True, [("a", "f"), ("b", "g"), ("absent", "x")])
    found = audits.audit_domain(domain, frames)
    keys = [k for k, in parents if k is not None]
    want = {("unique p:k", len({k for k in keys if keys.count(k) > 1}), len(keys) - len(set(keys))),
            ("fk a.f->p.k", None, sum(k is not None and k not in keys for k, in one)),
            ("fk b.g->p.k", None, sum(k is not None and k not in keys for k, in two))}
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(key") == 1 and plan.count("Exchange SinglePartition") == 1
    empty = {t: df.where("false") for t, df in frames.items()}
    assert all(r.violations == 0 for r in audits.audit_domain(domain, empty).collect())


def test_a_load_is_checked_against_stored_keys(spark):
    stored = {"p": spark.createDataFrame([(1,), (2,)], "k int")}
    new = {"p": spark.createDataFrame([(2,), (3,), (3,)], "k int"), "a": spark.createDataFrame([(1,), (3,), (9,), (None,)], "f int")}
    got = {r.check: (r.duplicated_keys, r.violations) for r in audits.audit_domain(audits.Domain("p", "k", True, [("a", "f")]), new, stored).collect()}
    assert got == {"unique p:k": (2, 2), "fk a.f->p.k": (None, 1)}


def test_declared_domains():
    found = {(d.parent, d.column): (d.unique, sorted(d.children)) for d in audits.domains()}
    assert found[("merchants", "merchant_id")] == (True, [("items", "merchant_id"), ("transaction_data", "merchant_id")])
    assert found[("transaction_data", "order_id")] == (True, [("transaction_items", "order_id")])


@pytest.fixture
def views(spark):
    spark.range(10).withColumn("v", F.col("id") * 2).createOrReplaceTempView("sales")
    spark.range(3).createOrReplaceTempView("shops")
    spark.range(3).createOrReplaceTempView("secret")
    return ["sales", "shops"]


@pytest.mark.parametrize("text", [
    "SELECT * FROM sales", "SELECT s.id, SUM(v) AS t FROM sales s JOIN shops USING (id) WHERE v > :low GROUP BY s.id HAVING SUM(v) > 1 ORDER BY t LIMIT 2 OFFSET 0",
    "WITH a AS (SELECT id FROM shops), b AS (SELECT * FROM a) SELECT * FROM sales WHERE id IN (SELECT id FROM b) AND EXISTS (SELECT 1 FROM shops)",
    "SELECT id FROM sales UNION ALL SELECT id FROM shops EXCEPT SELECT 3", "SELECT (SELECT MAX(id) FROM shops) AS m, ROW_NUMBER() OVER (ORDER BY id) AS r FROM sales",
    "SELECT id, x FROM sales LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT * FROM SALES", "SELECT 1 AS one",
    "SELECT * FROM (VALUES (1), (2)) AS t(a)", "SELECT DISTINCT v FROM sales WINDOW w AS (ORDER BY id)",
])
def test_queries_are_let_through(spark, views, text):
    rows = sql_gate.rows_json(spark, text, views, {"low": 0} if ":low" in text else None).collect()
    assert rows and all(isinstance(json.loads(r.row_json), dict) for r in rows)


@pytest.mark.parametrize("text", [
    "DROP VIEW sales", "CREATE TABLE t AS SELECT 1", "INSERT INTO sales VALUES (1, 2)", "SET spark.sql.shuffle.partitions=1", "SHOW TABLES", "DESCRIBE sales",
    "SELECT * FROM secret", "SELECT * FROM sales WHERE id IN (SELECT id FROM secret)", "SELECT (SELECT MAX(id) FROM secret)", "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM default.sales", "SELECT * FROM range(5)",
    "SELECT java_method('java.lang.System', 'getenv', 'PATH') FROM sales", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT input_file_name() FROM sales",
    "SELECT CASE WHEN id > 1 THEN concat('a', try_reflect('java.lang.System', 'getenv', 'PATH')) END FROM sales", "EXPLAIN SELECT * FROM sales", "CACHE TABLE sales",
    "SELECT * FROM sales WHERE id = (SELECT MIN(id) FROM (SELECT * FROM json.`/tmp/x`))", "not sql", "", "SELECT 1; DROP VIEW sales", "ADD JAR '/tmp/x.jar'",
    "INSERT OVERWRITE DIRECTORY '/tmp/out' USING parquet SELECT * FROM sales", "REFRESH TABLE sales", "FROM secret SELECT *", "TABLE secret",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM sales",
])
def test_other_texts_are_refused(spark, views, text):
    with pytest.raises(sql_gate.RefusedQuery):
        sql_gate.run_query(spark, text, views)
    assert spark.table("sales").count() == 10


def test_pieces_join_to_the_indented_text(spark):
    rng = random.Random(2)
    rows = [(m, k, rng.choice(["Soup", 'with "quotes"', "back\\slash", "tab\there", "日本語", None, "line\nbreak", "x" * 300]), rng.choice([None, 1, -7]), rng.random() > 0.5)
            for m, n in ((1, 400), (2, 1), (3, 37), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "merchant_id int, id int, name string, n int, f boolean").where("merchant_id IS NOT NULL")
    for limit in (4000, 50):
        got = R.payload_pieces(df, ["name", "n", "f"], ["id"], limit).collect()
        for m in (1, 2, 3):
            own = sorted((r for r in got if r.merchant_id == m), key=lambda r: r.piece)
            want = json.dumps([{"name": r[2], "n": r[3], "f": r[4]} for r in rows if r[0] == m], indent=2, ensure_ascii=False)
            assert "".join(r.text for r in own) == want and [r.piece for r in own] == list(range(1, len(own) + 1))
            assert all(len(r.text) == limit for r in own[:-1]) and {r.payload_chars for r in own} == {len(want)}
            assert own[0].prompt_text == (want[:limit] + "\n... (data truncated)" if len(want) > limit else want)
            assert all(r.prompt_text is None for r in own[1:])
    assert R.payload_pieces(df.where("false"), ["name"], ["id"]).collect() == []


def test_running_total(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randint(0, 9)) for k in range(500)]
    got = ordering.running_total(spark.createDataFrame(rows, "g int, k int, v int"), ["g"], ["k"], "v", "before").collect()
    assert all(r.before == sum(v for g, k, v in rows if g == r.g and k < r.k) for r in got) and len(got) == 500


def test_pivot_keeps_every_item(spark):
    rng = random.Random(4)
    rows = [(m, rng.randrange(1, 900), dt.date(2024, 1, 1 + d), float(d), rng.choice([None, 2.0])) for m in (1, 2) for d in range(5) for _ in range(60 * m)]
    rows = list({r[:3]: r for r in rows}.values()) + [(3, 5, dt.date(2024, 1, 1), 1.0, None)]
    df = spark.createDataFrame(rows, "merchant_id int, item_id int, forecast_date date, forecasted_quantity double, actual_quantity double")
    got = Q.pivot_all_items(df, width=50).collect()
    cells = {(r.merchant_id, i, r.forecast_date): (p, a) for r in got for i, p, a in zip(r["items"], r.predicted, r.actual)}
    items = {m: sorted({r[1] for r in rows if r[0] == m}) for m in (1, 2, 3)}
    days = {m: {r[2] for r in rows if r[0] == m} for m in (1, 2, 3)}
    have = {r[:3]: r[3:] for r in rows}
    assert cells == {(m, i, d): have.get((m, i, d), (None, None)) for m in items for i in items[m] for d in days[m]}
    for m in items:
        first = [r for r in got if r.merchant_id == m and r.forecast_date == min(days[m])]
        assert [i for r in sorted(first, key=lambda r: r.chunk) for i in r["items"]] == items[m] and all(len(r["items"]) <= 50 for r in first)
    # as the pivot with a given list
    plain = Q.pivot_pred_actual(df, items[1]).where("merchant_id = 1").collect()
    assert all(cells[1, i, r.forecast_date] == (r[f"item_{i}_pred"], r[f"item_{i}_actual"]) for r in plain for i in items[1])
