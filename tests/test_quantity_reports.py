"""Quantity models on a dense hand-made panel, wide records, reports and chat history."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from stallboard.operators import quantity as Q
from stallboard.operators import views as V
from stallboard.plans import quantity as PQ
from stallboard.plans import reports as R


def _dense_lines(spark, days=150):
    """Two merchants, three items each, one line per item and day with a weekly pattern."""
    rng = np.random.default_rng(0)
    d0 = dt.datetime(2023, 6, 1, 12)
    orders, lines = [], []
    k = 0
    for m in ("A", "B"):
        for item in (1, 2, 3):
            for d in range(days):
                k += 1
                ts = d0 + dt.timedelta(days=d)
                q = int(3 + item + (2 if ts.weekday() >= 5 else 0) + rng.integers(0, 2))
                orders.append((f"o{k}", ts, 10.0, k % 17, m))
                lines.append((f"o{k}", item if m == "A" else item + 10, q))
    merchants = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "merchant_id string, merchant_name string")
    items = spark.createDataFrame([(i, n, 2.0) for i, n in [(1, "soup"), (2, "5-spice"), (3, "Café ☕"),
                                                           (11, "soup"), (12, "rice"), (13, "tea")]],
                                  "item_id int, item_name string, item_price double") \
        .withColumn("item_price", F.col("item_price").cast("decimal(10,2)"))
    od = spark.createDataFrame(orders, "order_id string, order_time timestamp_ntz, order_value double, eater_id bigint, merchant_id string") \
        .withColumn("order_value", F.col("order_value").cast("decimal(10,2)"))
    li = spark.createDataFrame(lines, "order_id string, item_id int, quantity int")
    li = li.withColumn("merchant_id", F.when(F.col("item_id") < 10, "A").otherwise("B"))
    return V.build_order_lines(li, od.drop("merchant_id"), items, merchants)


def test_quantity_forecast_shape(spark):
    lines = _dense_lines(spark)
    cutoff = "2023-10-15"
    f = PQ.quantity_forecast(lines, cutoff, horizon=30, max_iter=5).cache()
    assert f.count() == 30 * 6
    assert f.where("predicted_quantity < 0").count() == 0
    assert dict(f.dtypes)["predicted_quantity"] == "int"
    hs = sorted({r["h"] for r in f.select("h").collect()})
    assert hs == list(range(1, 31))
    first = f.where("h = 1").select("order_date").distinct().collect()
    assert [r[0] for r in first] == [dt.date(2023, 10, 16)]
    names = {r["safe_name"] for r in f.collect()}
    assert names == {"soup", "_5_spice", "Café", "rice", "tea"}
    wide = Q.wide_records(f).where("merchant_id = 'A'").orderBy("order_date").first()["predictions"]
    assert set(wide) == {"soup_pred", "_5_spice_pred", "Café_pred"}
    from stallboard.operators import aggregates as A
    tot = {(r["merchant_id"], r["safe_name"]): r["total_quantity"] for r in A.horizon_item_totals(f, 7).collect()}
    manual = f.where("h <= 7 AND merchant_id = 'B' AND safe_name = 'tea'").agg(F.sum("predicted_quantity")).first()[0]
    assert tot[("B", "tea")] == manual
    f.unpersist()


def test_notebook_models_dense_panel(spark):
    lines = _dense_lines(spark)
    for variant in ("lags", "rolling", "encoded"):
        res = PQ.notebook_model(lines, variant, max_iter=5).cache()
        n = res.count()
        assert n == 6 * 31                           # split day = max - 30 days, test includes it
        labels = {r[0] for r in res.select("label").distinct().collect()}
        assert labels <= {"As Expected", "Better Than Expected", "Worse Than Expected"}
        rm = PQ.holdout_rmse(res).collect()
        assert len(rm) == 2 and all(r["rmse"] < 3.0 for r in rm)
        res.unpersist()


def test_forecast_actual_totals(spark):
    from stallboard.operators import aggregates as A
    res = spark.createDataFrame([("A", 1, dt.date(2024, 1, 1), 2.004, 3), ("A", 1, dt.date(2024, 1, 1), 1.0, 1),
                                 ("A", 2, dt.date(2024, 1, 1), 0.125, 0)],
                                "merchant_id string, item_id int, order_date date, predicted_quantity double, daily_quantity_sold int")
    got = {r["item_id"]: (r["predicted_total"], r["actual_total"]) for r in A.forecast_actual_totals(res).collect()}
    assert got == {1: (3.0, 4.0), 2: (0.12, 0.0)}


def test_pivot_pred_actual(spark):
    res = spark.createDataFrame([("A", 1, dt.date(2024, 1, 1), 2.0, 3.0), ("A", 2, dt.date(2024, 1, 1), 5.0, 4.0)],
                                "merchant_id string, item_id int, forecast_date date, forecasted_quantity double, actual_quantity double")
    p = Q.pivot_pred_actual(res, [1, 2]).first().asDict()
    assert p["item_1_pred"] == 2.0 and p["item_2_actual"] == 4.0


def test_reports_and_chat(spark):
    sales = spark.createDataFrame([("A", "tea", 2, 6.0), ("A", "soup", 1, 2.5)],
                                  "merchant_id string, item_name string, total_quantity int, total_sales double")
    rep = R.item_report(sales).first()
    assert rep["report"] == "* soup: 1 units (Sales: $2.50)\n* tea: 2 units (Sales: $6.00)"
    conv = spark.createDataFrame([(1, 0, "user", "  hello  "), (1, 1, "assistant", "\n\t"), (1, 2, "bot", " ok "),
                                  (1, 3, "system", None), (2, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    flat = [(r["conv_id"], r["position"], r["role"], r["text"]) for r in R.chat_history(conv).orderBy("conv_id", "position").collect()]
    assert flat == [(1, 1, "user", "hello"), (1, 2, "model", "ok"), (2, 1, "user", "x")]
    nested = R.chat_history_nested(conv).where("conv_id = 1").first()["history"]
    assert [(m["role"], [p["text"] for p in m["parts"]]) for m in nested] == [("user", ["hello"]), ("model", ["ok"])]
    months = spark.createDataFrame([("A", f"2020-{m:02d}", 1000.5 * m) for m in range(1, 13)] * 1,
                                   "merchant_id string, month string, total_sales double")
    cp = R.chart_payload(months, 50).first()
    assert cp["payload_chars"] > 50 and cp["payload_cut"].endswith("... (data truncated)")


def test_json_records_and_sql_rows(spark):
    import json
    import os
    import tempfile
    from stallboard.sources import files
    df = spark.createDataFrame([("A", "2020-02", 2.5), ("A", "2020-01", 1.0), ("B", "2020-01", 3.0)],
                               "merchant_id string, month string, total_sales double")
    recs = {r["merchant_id"]: json.loads(r["records"]) for r in files.json_records_per_merchant(df, order=["month"]).collect()}
    assert recs["A"] == [{"month": "2020-01", "total_sales": 1.0}, {"month": "2020-02", "total_sales": 2.5}]
    out = os.path.join(tempfile.mkdtemp(prefix="stallboard-json-"), "rows")
    files.write_json_records(df, out)
    assert spark.read.json(out).count() == 3
    df.createOrReplaceTempView("monthly_for_test")
    got = [json.loads(r[0]) for r in R.sql_rows_json(
        spark, "SELECT month, total_sales FROM monthly_for_test WHERE merchant_id = :m ORDER BY month", {"m": "A"}).collect()]
    assert got == [{"month": "2020-01", "total_sales": 1.0}, {"month": "2020-02", "total_sales": 2.5}]


def test_dense_codes_match_sorted_classes(spark):
    import random
    rnd = random.Random(5)
    ids = [f"it{rnd.randint(0, 400):04d}" for _ in range(3000)] + [None]
    df = spark.createDataFrame([(i,) for i in ids], "item_id string").repartition(13)
    got = {r["item_id"]: r["item_id_encoded"] for r in Q.dense_codes(df, "item_id").collect()}
    classes = sorted({i for i in ids if i is not None})
    assert got == {c: k for k, c in enumerate(classes)}


def test_scoring_distinct_levels_equals_scoring_every_pair(spark):
    import random

    from pyspark.sql import functions as F

    from stallboard.functions import numeric as N
    from stallboard.operators import quantity as Q
    from stallboard.plans import quantity as PQ
    rng = random.Random(8)
    rows = [(m, i, f"item {i}", f"2024-01-{d:02}", rng.randint(1, 4)) for m in (1, 2, 3) for i in range(40) for d in rng.sample(range(1, 29), rng.randint(1, 3))]
    train = spark.createDataFrame(rows, "merchant_id long, item_id long, item_name string, order_date string, daily_quantity_sold long").withColumn("order_date", F.to_date("order_date"))
    model = PQ.fit_quantity_model(train, max_iter=3)
    got = Q.horizon_forecast(model, train, "2024-01-31", 30)
    grid = Q.add_calendar(Q.horizon_frame(train, "2024-01-31", 30, with_names=True))
    want = Q.predict(model, grid).select(*got.columns[:-1], N.nonneg_int("prediction").alias("predicted_quantity"))
    assert got.columns[-1] == "predicted_quantity" and got.count() == 3 * 40 * 30
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
