"""Steps whose tasks must stay the same size as the tables grow."""

import datetime as dt

from pyspark.sql import functions as F

from stallboard.operators import aggregates as A
from stallboard.operators import views as V

LINE = "order_id long, merchant_id long, item_id long, quantity int"


def test_lines_are_dealt_by_order_in_proportion(spark):
    lines = spark.createDataFrame([(None if k % 50 == 0 else k // 3, k % 4, k % 5, k % 7) for k in range(600)], LINE)
    assert V.dealt_by_order(lines, 600) is lines
    dealt = V.dealt_by_order(lines, 10)
    assert dealt.rdd.getNumPartitions() == 60 and sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, lines.collect()), key=str)
    assert V.dealt_by_order(lines, 590).rdd.getNumPartitions() == 8  # the configured ones at least

    orders = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), k + 0.5) for k in range(200)],
                                   "order_id long, order_time timestamp_ntz, order_value double").withColumn("order_value", F.col("order_value").cast("decimal(10,2)")).withColumn("eater_id", F.lit(1))
    items = spark.createDataFrame([(k, f"i{k}", 2.5) for k in range(5)], "item_id long, item_name string, item_price double").withColumn("item_price", F.col("item_price").cast("decimal(10,2)"))
    merchants = spark.createDataFrame([(k, f"m{k}") for k in range(4)], "merchant_id long, merchant_name string")
    plain, many = (V.build_order_lines(x, orders, items, merchants) for x in (lines, dealt))
    for report in (A.monthly_sales, A.daily_summary):
        assert sorted(map(tuple, report(plain).collect())) == sorted(map(tuple, report(many).collect()))
    # orders too large to be broadcast: the dealt lines meet them and are made distinct without another shuffle of lines
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = V.build_order_lines(dealt, orders, items.hint("broadcast"), merchants.hint("broadcast"))
        text = A.monthly_sales(plan)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("REPARTITION_BY_NUM") == 1 and text.count("hashpartitioning(order_id") == 2, text


def test_adf_makes_no_rows_of_lag_columns(spark):
    import numpy as np

    from stallboard.operators import stats as ST
    rng = np.random.default_rng(4)
    rows = [(m, k, float(v)) for m in (1, 2, None) for k, v in enumerate(rng.normal(0, 1, 60).cumsum())]
    rows += [(3, k, None if k % 9 == 4 else float(v)) for k, v in enumerate(rng.normal(5, 1, 50))] + [(4, k, None) for k in range(20)]
    got = ST.adf(spark.createDataFrame(rows, "merchant_id long, order_date int, y double"), "y")
    # the lag columns of every day would be ten times the series, stored and read twice
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    found = {r.merchant_id: r for r in got.collect()}
    assert sorted(found) == [1, 2, 3, 4] and found[4].adf_stat is None  # no series without a key
    y = np.array([v for m, _, v in rows if m == 3], dtype=object)
    lag = found[3].used_lag
    assert found[3].nobs == 50 - lag - 1
    known = np.array([v is not None for v in y])
    level = np.where(known, np.where(known, y, 0.0) - np.mean([v for v in y if v is not None]), 0.0).astype(float)
    step = np.array([0.0] + [y[t] - y[t - 1] if known[t] and known[t - 1] else 0.0 for t in range(1, 50)])
    x = np.array([[1.0, level[t - 1], *(step[t - k] for k in range(1, lag + 1))] for t in range(lag + 1, 50)])
    d = step[lag + 1:]
    beta = np.linalg.lstsq(x, d, rcond=None)[0]
    spread = np.sum((d - x @ beta) ** 2) / (len(d) - lag - 2) * np.linalg.inv(x.T @ x)[1, 1]
    assert abs(found[3].adf_stat - beta[1] / np.sqrt(spread)) < 1e-6


def test_postings_grow_with_the_texts_not_with_the_rows(spark, tmp_path):
    from stallboard.operators import filters as C
    from stallboard.stores.postings import Postings
    names = ["Almond blue", "gold leaf", None, "x", "GOLD", "gold"]
    df = spark.createDataFrame([(k % 400, names[k % 6], k % 30) for k in range(600)], "id int, name string, n int")
    stored = Postings(spark, str(tmp_path / "p"), ["id"], ["name", "n"]).write(df)
    assert stored.texts().count() == 34  # 4 names without regard to case, 30 numbers
    assert stored._table("postings").count() == 9 + 7 + 2
    for q in ("gold", "GOLD ", "d b", "x", "29", "zzz"):
        assert sorted(map(tuple, stored.search(q).collect()), key=str) == sorted(map(tuple, C.search_all_columns(df, q, ["name", "n"]).collect()), key=str), q
    plan = stored.search("gold")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_rows_without_key_are_found_by_short_queries_only(spark, tmp_path):
    from stallboard.stores.postings import Postings
    df = spark.createDataFrame([(1, "gold"), (None, "gold"), (1, "gold")], "id int, name string")
    stored = Postings(spark, str(tmp_path / "p"), ["id"], ["name"]).write(df)
    assert [len(stored.search(q).collect()) for q in ("go", "gold")] == [3, 2]
