"""Forecasts with a row per item give what their long form gives, and become days only after every shuffle."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stallboard.operators import aggregates as A
from stallboard.operators import quantity as Q
from stallboard.plans import naive as NV

CUTOFF = "2024-01-31"


def _panel(spark, items=30):
    rng = random.Random(8)
    rows = [(m, i, f"item {i % 7}", dt.date(2024, 1, d), rng.randint(1, 9)) for m in (1, 2) for i in range(items) for d in rng.sample(range(1, 29), rng.randint(1, 9))]
    return spark.createDataFrame(rows, "merchant_id long, item_id long, item_name string, order_date date, daily_quantity_sold long")


def _sold(spark):
    rows = [(1, dt.date(2024, 2, 3), 4, 2), (1, dt.date(2024, 2, 4), 4, None), (2, dt.date(2024, 3, 1), 5, 7), (2, dt.date(2024, 3, 2), 5, 9),
            (2, dt.date(2024, 1, 31), 5, 1), (1, dt.date(2024, 2, 3), 999, 5)]
    return spark.createDataFrame(rows, "merchant_id long, order_date date, item_id long, daily_quantity_sold long")


def _long(spark):
    return NV.weekday_mean_forecast(_panel(spark), CUTOFF)


def test_actuals_meet_items_before_the_days(spark):
    for how in ("left", "inner"):
        got = NV.with_actuals(NV.weekday_items(_panel(spark)), _sold(spark), CUTOFF, how=how)
        want = _long(spark).join(_sold(spark), ["merchant_id", "order_date", "item_id"], how)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")]


def test_records_are_added_up_before_the_days(spark):
    forecast = NV.weekday_quantities(NV.weekday_items(_panel(spark)), CUTOFF)
    got, want = Q.long_records(forecast), Q.long_records(_long(spark))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2 * 7 * 30
    assert sorted(map(tuple, A.horizon_item_totals(forecast, 7).collect())) == sorted(map(tuple, A.horizon_item_totals(_long(spark), 7).collect()))
    short = NV.weekday_quantities(NV.weekday_items(_panel(spark)), CUTOFF, 5)
    assert Q.long_records(short).count() == 2 * 7 * 5


def test_pivot_of_item_days(spark):
    items = NV.weekday_items(_panel(spark))
    pairs = NV.with_actuals(items, _sold(spark), CUTOFF)
    got = NV.pivot_all_items(items, _sold(spark), CUTOFF, width=8)
    want = Q.pivot_all_items(NV.results(pairs), width=8)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_pivot_has_the_days_of_merchants_without_a_listed_item(spark):
    items = NV.weekday_items(_panel(spark))
    days = Q.fan_out(items.select("merchant_id").distinct(), CUTOFF, 30).select("merchant_id", F.col("order_date").alias("forecast_date"))
    listed = NV.with_actuals(items.where("item_id = 4 AND merchant_id = 1"), _sold(spark), CUTOFF)
    got = Q.pivot_pred_actual(NV.results(listed), [4], days).collect()
    assert len(got) == 60 and sum(r.item_4_pred is not None for r in got) == 30
    assert [r.item_4_actual for r in got if r.merchant_id == 1 and r.forecast_date == dt.date(2024, 2, 3)] == [2.0]


def test_binned_levels_train_the_same_trees_from_fewer_rows(spark, monkeypatch):
    from stallboard.plans import quantity as PQ
    panel = Q.add_calendar(Q.add_levels(_panel(spark))).localCheckpoint()
    rows = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: rows.append(df) or cut(df))
    plain, binned = (Q.fit(panel, PQ.API_FEATURES, "daily_quantity_sold", 0.3, 3, binned=b) for b in ((), Q.LEVELS))
    keys = ["merchant_id", "item_id", "order_date"]
    a, b = ({tuple(r[:3]): r[3] for r in Q.predict(m, panel).select(*keys, "prediction").collect()} for m in (plain, binned))
    assert len(a) == panel.count() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert rows[-1].count() < rows[0].count() == panel.count()
    splits = Q.level_splits(spark.createDataFrame([(float(k % 10), None) for k in range(50)], "a double, b double"), ["a", "b"])
    assert splits == {"a": [k + 0.5 for k in range(9)], "b": []}
