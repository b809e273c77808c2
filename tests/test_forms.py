"""Merchants and items that must not get lost, and the plans of the registered forms."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from stallboard.operators import arima as AR
from stallboard.operators import cleaning as B
from stallboard.operators import ordering as G
from stallboard.operators import quantity as Q
from stallboard.operators import stats as ST
from stallboard.operators import views as V
from stallboard.operators import windows as W
from stallboard.plans import forecasts as PF
from stallboard.plans import sales as PS
from tests.conftest import SF_SMALL

D0 = dt.date(2022, 1, 3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd_merchants(spark):
    """25 days, 45 days, 75 days, a constant series and a normal one."""
    rng = np.random.default_rng(3)
    data = {"days25": 25, "days45": 45, "days75": 75, "normal": 200}
    rows = [(m, D0 + dt.timedelta(days=t), 100.0 + 5 * (t % 7) + float(rng.normal())) for m, n in data.items() for t in range(n)]
    rows += [("constant", D0 + dt.timedelta(days=t), 50.0) for t in range(200)]
    return spark.createDataFrame(rows, "merchant_id string, order_date date, total_revenue double")


MERCHANTS = {"days25", "days45", "days75", "normal", "constant"}


def test_every_merchant_has_a_forecast_row(odd_merchants):
    fits, rows, series = PF.revenue_forecast(odd_merchants, residuals=True)
    got = rows.collect()
    by = {m: [r for r in got if r["merchant_id"] == m] for m in MERCHANTS}
    assert all(by.values())
    assert [(r["method"], r["h"], r["forecasted_revenue"]) for r in by["days25"]] == [("too_short", None, None)]
    assert {r["method"] for r in by["days75"]} == {"css"} and {r["method"] for r in by["normal"]} == {"css"}
    assert all(len(by[m]) == 30 and all(r["forecasted_revenue"] is not None for r in by[m]) for m in MERCHANTS - {"days25"})
    assert all(r["forecasted_revenue"] == 50.0 for r in by["constant"])
    diagnostics = {r["merchant_id"]: r for r in PF.residual_diagnostics(fits).collect()}
    assert set(diagnostics) == MERCHANTS and diagnostics["normal"]["lb_stat"] is not None and diagnostics["days25"]["lb_stat"] is None
    assert all(r["resid"] is None for r in AR.fit_forecast(series, [AR.ARIMA_111], 5).collect())


def test_every_merchant_is_in_the_grid(odd_merchants):
    got = PF.grid_search(odd_merchants).collect()
    assert {r["merchant_id"] for r in got} == MERCHANTS
    for m in MERCHANTS:
        assert sorted(r["rank"] for r in got if r["merchant_id"] == m) == list(range(1, 1 + sum(r["merchant_id"] == m for r in got)))
    assert {r["method"] for r in got if r["merchant_id"] == "days25"} == {"too_short"}


def test_parameters_are_not_clipped(spark):
    """A nearly explosive AR coefficient is found where it is, and the fit says whether it converged."""
    rng = np.random.default_rng(1)
    w = np.zeros(1500)
    for t in range(1, 1500):
        w[t] = 0.995 * w[t - 1] + rng.normal()
    y = 1000 + np.cumsum(w)
    rows = [("m", D0 + dt.timedelta(days=t), float(v)) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "merchant_id string, order_date date, total_revenue double")
    fit = AR.fit_forecast(AR.index_series(df, "total_revenue"), [AR.Order(1, 1, 0)], 5).first()
    assert 0.985 < fit["params"][0] < 1.005 and fit["converged"] is True


def test_filter_branches_agree():
    rng = np.random.default_rng(2)
    v = rng.normal(size=400)
    for b in ([(1, 0.5)], [(1, -0.4), (7, 0.6), (8, -0.24)], [(1, 0.9), (2, 0.2), (3, -0.1)]):
        assert np.allclose(AR._ma_filter(v, b), AR._ma_filter_direct(v, b), atol=1e-8)


def test_regressors_are_not_invented(spark):
    """With regressors the forecast ends where they end."""
    rows = [("m", D0 + dt.timedelta(days=t), 100.0 + t % 5 + (t * 7919 % 13) / 9, t % 3) for t in range(150)]
    df = spark.createDataFrame(rows, "merchant_id string, order_date date, total_revenue double, x int")
    fit = AR.fit_forecast(AR.index_series(df, "total_revenue", holdout=10), [AR.Order(1, 1, 1, exog=("x",))], 30).first()
    assert len(fit["forecast"]) == 10


def test_items_are_told_apart(spark):
    """600 items with levels of their own and a weekend effect: the trees beat the item mean."""
    rng = random.Random(5)
    rows = []
    for item in range(600):
        level = rng.choice([2, 5, 9, 14, 20, 30]) + rng.random() * 3
        for t in range(40):
            day = D0 + dt.timedelta(days=t)
            q = level * (1.6 if day.weekday() >= 5 else 1.0) + rng.gauss(0, 1)
            rows.append((item % 3, item, f"item {item}", day, max(0, round(q))))
    panel = spark.createDataFrame(rows, "merchant_id int, item_id int, item_name string, order_date date, daily_quantity_sold long")
    split = D0 + dt.timedelta(days=33)
    train, test = panel.where(F.col("order_date") < F.lit(split)).cache(), panel.where(F.col("order_date") >= F.lit(split))
    model = Q.fit(Q.add_calendar(Q.add_levels(train)), [*Q.CAL_FEATURES, *Q.LEVELS], "daily_quantity_sold", 0.3, 30)
    scored = Q.predict(model, Q.add_calendar(test.join(Q.final_levels(train), ["merchant_id", "item_id"])))
    means = train.groupBy("item_id").agg(F.avg("daily_quantity_sold").alias("mean"))
    error = scored.join(means, "item_id").agg(
        F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("daily_quantity_sold"), 2))).alias("model"),
        F.sqrt(F.avg(F.pow(F.col("mean") - F.col("daily_quantity_sold"), 2))).alias("mean")).first()
    assert error["model"] < 0.8 * error["mean"]
    train.unpersist()


def test_levels_never_see_their_own_day(spark):
    rows = [(1, i, "x", D0 + dt.timedelta(days=t), 10 * i + t) for i in (1, 2) for t in range(4)]
    df = spark.createDataFrame(rows, "merchant_id int, item_id int, item_name string, order_date date, daily_quantity_sold long")
    got = {(r["item_id"], (r["order_date"] - D0).days): r for r in Q.add_levels(df).collect()}
    assert got[1, 0]["item_days"] == 0 and got[1, 0]["merchant_level"] == 0.0
    assert got[1, 2]["merchant_level"] == np.mean([10, 11, 20, 21])
    assert got[2, 3]["item_level"] == pytest.approx((20 + 21 + 22 + 3 * np.mean([10, 11, 12, 20, 21, 22])) / 6)


def test_pages_of_a_large_merchant(spark):
    rows = [("big", k % 11, k) for k in range(3000)] + [("small", 1, k) for k in range(7)]
    df = spark.createDataFrame(rows, "merchant_id string, v int, id int")
    got = G.page(df, 25, 100, [F.desc("v"), "id"]).orderBy("row_number").collect()
    want = sorted((r for r in rows if r[0] == "big"), key=lambda r: (-r[1], r[2]))[2500:2600]
    assert [(r["v"], r["id"]) for r in got] == [(v, i) for _, v, i in want]
    assert {(r["row_count"], r["page_count"]) for r in got} == {(3000, 30)}
    assert [r["row_number"] for r in got] == list(range(2501, 2601))


def test_profile_by_group_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.integers(0, 9)) if rng.random() > 0.1 else None, float(rng.normal())) for k in ("a", "b", None) for _ in range(97)]
    rows.append(("only nulls", None, None))
    got = {(r["g"], r["column_name"]): r for r in B.profile(spark.createDataFrame(rows, "g string, x double, y double"), ["x", "y"], ["g"]).collect()}
    for (g, c), r in got.items():
        own = [row[1 if c == "x" else 2] for row in rows if row[0] == g]
        vals = [v for v in own if v is not None]
        assert r["n"] == len(vals) and r["null_count"] == len(own) - len(vals)
        if vals:
            assert [r[p] for p in B.QUANTILES] == pytest.approx([np.percentile(vals, 100 * q) for q in B.QUANTILES.values()])
        else:
            assert r["p50"] is None
    assert len(got) == 8


def test_partial_autocorrelations(spark):
    """The recursion in Spark against solving the Yule-Walker systems."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    x = x[2:] + 0.6 * x[1:-1] - 0.3 * x[:-2]
    c = x - x.mean()
    r = np.array([(c[k:] * c[:len(c) - k]).sum() for k in range(13)]) / (c * c).sum()
    acf = spark.createDataFrame([("m", k, float(v)) for k, v in enumerate(r)], "merchant_id string, lag int, acf double")
    got = [row["pacf"] for row in ST.pacf(acf).orderBy("lag").collect()]
    want = [1.0] + [np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], r[1:k + 1])[-1] for k in range(1, 13)]
    assert got == pytest.approx(want, abs=1e-9)


def test_holdout_split_has_no_merchant_window(spark):
    df = spark.createDataFrame([("a", D0 + dt.timedelta(days=k), k) for k in range(50)], "merchant_id string, order_date date, v int")
    split = W.calendar_holdout(df)
    assert "Window" not in _plan(split)
    assert {r["order_date"] for r in split.where("split = 'test'").collect()} == {D0 + dt.timedelta(days=k) for k in range(19, 50)}


def test_merchant_filter_reaches_the_scan(spark):
    plan = _plan(PS.monthly_sales(V.order_lines(spark, SF_SMALL), 7))
    assert "EqualTo(l_suppkey,7)" in plan


def test_name_panel_is_not_empty(spark):
    got = E.queries()["j14_feature_panel_by_name"](spark, SF_SMALL)
    assert got.where("lag_7 is not null and rolling_mean_7 is not null").count() == got.count() > 0


def test_notebook_models_by_name(spark):
    got = E.queries()["j13_quantity_lags_by_name"](spark, SF_SMALL).collect()
    panel = E.queries()["j14_feature_panel_by_name"](spark, SF_SMALL)
    assert len(got) >= panel.where("split = 'test'").count() > 0 and all(r["forecasted_quantity"] is not None for r in got)


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from stallboard import session as S
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda k, d: d), master="spark://host:7077")
    with pytest.raises(ValueError):
        S.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
