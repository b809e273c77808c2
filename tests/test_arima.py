"""ARIMA solver: parameter recovery, exact roll-out of a noiseless series, determinism."""

import numpy as np
import pytest

from stallboard.operators import arima as AR


def _series(spark, data):
    import datetime as dt
    d0 = dt.date(2020, 1, 1)
    rows = [(m, d0 + dt.timedelta(days=t), float(v)) for m, ys in data.items() for t, v in enumerate(ys)]
    return spark.createDataFrame(rows, "merchant_id string, order_date date, total_revenue double")


def _sim_arma(rng, n, phi, theta, burn=200):
    e = rng.normal(size=n + burn)
    x = np.zeros(n + burn)
    for t in range(1, n + burn):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    return x[burn:]


def test_recovers_arma_on_differences(spark):
    rng = np.random.default_rng(11)
    w = _sim_arma(rng, 2000, 0.5, -0.3)
    y = 1000 + np.cumsum(w)
    df = _series(spark, {"m": y})
    s = AR.index_series(df, "total_revenue", holdout=0)
    fit = AR.fit_forecast(s, [AR.ARIMA_111], 5).first()
    phi, theta = fit["params"]
    assert fit["method"] == "css"
    assert abs(phi - 0.5) < 0.15 and abs(theta + 0.3) < 0.15
    assert fit["aic"] is not None and fit["sigma2"] == pytest.approx(1.0, rel=0.15)


def test_noiseless_weekly_trend_is_exact(spark):
    t = np.arange(300)
    pattern = np.array([5.0, 1.0, 3.0, 7.0, 2.0, 9.0, 4.0])
    y = 100 + 2.0 * t + pattern[t % 7]
    df = _series(spark, {"m": y[:270]})
    s = AR.index_series(df, "total_revenue", holdout=0)
    fit = AR.fit_forecast(s, [AR.SARIMA_111_111_7], 30).first()
    assert fit["method"] == "zero_variance"
    assert np.allclose(fit["forecast"], y[270:300], atol=1e-6)


def test_short_series_falls_back(spark):
    y = np.arange(20, dtype=float)
    df = _series(spark, {"s": y})
    s = AR.index_series(df, "total_revenue", holdout=0)
    fit = AR.fit_forecast(s, [AR.SARIMA_111_111_7], 10).first()
    assert fit["method"] == "seasonal_naive"
    assert fit["forecast"] == [float(v) for v in list(y[13:20]) + list(y[13:16])]


def test_results_independent_of_partitioning(spark):
    rng = np.random.default_rng(5)
    data = {f"m{i}": 500 + np.cumsum(_sim_arma(rng, 300, 0.3, 0.2)) for i in range(3)}
    df = _series(spark, data)
    outs = []
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        s = AR.index_series(df.repartition(parts), "total_revenue", holdout=30)
        outs.append({r["merchant_id"]: r["forecast"] for r in AR.fit_forecast(s, [AR.ARIMA_111], 30).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in data:
        assert np.allclose(outs[0][k], outs[1][k], atol=1e-9) and np.allclose(outs[0][k], outs[2][k], atol=1e-9)


def test_holdout_rows_pair_positions(spark):
    y = 50 + np.cumsum(np.random.default_rng(2).normal(size=120))
    df = _series(spark, {"m": y})
    s = AR.index_series(df, "total_revenue", holdout=30)
    fits = AR.fit_forecast(s, [AR.ARIMA_111], 30)
    ho = AR.holdout_rows(fits, s).orderBy("h").collect()
    assert [r["h"] for r in ho] == list(range(1, 31))
    assert np.allclose([r["actual"] for r in ho], y[90:])


def test_short_merchants_keep_their_held_out_rows(spark):
    """A merchant with 25 trading days has no forecast: its rows stay, without deviation and label."""
    from stallboard.plans import forecasts as PF
    y = 50 + np.cumsum(np.random.default_rng(2).normal(size=120))
    s = AR.index_series(_series(spark, {"long": y, "short": y[:25]}), "total_revenue", holdout=30)
    fits = AR.fit_forecast(s, [AR.ARIMA_111], 30)
    for evaluate in (PF.historical_evaluation, PF.notebook_evaluation):
        got = evaluate(fits, s).collect()
        assert sorted(r.h for r in got if r.merchant_id == "long") == list(range(1, 31))
        short = [r for r in got if r.merchant_id == "short"]
        assert len(short) == 25 and all(r.forecasted_revenue is None and r.label is None and r.total_revenue is not None for r in short)
        assert all(r.label is not None for r in got if r.merchant_id == "long")


def test_sarimax_with_exog(spark):
    import datetime as dt
    rng = np.random.default_rng(9)
    n = 400
    d0 = dt.date(2021, 1, 4)
    days = [d0 + dt.timedelta(days=i) for i in range(n)]
    promo = np.array([1.0 if d.day % 10 == 0 else 0.0 for d in days])
    y = 200 + np.cumsum(rng.normal(size=n)) + 25.0 * promo
    rows = [("m", d, float(v), d.weekday(), int(p)) for d, v, p in zip(days, y, promo)]
    df = spark.createDataFrame(rows, "merchant_id string, order_date date, total_revenue double, day_of_week int, promo_flag int")
    s = AR.index_series(df, "total_revenue", holdout=30)
    o = AR.Order(1, 1, 1, exog=("promo_flag",))
    fit = AR.fit_forecast(s, [o], 30).first()
    assert fit["method"] == "css" and abs(fit["params"][-1] - 25.0) < 3.0


def test_sarima_beats_seasonal_naive_on_seasonal_data(spark):
    """Airline-model series (SARIMA(0,1,1)(0,1,1,7)): the fitted SARIMA's 30-step holdout
    error is below seasonal-naive's, summed over several series."""
    rng = np.random.default_rng(21)
    data = {}
    for i in range(6):
        n = 600
        e = rng.normal(size=n + 20)
        w = e[8:] - 0.4 * e[7:-1] - 0.6 * e[1:-7] + 0.24 * e[:-8]        # (1-.4B)(1-.6B^7) e
        y = np.zeros(len(w))
        pattern = np.array([3.0, -1.0, 0.0, 2.0, -2.0, 5.0, -4.0]) * 4
        for t in range(len(w)):
            y[t] = w[t] + (y[t - 1] if t >= 1 else 0) + (y[t - 7] if t >= 7 else 0) - (y[t - 8] if t >= 8 else 0)
        data[f"s{i}"] = 500 + y + pattern[np.arange(len(y)) % 7]
    df = _series(spark, data)
    s = AR.index_series(df, "total_revenue", holdout=30)
    fits = AR.fit_forecast(s, [AR.SARIMA_111_111_7], 30)
    ho = AR.holdout_rows(fits, s).collect()
    sarima = sum((r["actual"] - r["forecast"]) ** 2 for r in ho)
    naive = 0.0
    for k, y in data.items():
        train = y[:-30]
        fc = np.array([train[len(train) - 7 + (h % 7)] for h in range(30)])
        naive += float(np.sum((y[-30:] - fc) ** 2))
    assert sarima < naive


def test_grid_search_ranks_by_holdout_mse(spark):
    from stallboard.plans import forecasts as PF
    rng = np.random.default_rng(4)
    data = {f"g{i}": 300 + np.cumsum(_sim_arma(rng, 250, 0.4, 0.3)) for i in range(2)}
    df = _series(spark, data)
    res = PF.grid_search(df, holdout=30).collect()
    for m in data:
        rows = sorted((r for r in res if r["merchant_id"] == m), key=lambda r: r["rank"])
        assert len(rows) == 16
        assert {(r["ar_p"], r["ma_q"]) for r in rows} == {(p, q) for p in range(4) for q in range(4)}
        assert [r["rank"] for r in rows] == list(range(1, 17))
        assert all(rows[i]["mse"] <= rows[i + 1]["mse"] for i in range(15))
        assert all(r["aic"] is not None for r in rows)


def test_stacked_series_equal_single_ones():
    """Series of different lengths refined together give what each gives alone, in far fewer steps of Python."""
    rng = np.random.default_rng(3)
    for order in (AR.SARIMA_111_111_7, AR.ARIMA_111, AR.Order(0, 1, 2), AR.Order(1, 1, 1, exog=("x",))):
        found = []
        for n in (150, 300, 220, 90):
            y = 500 + np.cumsum(_sim_arma(rng, n + 30, 0.5, 0.3))
            found.append({"y": y[:n], "x": {c: rng.integers(0, 3, n + 30).astype(float) for c in order.exog}, "sums": None})
        got = AR.fit_forecast_chunk(found, [order], order.ar_lags(), order.ma_lags(), 30, residuals=True)
        for r, g in zip(found, got):
            X, Xf = (np.column_stack(r[k]) if order.exog else np.zeros((len(r["ws"]), 0)) for k in ("X", "Xf"))
            x, S, n_eff, converged = AR._refine(order, np.zeros(order.n_params), r["ws"], X)
            want = AR._forecast(order, x, r["y"], r["ws"], X, Xf if order.exog else np.zeros((30, 0)), 30, r["sd"])
            assert g["method"] == "css" and g["converged"] == converged and len(g["resid"]) == n_eff
            assert np.allclose(g["forecast"], want, rtol=1e-4) and g["sigma2"] == pytest.approx(S / n_eff * r["sd"] ** 2, rel=1e-6)
    assert AR.fit_forecast_chunk([], [AR.ARIMA_111], [1], [1], 30) == []
