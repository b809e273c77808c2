"""Statistics on small frames and their properties."""

import math

import numpy as np

from stallboard.operators import stats as ST


def _nearest(vals, q):
    s = sorted(vals)
    return s[int(math.floor((len(s) - 1) * q + 0.5))]


def test_nearest_quantiles_small_n(spark):
    groups = {"n1": [5.0], "n2": [1.0, 9.0], "n4": [4.0, 1.0, 3.0, 2.0], "n5": [10.0, 50.0, 20.0, 40.0, 30.0]}
    data = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "merchant_id string, total_orders double")
    qs = (0.03, 0.25, 0.5, 0.75, 0.97)
    got = {r["merchant_id"]: r for r in ST.nearest_quantiles(df, ["merchant_id"], ["total_orders"], qs).collect()}
    for g, vs in groups.items():
        for q in qs:
            assert got[g][f"total_orders_q{round(q * 100):02d}"] == _nearest(vs, q), (g, q)
    # n=2: position 0.5 rounds half up to the larger value
    assert got["n2"]["total_orders_q50"] == 9.0


def test_preprocess_bounds_and_constant(spark):
    rng = np.random.default_rng(1)
    data = [("m", i, float(v), float(v) * 3.0, int(v)) for i, v in enumerate(rng.lognormal(3, 1, 200))]
    data += [("c", i, 5.0, 5.0, 5) for i in range(10)]
    df = spark.createDataFrame(data, "merchant_id string, order_date int, total_orders double, total_revenue double, total_items int")
    out = ST.preprocess(df).collect()
    for r in out:
        if r["merchant_id"] == "m":
            assert 0.0 <= r["total_revenue_norm"] <= 1.0
        else:
            assert r["total_revenue_norm"] is None and r["total_revenue_winsor"] == 5.0
    vals = sorted(x[3] for x in data if x[0] == "m")
    lo, hi = _nearest(vals, 0.03), _nearest(vals, 0.97)
    w = [r["total_revenue_winsor"] for r in out if r["merchant_id"] == "m"]
    assert min(w) == lo and max(w) == hi


def test_acf_pacf_ljung_box_properties(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=400)
    ar = np.zeros(400)
    for t in range(1, 400):
        ar[t] = 0.6 * ar[t - 1] + e[t]
    data = [("ar", t, float(v)) for t, v in enumerate(ar)] + [("wn", t, float(v)) for t, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(data, "merchant_id string, order_date int, y double")
    a = ST.acf(df, "y", 10)
    acfs = {(r["merchant_id"], r["lag"]): r["acf"] for r in a.collect()}
    assert abs(acfs[("ar", 0)] - 1.0) < 1e-12 and all(abs(v) <= 1 + 1e-12 for v in acfs.values())
    x = ar - ar.mean()
    assert abs(acfs[("ar", 3)] - (x[3:] @ x[:-3]) / (x @ x)) < 1e-9
    p = {(r["merchant_id"], r["lag"]): r["pacf"] for r in ST.pacf(a).collect()}
    assert abs(p[("ar", 1)] - acfs[("ar", 1)]) < 1e-12
    assert abs(p[("ar", 2)]) < 0.15                      # AR(1): partial correlation vanishes after lag 1
    lb = {r["merchant_id"]: r for r in ST.ljung_box(a, 10).collect()}
    assert lb["ar"]["lb_pvalue"] < 1e-6 and lb["wn"]["lb_pvalue"] > 0.001
    q = 400 * 402 * sum(acfs[("wn", k)] ** 2 / (400 - k) for k in range(1, 11))
    assert abs(lb["wn"]["lb_stat"] - q) < 1e-6


def test_histogram_and_kde(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("m", v) for v in vals] + [("c", 4.0), ("c", 4.0)], "merchant_id string, total_revenue double")
    h = ST.histogram(df, "total_revenue", 3).collect()
    mh = {r["bin"]: r["count"] for r in h if r["merchant_id"] == "m"}
    assert mh == {1: 4, 3: 1} and [r["bin"] for r in h if r["merchant_id"] == "c"] == [1]
    k = ST.kde(df, "total_revenue", 200).where("merchant_id = 'm'").orderBy("grid_index").collect()
    xs = [r["x"] for r in k]
    area = sum((xs[i + 1] - xs[i]) * (k[i]["density"] + k[i + 1]["density"]) / 2 for i in range(len(k) - 1))
    assert 0.5 < area < 1.0                               # mass inside [min, max]
    sd = np.std(vals, ddof=1)
    h0 = sd * len(vals) ** -0.2
    ref = np.mean(np.exp(-0.5 * ((xs[0] - np.array(vals)) / h0) ** 2)) / (h0 * math.sqrt(2 * math.pi))
    assert abs(k[0]["density"] - ref) < 1e-12


def test_box_summary(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("m", v, v, v) for v in vals], "merchant_id string, total_orders double, total_revenue double, total_items double")
    r = {x["feature"]: x for x in ST.box_summary(df).collect()}["total_revenue"]
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 4.0, 1)


def test_adf_rejects_white_noise_not_random_walk(spark):
    rng = np.random.default_rng(3)
    wn = rng.normal(size=500)
    rw = np.cumsum(rng.normal(size=500))
    data = [("wn", t, float(v)) for t, v in enumerate(wn)] + [("rw", t, float(v)) for t, v in enumerate(rw)]
    df = spark.createDataFrame(data, "merchant_id string, order_date int, y double")
    got = {r["merchant_id"]: r for r in ST.adf(df, "y").collect()}
    assert got["wn"]["pvalue"] < 0.01 and got["wn"]["adf_stat"] < got["wn"]["crit_1pct"]
    assert got["rw"]["pvalue"] > 0.05
    assert abs(ST.adf_pvalue(-2.86154) - 0.05) < 0.005 and abs(ST.adf_pvalue(-3.43035) - 0.01) < 0.003


def _plain_adf(y):
    """Least squares as written, lag by AIC on the common sample, refit on all usable rows."""
    n = len(y)
    most = max(0, min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25))))
    dy = np.diff(y)

    def fit(lags, start):
        x = np.column_stack([np.ones(len(dy) - start), y[start:-1]] + [dy[start - i:len(dy) - i] for i in range(1, lags + 1)])
        beta, *_ = np.linalg.lstsq(x, dy[start:], rcond=None)
        e = dy[start:] - x @ beta
        m, k = x.shape
        se = np.sqrt(e @ e / (m - k) * np.linalg.inv(x.T @ x)[1, 1])
        return m * (np.log(2 * np.pi) + np.log(e @ e / m) + 1) + 2 * k, beta[1] / se, m
    lag = min(range(most + 1), key=lambda k: fit(k, most)[0])
    _, stat, m = fit(lag, lag)
    return lag, stat, m


def test_adf_equals_plain_regressions(spark):
    rng = np.random.default_rng(8)
    series = {"a": np.cumsum(rng.normal(size=300)) + 5000, "b": rng.normal(size=120) * 30 + 900, "c": np.cumsum(rng.normal(size=40)),
              "d": 1e5 + 300 * np.sin(np.arange(250) / 4) + rng.normal(size=250)}
    data = [(m, t, float(v)) for m, ys in series.items() for t, v in enumerate(ys)] + [("short", t, float(t)) for t in range(4)]
    got = {r["merchant_id"]: r for r in ST.adf(spark.createDataFrame(data, "merchant_id string, order_date int, y double"), "y").collect()}
    for m, ys in series.items():
        lag, stat, rows = _plain_adf(ys)
        assert (got[m]["used_lag"], got[m]["nobs"]) == (lag, rows)
        assert abs(got[m]["adf_stat"] - stat) < 1e-4 * abs(stat)
    assert got["short"]["adf_stat"] is None


def test_nearest_quantiles_brute_force(spark):
    rng = np.random.default_rng(99)
    groups = {f"g{i}": [float(v) for v in rng.integers(0, 50, size=int(n))] for i, n in
              enumerate(rng.integers(1, 120, size=25))}
    data = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "merchant_id string, total_items double")
    qs = (0.03, 0.25, 0.75, 0.97)
    got = {r["merchant_id"]: r for r in ST.nearest_quantiles(df, ["merchant_id"], ["total_items"], qs).collect()}
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for q in qs:
            assert got[g][f"total_items_q{round(q * 100):02d}"] == _nearest(vs, q), (g, q, len(vs))
