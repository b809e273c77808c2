"""Per-merchant statistics over daily series.

A daily series holds one row per merchant and trading day, so each merchant's group is
bounded by the calendar (a few thousand rows), not by order volume; window sorts keyed by
merchant are therefore safe. Row-level work (lags, products, sums) and the recursions are SQL;
Python runs only for the small regressions of J11, over Arrow batches of one aggregated row
per merchant.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallboard.session import ship_package, spread_by

DAILY_METRICS = ("total_orders", "total_revenue", "total_items")


def nearest_rank(q: float):
    """1-based row of the 'nearest' quantile of n sorted values: round_half_up((n-1)q) + 1."""
    return F.floor((F.col("_n") - 1) * F.lit(float(q)) + F.lit(0.5)) + 1


def nearest_quantiles(df: DataFrame, keys, metrics, qs) -> DataFrame:
    """Per group, the 'nearest' quantiles of each metric (polars' default rule).

    Output columns ``{metric}_q{int(q*100):02d}``; one row per group. Each metric takes one
    window sort within the group.
    """
    keys = list(keys)
    wn = Window.partitionBy(*keys)
    x = df.select(*keys, *metrics).withColumn("_n", F.count(F.lit(1)).over(wn))
    aggs = []
    for m in metrics:
        x = x.withColumn(f"_rn_{m}", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(m))))
        for q in qs:
            aggs.append(F.max(F.when(F.col(f"_rn_{m}") == nearest_rank(q), F.col(m).cast("double")))
                        .alias(f"{m}_q{round(q * 100):02d}"))
    return x.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)


def iqr_outliers(daily: DataFrame, keys=("merchant_id",), metrics=DAILY_METRICS) -> DataFrame:
    """Per group and metric, q1/q3 (nearest), bounds q1-1.5iqr / q3+1.5iqr and the
    number of values outside them (C10). The quartiles are window aggregates over the
    merchant partition and the counts a grouped aggregate on the same partitioning, so the
    series is shuffled once."""
    keys = list(keys)
    wp = Window.partitionBy(*keys)
    x = daily.withColumn("_n", F.count(F.lit(1)).over(wp))
    for m in metrics:
        x = x.withColumn(f"_rn_{m}", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(m))))
    for m in metrics:
        v = F.col(m).cast("double")
        x = (x.withColumn(f"_q1_{m}", F.max(F.when(F.col(f"_rn_{m}") == nearest_rank(0.25), v)).over(wp))
              .withColumn(f"_q3_{m}", F.max(F.when(F.col(f"_rn_{m}") == nearest_rank(0.75), v)).over(wp)))
    aggs = []
    for m in metrics:
        q1, q3 = F.col(f"_q1_{m}"), F.col(f"_q3_{m}")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs += [F.max(q1).alias(f"{m}__q1"), F.max(q3).alias(f"{m}__q3"),
                 F.max(lo).alias(f"{m}__lo"), F.max(hi).alias(f"{m}__hi"),
                 F.count_if((F.col(m) < lo) | (F.col(m) > hi)).alias(f"{m}__n")]
    row = x.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"'{m}', {m}__q1, {m}__q3, {m}__lo, {m}__hi, {m}__n" for m in metrics)
    return row.selectExpr(*keys, f"stack({len(metrics)}, {stack}) as (feature, q1, q3, lower_bound, upper_bound, n_outliers)")


def preprocess(daily: DataFrame, keys=("merchant_id",), metrics=DAILY_METRICS,
               low_q: float = 0.03, high_q: float = 0.97) -> DataFrame:
    """Winsorize each metric to its [q.03, q.97] (nearest), log1p, then min-max scale.

    The bounds come from window functions over the merchant's own rows (row numbers per
    metric, then a partition-wide max of the value at the target row), so the series is
    shuffled once by merchant and never joined back to an aggregate. The winsor bounds are
    values of the series, so after clipping min = lo and max = hi, and the min-max scale is
    (log1p(w) - log1p(lo)) / (log1p(hi) - log1p(lo)). A constant series gives null (the
    reference gets NaN).
    """
    keys = list(keys)
    wp = Window.partitionBy(*keys)
    out = daily.withColumn("_n", F.count(F.lit(1)).over(wp))
    for m in metrics:
        out = out.withColumn(f"_rn_{m}", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(m))))
    for m in metrics:
        x = F.col(m).cast("double")
        lo = F.max(F.when(F.col(f"_rn_{m}") == nearest_rank(low_q), x)).over(wp)
        hi = F.max(F.when(F.col(f"_rn_{m}") == nearest_rank(high_q), x)).over(wp)
        out = out.withColumn(f"_lo_{m}", lo).withColumn(f"_hi_{m}", hi)
    for m in metrics:
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        w = F.least(F.greatest(F.col(m).cast("double"), lo), hi)
        out = (out.withColumn(f"{m}_winsor", w)
                  .withColumn(f"{m}_log1p", F.log1p(w))
                  .withColumn(f"{m}_norm", F.try_divide(F.log1p(w) - F.log1p(lo), F.log1p(hi) - F.log1p(lo))))
    return out.drop("_n", *[f"_{p}_{m}" for m in metrics for p in ("rn", "lo", "hi")])


def box_summary(daily: DataFrame, keys=("merchant_id",), metrics=DAILY_METRICS) -> DataFrame:
    """Five-number box summary per metric: linear quartiles, whiskers at the most extreme
    values within 1.5 IQR, and the count of points beyond them. Quartiles are window
    aggregates over the merchant partition, so the series is shuffled once."""
    keys = list(keys)
    wp = Window.partitionBy(*keys)
    j = daily
    for m in metrics:
        j = j.withColumn(f"{m}__p", F.percentile(F.col(m).cast("double"), [0.25, 0.5, 0.75]).over(wp))
    aggs = []
    for m in metrics:
        q1, med, q3 = F.col(f"{m}__p")[0], F.col(f"{m}__p")[1], F.col(f"{m}__p")[2]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = F.col(m).cast("double")
        aggs += [F.max(q1).alias(f"{m}__q1"), F.max(med).alias(f"{m}__med"), F.max(q3).alias(f"{m}__q3"),
                 F.min(F.when(x >= lo, x)).alias(f"{m}__wlo"), F.max(F.when(x <= hi, x)).alias(f"{m}__whi"),
                 F.count_if((x < lo) | (x > hi)).alias(f"{m}__n")]
    row = j.groupBy(*keys).agg(*aggs)
    stack = ", ".join(f"'{m}', {m}__q1, {m}__med, {m}__q3, {m}__wlo, {m}__whi, {m}__n" for m in metrics)
    return row.selectExpr(*keys, f"stack({len(metrics)}, {stack}) as "
                                 f"(feature, q1, median, q3, whisker_low, whisker_high, n_outliers)")


def histogram(daily: DataFrame, metric: str, bins: int | None = 30, keys=("merchant_id",)) -> DataFrame:
    """``bins`` (None: Sturges' number, ceil(log2 n + 1)) equal-width bins between the group's min and max; x = max falls in the last bin.
    A constant group puts everything in bin 1. Min and max are window aggregates over the
    merchant partition; the bin counts a grouped aggregate (map-side combined)."""
    keys = list(keys)
    wp = Window.partitionBy(*keys)
    x = F.col(metric).cast("double")
    d = daily.withColumn("_mn", F.min(x).over(wp)).withColumn("_mx", F.max(x).over(wp))
    bins = F.lit(bins) if bins else F.col("_bins")
    d = d.withColumn("_bins", F.ceil(F.log2(F.count(F.lit(1)).over(wp)) + 1))
    b = F.when(F.col("_mx") == F.col("_mn"), F.lit(1)).otherwise(
        F.least(F.floor((x - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * bins) + 1, bins))
    width = (F.col("_mx") - F.col("_mn")) / bins
    return (d.withColumn("bin", b.cast("int"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"),
                                       F.max(F.col("_mn") + (F.col("bin") - 1) * width).alias("bin_low"),
                                       F.max(F.col("_mn") + F.col("bin") * width).alias("bin_high")))


def kde(daily: DataFrame, metric: str, grid: int = 64, keys=("merchant_id",)) -> DataFrame:
    """Gaussian kernel density on ``grid`` equally spaced points over [min, max], Scott's
    bandwidth ``sd * n^(-1/5)``.

    The merchant's n, min, max and sd are window aggregates over its partition; every sample
    row then emits its contribution to each grid point (``grid`` rows per sample, generated
    in place), summed with map-side combine -- linear in the data, no pairing of samples,
    no join of grid with sample.
    """
    keys = list(keys)
    wp = Window.partitionBy(*keys)
    x = F.col(metric).cast("double")
    st = (daily.select(*keys, x.alias("_x"))
          .withColumn("_n", F.count("_x").over(wp)).withColumn("_mn", F.min("_x").over(wp))
          .withColumn("_mx", F.max("_x").over(wp))
          .withColumn("_h", F.stddev_samp("_x").over(wp) * F.pow(F.col("_n"), F.lit(-0.2))))
    g = F.col("_mn") + F.col("_g") * (F.col("_mx") - F.col("_mn")) / F.lit(grid - 1)
    z = (g - F.col("_x")) / F.col("_h")
    contrib = F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return (st.where(F.col("_h") > 0)
            .select(*keys, "_x", "_n", "_mn", "_mx", "_h", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_g"))
            .groupBy(*keys, F.col("_g").alias("grid_index"))
            .agg(F.max(g).alias("x"), F.sum(contrib).alias("density")))


# ------------------------------------------------------------------ series diagnostics

def with_t(series: DataFrame, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """Row position t (1-based) per merchant: rows, not calendar days -- gaps are not filled."""
    return series.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def difference(series: DataFrame, value: str, keys=("merchant_id",), order: str = "order_date",
               lag: int = 1, out: str = "diff") -> DataFrame:
    """value - lag(value, lag); the first ``lag`` rows (null) are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (series.withColumn(out, F.col(value) - F.lag(value, lag).over(w))
                  .where(F.col(out).isNotNull()))


def acf(series: DataFrame, value: str, nlags: int = 30, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """Autocorrelation r_0..r_nlags per merchant (denominator n at every lag, as the
    default non-adjusted estimator).

    Centred values and their lags come from one window sort per merchant, the lag products
    are summed by one aggregate; output (merchant, lag, acf, n).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    wa = Window.partitionBy(*keys)
    c = series.select(*keys, order, (F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(wa)).alias("_x"))
    c = c.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, nlags + 1)])
    sums = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("s0"),
                                *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, nlags + 1)])
    stack = ", ".join(f"{k}, s{k}" for k in range(nlags + 1))
    long = sums.selectExpr(*keys, "n", "s0 as _s0", f"stack({nlags + 1}, {stack}) as (lag, _sk)")
    return long.select(*keys, "lag", F.try_divide(F.coalesce(F.col("_sk"), F.lit(0.0)), F.col("_s0")).alias("acf"), "n")


def ljung_box(acf_long: DataFrame, lags: int = 10, keys=("merchant_id",)) -> DataFrame:
    """Q = n(n+2) sum_{k<=lags} r_k^2/(n-k); p = chi-square(lags) upper tail, closed form
    for even degrees of freedom: exp(-Q/2) sum_{i<lags/2} (Q/2)^i / i!."""
    if lags % 2:
        raise ValueError("closed-form p-value needs an even number of lags")
    keys = list(keys)
    q = (acf_long.where((F.col("lag") >= 1) & (F.col("lag") <= lags))
         .groupBy(*keys).agg(F.max("n").alias("n"),
                             F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_s")))
    q = q.withColumn("lb_stat", F.col("n") * (F.col("n") + 2) * F.col("_s"))
    half = F.col("lb_stat") / 2
    tail = sum((F.pow(half, F.lit(i)) / F.lit(float(math.factorial(i))) for i in range(1, lags // 2)), F.lit(1.0))
    return q.select(*keys, "n", F.lit(lags).alias("lag"), "lb_stat", (F.exp(-half) * tail).alias("lb_pvalue"))


def pacf(acf_long: DataFrame, keys=("merchant_id",)) -> DataFrame:
    """Partial autocorrelations (Yule-Walker, as from the biased ACF) per merchant.

    The merchant's ACF values are gathered into one ordered array (nlags + 1 values, a bound set
    by the lag count) and the Durbin-Levinson recursion is one ``aggregate`` over the lags:
    state (phi, v, partials), step k: a = (r_k - sum phi_j r_(k-j)) / v, phi_j - a phi_(k-j), v (1 - a^2)."""
    keys = list(keys)
    rows = acf_long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_r"))
    rows = rows.select(*keys, F.transform("_r", lambda x: x["acf"]).alias("_acf"))
    recursion = """
        aggregate(sequence(1, size(_acf) - 1),
                  named_struct('phi', cast(array() as array<double>), 'v', 1.0D, 'out', array(1.0D)),
                  (s, k) -> transform(array(try_divide(_acf[k] - aggregate(
                                zip_with(s.phi, reverse(slice(_acf, 2, k - 1)), (p, q) -> p * q), 0.0D, (x, y) -> x + y), s.v)),
                            a -> named_struct('phi', concat(zip_with(s.phi, reverse(s.phi), (p, q) -> p - a * q), array(a)),
                                              'v', s.v * (1 - a * a), 'out', concat(s.out, array(a))))[0],
                  s -> s.out)"""
    return rows.select(*keys, F.posexplode(F.expr(recursion)).alias("lag", "pacf"))


def dickey_fuller(series: DataFrame, value: str, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """J11 without augmenting lags: the tau statistic of dy on y_(t-1) with a constant, from the
    regression sums of one aggregate. (keys, nobs, adf_stat)."""
    w = Window.partitionBy(*keys).orderBy(order)
    y = F.col(value).cast("double")
    x = series.select(*keys, F.lag(y).over(w).alias("_l"), (y - F.lag(y).over(w)).alias("_d")).where(F.col("_l").isNotNull())
    s = x.groupBy(*keys).agg(F.count("_l").alias("nobs"), F.regr_slope("_d", "_l").alias("_b"), F.regr_sxx("_d", "_l").alias("_xx"),
                             F.regr_syy("_d", "_l").alias("_yy"), F.regr_sxy("_d", "_l").alias("_xy"))
    error = F.try_divide(F.try_divide(F.col("_yy") - F.col("_b") * F.col("_xy"), F.col("nobs") - 2), F.col("_xx"))
    return s.select(*keys, "nobs", F.try_divide(F.col("_b"), F.sqrt(error)).alias("adf_stat"))


# ------------------------------------------------------------------ J11 augmented Dickey-Fuller

# MacKinnon (1994) p-value response surface and MacKinnon (2010) critical
# values for the Dickey-Fuller tau statistic with a constant term and one series.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALLP = (2.1659, 1.4412, 0.038269)
ADF_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
            "5%": (-2.86154, -2.8903, -4.234, -40.040),
            "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALLP if stat <= ADF_TAU_STAR else ADF_LARGEP
    z = sum(c * stat ** i for i, c in enumerate(coef))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: c[0] + c[1] / nobs + c[2] / nobs ** 2 + c[3] / nobs ** 3 for k, c in ADF_CRIT.items()}


ADF_EMPTY = dict(adf_stat=None, pvalue=None, used_lag=None, nobs=None, crit_1pct=None, crit_5pct=None, crit_10pct=None)


def _regression(gram, lags: int, last: int, n: int):
    """Regression of the last column on columns 0 .. lags + 1 from the product sums ``gram``:
    (coefficients, inverse of their matrix, residual sum of squares), or None if singular."""
    import numpy as np
    cols = list(range(lags + 2))
    a, b = gram[np.ix_(cols, cols)], gram[cols, last]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ b
    ssr = float(gram[last, last] - beta @ b)
    return (beta, inverse, ssr) if n > len(cols) and ssr > 0 else None


def _products(y, known, lags: int):
    """Rows of a series from ``lags`` + 2 on, where that many lagged differences exist, and the product sums of its columns:
    the constant, the centred lagged level, ``lags`` lagged differences and the difference. A missing value adds nothing."""
    import numpy as np
    n = len(y)
    rows = max(0, n - lags - 1)
    if not rows:
        return 0, np.zeros((lags + 3, lags + 3))
    level = np.where(known, y - (y[known].mean() if known.any() else 0.0), 0.0)
    step = np.zeros(n)  # step[t] leads to row t from the row before
    step[1:] = np.where(known[1:] & known[:-1], y[1:] - y[:-1], 0.0)
    first = lags + 1
    x = np.empty((rows, lags + 3))
    x[:, 0], x[:, 1], x[:, -1] = 1.0, level[first - 1:n - 1], step[first:]
    for k in range(1, lags + 1):
        x[:, k + 1] = step[first - k:n - k]
    return rows, x.T @ x


def adf(series: DataFrame, value: str, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """J11 per merchant: augmented Dickey-Fuller with a constant, lag length by AIC over
    0..ceil(12 (n/100)^(1/4)) on a common sample, then refitted on all usable rows.

    Spark puts every series together as one ordered list, a number per day; the product sums of its lag columns (the
    columns themselves are never rows) and the small systems are solved next to it, each series in one pass.
    The level is centred, which the constant absorbs. Series with a null in their key are left out."""
    import numpy as np
    keys = list(keys)
    ship_package(series.sparkSession)
    y = F.col(value).cast("double")
    kinds = ", ".join(f"{k} {dict(series.dtypes)[k]}" for k in keys)

    def test(y, known) -> dict:
        n = len(y)
        limit = max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))
        rows, gram = _products(y, known, limit)
        best, chosen = None, 0
        for k in range(limit + 1):
            fit = _regression(gram, k, limit + 2, rows)
            if fit is not None:
                aic = rows * (math.log(2 * math.pi) + math.log(fit[2] / rows) + 1) + 2 * (k + 2)
                if best is None or aic < best:
                    best, chosen = aic, k
        rows, gram = _products(y, known, chosen)
        fit = _regression(gram, chosen, chosen + 2, rows) if n >= 6 else None
        if fit is None:
            return ADF_EMPTY
        beta, inverse, ssr = fit
        stat = float(beta[1] / math.sqrt(ssr / (rows - chosen - 2) * inverse[1, 1]))
        crit = adf_critical(rows)
        return dict(adf_stat=stat, pvalue=adf_pvalue(stat), used_lag=chosen, nobs=rows, crit_1pct=crit["1%"],
                    crit_5pct=crit["5%"], crit_10pct=crit["10%"])

    def solve(batches):
        for pdf in batches:
            out = [test(np.asarray(y, float), np.asarray(known, bool)) for y, known in zip(pdf["_y"], pdf["_known"])]
            frame = pd.DataFrame(out, columns=list(ADF_EMPTY))
            for c in ("used_lag", "nobs"):
                frame[c] = frame[c].astype("Int32")
            yield pd.concat([pdf[keys].reset_index(drop=True), frame], axis=1)

    lists = (series.dropna(subset=keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), y.alias("y")))).alias("_s"))
             .select(*keys, F.transform("_s", lambda p: F.coalesce(p["y"], F.lit(0.0))).alias("_y"), F.transform("_s", lambda p: p["y"].isNotNull()).alias("_known")))
    # few bytes, but a series is some milliseconds of work
    return spread_by(lists, keys, 1).mapInPandas(
        solve, f"{kinds}, adf_stat double, pvalue double, used_lag int, nobs int, crit_1pct double, crit_5pct double, crit_10pct double")
