"""Revenue forecasting jobs for all merchants.

The daily series is small (merchants x trading days) but feeds several passes (stage sums,
refinement, evaluation), so it is checkpointed once to the shared checkpoint folder: the
lineage back to the order-line joins is cut and a lost executor re-reads the written
series instead of re-running the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallboard.session import cut_lineage

from stallboard.functions import dates as D
from stallboard.functions import labels as L
from stallboard.functions import numeric as N
from stallboard.operators import aggregates as A
from stallboard.operators import arima as AR


def daily_revenue(lines: DataFrame, revenue: str = "order_value_lines", checkpoint: bool = True) -> DataFrame:
    daily = A.daily_summary(lines, revenue).select("merchant_id", "order_date", "total_revenue")
    return cut_lineage(daily) if checkpoint else daily


def revenue_forecast(daily: DataFrame, horizon: int = 30, holdout: int = 30,
                     order: AR.Order = AR.SARIMA_111_111_7, origin: str = "holdout", residuals: bool = False):
    """Fit on the series minus its last ``holdout`` rows (``origin='holdout'``, the
    reference API's behaviour) or on the whole series (``origin='end'``), forecast
    ``horizon`` calendar days after the last fitted date, rounded to 2 (half to even).

    Returns (fits, forecast rows, indexed series).
    """
    D.check_days(horizon, 1, 30)
    series = AR.index_series(daily, "total_revenue", holdout=holdout if origin == "holdout" else 0)
    fits = AR.fit_forecast(series, [order], horizon, residuals=residuals)
    rows = AR.forecast_rows(fits, series)
    out = rows.select("merchant_id", "h", "forecast_date", N.round2("forecast").alias("forecasted_revenue"),
                      "model", "method")
    return fits, out, series


def historical_evaluation(fits: DataFrame, series: DataFrame) -> DataFrame:
    """The held-out rows predicted by the train fit, with the API's deviation (I23) and
    five-way label (I25), rounded to 2; no deviation and no label where a merchant has no forecast."""
    ho = AR.holdout_rows(fits, series)
    return ho.select("merchant_id", "model", "h", "forecast_date",
                     N.round2("forecast").alias("forecasted_revenue"),
                     N.round2("actual").alias("total_revenue"),
                     N.round2(L.deviation_api("forecast", "actual")).alias("deviation_pct"),
                     F.when(F.col("forecast").isNotNull(), L.label5(F.col("forecast") - F.col("actual"), F.col("actual"))).alias("label"))


def notebook_evaluation(fits: DataFrame, series: DataFrame) -> DataFrame:
    """J6 / J7 holdout table: notebook deviation (I24) and three-way label."""
    ho = AR.holdout_rows(fits, series)
    return ho.select("merchant_id", "model", "h", "forecast_date",
                     N.round2("forecast").alias("forecasted_revenue"),
                     N.round2("actual").alias("total_revenue"),
                     N.round2(L.deviation_nb("actual", "forecast")).alias("deviation_pct"),
                     F.when(F.col("forecast").isNotNull(), L.label3(F.col("actual") - F.col("forecast"), F.col("forecast"))).alias("label"))


def grid_search(daily: DataFrame, holdout: int = 30, orders=None) -> DataFrame:
    """Every (p,1,q), p,q in 0..3, fitted on the train rows; holdout MSE and AIC; failed
    fits dropped, as in the reference; ``rank`` 1 = lowest MSE per merchant (G9). Series that are
    short or constant keep their rows with the method that made the forecast."""
    orders = orders or AR.GRID_PQ
    series = AR.index_series(daily, "total_revenue", holdout=holdout)
    fits = AR.fit_forecast(series, orders, holdout)
    fits = cut_lineage(fits)                     # read twice: errors and the list of fits
    mse = (AR.holdout_rows(fits, series).groupBy("merchant_id", "model")
           .agg(N.mse(F.col("actual") - F.col("forecast")).alias("mse")))
    scored = (fits.where(F.col("method") != "failed")
              .select("merchant_id", "model", "ar_p", "diff_d", "ma_q", "aic", "method")
              .join(mse, ["merchant_id", "model"], "left"))
    w = Window.partitionBy("merchant_id").orderBy(F.col("mse").asc_nulls_last(), "model")
    return scored.withColumn("rank", F.row_number().over(w))


def sarimax_holdout(lines: DataFrame, holdout: int = 30, order: AR.Order = AR.SARIMAX_213_111_7) -> DataFrame:
    """SARIMAX with day_of_week (Mon=0) and promo_flag regressors, holdout evaluation."""
    daily = A.daily_summary(lines, "subtotal").select("merchant_id", "order_date", "total_revenue")
    daily = cut_lineage(daily.withColumn("day_of_week", D.weekday0("order_date"))
                             .withColumn("promo_flag", D.promo_flag("order_date")))
    series = AR.index_series(daily, "total_revenue", holdout=holdout)
    fits = AR.fit_forecast(series, [order], holdout)
    return notebook_evaluation(fits, series)


def residual_series(fits: DataFrame) -> DataFrame:
    """J8 input: the refined model's in-sample one-step residuals, in time order."""
    return fits.where(F.col("resid").isNotNull()).select(
        "merchant_id", "model", F.posexplode("resid").alias("t", "resid"))


def residual_diagnostics(fits: DataFrame, nlags: int = 10) -> DataFrame:
    """J8 + J9 on residuals: Ljung-Box Q and p-value at ``nlags`` per (merchant, model); a series
    without a fitted model has null statistics and its method."""
    from stallboard.operators import stats as ST
    r = residual_series(fits)
    keys = ["merchant_id", "model"]
    lb = ST.ljung_box(ST.acf(r, "resid", nlags, keys=keys, order="t"), nlags, keys=keys)
    return fits.select(*keys, "method").join(lb, keys, "left")


def _last_season(series: DataFrame, holdout: int, s: int):
    """The last ``s`` train values of each merchant, oldest first: a window collect bounded
    by the season length, on the partitioning the row numbers already use (no self-join)."""
    n_train = F.col("n_total") - holdout
    last = F.when(F.col("t") > n_train - s, F.when(F.col("t") <= n_train, F.struct("t", "y")))
    return F.transform(F.array_sort(F.collect_list(last).over(Window.partitionBy("merchant_id"))),
                       lambda r: r["y"])


def _season_value(h: str):
    """The h-th value of the repeated last season (shorter if the training part is), else null."""
    n = F.size("_season")
    return F.when(n > 0, F.get("_season", ((F.col(h) - 1) % F.greatest(n, F.lit(1))).cast("int")))


def seasonal_naive_holdout(daily: DataFrame, holdout: int = 30, s: int = 7) -> DataFrame:
    """Seasonal-naive forecasts of the held-out rows (the solver's fallback method), paired
    positionally with the actuals: the h-th test row is forecast by the train row
    ``n_train - s + ((h-1) mod s) + 1``, picked from the merchant's last ``s`` train values.
    Output (merchant_id, h, forecast_date, forecast, actual)."""
    series = AR.index_series(daily, "total_revenue", holdout=holdout)
    n_train = F.col("n_total") - holdout
    x = series.withColumn("_season", _last_season(series, holdout, s))
    test = (x.where(~F.col("is_train"))
            .withColumn("h", F.when(n_train > 0, F.col("t") - n_train).otherwise(F.col("t"))))
    return test.select("merchant_id", "h", F.col("order_date").alias("forecast_date"),
                       _season_value("h").alias("forecast"), F.col("y").alias("actual"))


def naive_evaluation(pairs: DataFrame) -> DataFrame:
    """I20 + I23-I28 on (forecast, actual) pairs: both deviation conventions and all labels."""
    f, a = F.col("forecast"), F.col("actual")
    return pairs.select(
        "merchant_id", "h", "forecast_date",
        N.round2(f).alias("forecasted_revenue"), N.round2(a).alias("total_revenue"),
        N.round2(L.deviation_api(f, a)).alias("deviation_pct"),
        L.label5(f - a, a).alias("label"),
        N.round2(L.deviation_nb(a, f)).alias("deviation_pct_nb"),
        L.label3(a - f, f).alias("label_nb"),
        L.label3_inclusive(a - f, f).alias("label_qty"))


def naive_calendar_forecast(daily: DataFrame, horizon: int = 30, holdout: int = 30, s: int = 7) -> DataFrame:
    """D5 + I26: seasonal-naive forecast dated by calendar days after the last train date,
    left-joined to the actual daily revenue; days without an actual are 'Future date'."""
    series = AR.index_series(daily, "total_revenue", holdout=holdout)
    n_train = F.col("n_total") - holdout
    last = F.when((F.col("t") > n_train - s) & (F.col("t") <= n_train), F.struct("t", "y"))
    per_m = (series.groupBy("merchant_id")
             .agg(F.max(F.when(F.col("is_train"), F.col("order_date"))).alias("_last"),
                  F.transform(F.array_sort(F.collect_list(last)), lambda r: r["y"]).alias("_season")))
    grid = (per_m.select("merchant_id", "_last", "_season", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
            .withColumn("forecast_date", F.date_add(F.col("_last"), F.col("h")))
            .withColumn("forecast", _season_value("h")))
    act = daily.select("merchant_id", F.col("order_date").alias("forecast_date"),
                       F.col("total_revenue").cast("double").alias("actual"))
    j = grid.join(act, ["merchant_id", "forecast_date"], "left")
    f, a = F.col("forecast"), F.col("actual")
    return j.select("merchant_id", "h", "forecast_date", N.round2(f).alias("forecasted_revenue"),
                    N.round2(a).alias("total_revenue"), N.round2(L.deviation_nb(a, f)).alias("deviation_pct"),
                    L.label3(a - f, f, future=a.isNull()).alias("label"))


def forecast_vs_actual(rows: DataFrame, daily: DataFrame, how: str = "left") -> DataFrame:
    """D4 (``how='inner'``, the API's merge) / D5 (``how='left'``, the notebook's): forecast
    rows dated by calendar day joined to the actual daily revenue on (merchant, date); with
    the left form, days without an actual are labelled 'Future date' (I26)."""
    act = daily.select("merchant_id", F.col("order_date").alias("forecast_date"),
                       F.col("total_revenue").cast("double").alias("actual"))
    j = rows.join(act, ["merchant_id", "forecast_date"], how)
    f, a = F.col("forecasted_revenue"), F.col("actual")
    return j.select("merchant_id", "model", "h", "forecast_date", "forecasted_revenue",
                    N.round2(a).alias("total_revenue"), N.round2(L.deviation_nb(a, f)).alias("deviation_pct"),
                    L.label3(a - f, f, future=a.isNull()).alias("label"))
