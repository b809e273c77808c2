"""Forecasts that plain SQL can state: the item's mean quantity per weekday.

They need no model, so every reshaping of a forecast (D4, D6-D8, E13, E15-E18, I21, I24, I28,
J16, J17) can be checked against SQL over them; the model jobs use the same reshapers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.functions import dates as D
from stallboard.functions import labels as L
from stallboard.functions import numeric as N
from stallboard.operators import quantity as Q


KEYS = ["merchant_id", "item_id"]


def weekday_items(daily_train: DataFrame) -> DataFrame:
    """One row per item: (merchant_id, item_id, item_name, safe_name, _by_day, _all), its mean daily quantity on the seven
    weekdays (null: never sold on it) and on all its days, in the aggregate that names it."""
    q, weekday = F.col("daily_quantity_sold"), D.iso_weekday("order_date")
    mean = lambda sold: F.try_divide(F.sum(sold), F.count(sold))
    return Q.horizon_items(daily_train, levels=False, more=[F.array(*(mean(F.when(weekday == k, q)) for k in range(1, 8))).alias("_by_day"), mean(q).alias("_all")])


def _prediction(day):
    return F.coalesce(F.get("_by_day", D.iso_weekday(day) - 1), F.col("_all"))


def weekday_mean_forecast(daily_train: DataFrame, cutoff, horizon: int = 30) -> DataFrame:
    """J16's long form from weekday means: (merchant_id, h, order_date, item_id, item_name,
    safe_name, prediction, predicted_quantity).

    An item's forecast is its mean daily quantity on that weekday, or on all its days if it
    never sold on one; both come from one aggregate per item, before the fan-out over the days."""
    value = _prediction("order_date")
    return Q.fan_out(weekday_items(daily_train), cutoff, horizon).select(
        "merchant_id", "h", "order_date", "item_id", "item_name", "safe_name", value.alias("prediction"), N.nonneg_int(value).alias("predicted_quantity"))


def weekday_quantities(items: DataFrame, cutoff, horizon: int = 30) -> DataFrame:
    """The forecast with a row per item, as ``Q.horizon_quantities`` has it."""
    first = F.date_add(F.lit(D.as_date(cutoff)), 1)
    days = F.transform(D.date_sequence(first, horizon), lambda day: N.nonneg_int(_prediction(day)))
    return items.select("merchant_id", "item_id", "item_name", "safe_name", first.alias("first_day"), days.alias("quantities"))


def with_sold_days(items: DataFrame, daily: DataFrame, cutoff, horizon: int = 30, how: str = "left") -> DataFrame:
    """Items with ``_sold``: what they sold on days of the horizon, by date. ``horizon`` entries at most."""
    first = F.date_add(F.lit(D.as_date(cutoff)), 1)
    in_horizon = daily.where(F.col("order_date").between(first, F.date_add(first, horizon - 1)))
    # fresh names, as both sides come from the same lines
    keys = [F.col(k).alias(f"_{k}") for k in KEYS]
    sold = in_horizon.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("order_date", "daily_quantity_sold"))).alias("_sold"))
    on = (F.col("merchant_id") == F.col("_merchant_id")) & (F.col("item_id") == F.col("_item_id"))
    return items.join(sold, on, how).drop("_merchant_id", "_item_id")


def with_actuals(items: DataFrame, daily: DataFrame, cutoff, horizon: int = 30, how: str = "left") -> DataFrame:
    """D4 / D5 for items: the weekday forecast of ``items`` (``weekday_items``) with the quantity sold (``inner``: sold days only).

    The sold days of the horizon meet their item as one list, so the forecast is joined once per item and becomes days
    only after it; the inner form has no other days than the sold ones."""
    first = F.date_add(F.lit(D.as_date(cutoff)), 1)
    joined = with_sold_days(items, daily, cutoff, horizon, how)
    if how == "inner":
        days = joined.select("*", F.explode("_sold").alias("order_date", "daily_quantity_sold")).withColumn("h", F.datediff("order_date", first) + 1)
    else:
        days = Q.fan_out(joined, cutoff, horizon).withColumn("daily_quantity_sold", F.element_at("_sold", F.col("order_date")))
    value = _prediction("order_date")
    return days.select("merchant_id", "order_date", "item_id", "h", "item_name", "safe_name", value.alias("prediction"),
                       N.nonneg_int(value).alias("predicted_quantity"), "daily_quantity_sold")


def pivot_all_items(items: DataFrame, daily: DataFrame, cutoff, horizon: int = 30, width: int = Q.PIVOT_WIDTH) -> DataFrame:
    """E15 / D7 over all items of the weekday forecast: ``Q.pivot_all_items`` of ``results(with_actuals(...))``."""
    first = F.date_add(F.lit(D.as_date(cutoff)), 1)
    by_day = F.transform("_by_day", lambda m: N.round2(F.coalesce(m, F.col("_all"))))
    sold = F.when(F.col("_sold").isNotNull(), F.transform(D.date_sequence(first, horizon), lambda day: F.element_at("_sold", day).cast("double")))
    rows = with_sold_days(items.select(*KEYS, by_day.alias("by_day")), daily, cutoff, horizon).select(*KEYS, "by_day", sold.alias("sold"))
    return Q.pivot_item_days(rows, cutoff, horizon, lambda c, day: F.get(c["by_day"], D.iso_weekday(day) - 1),
                             lambda c, day: F.get(c["sold"], F.datediff(day, first)), width)


def breakdown(forecast: DataFrame, value: str, days: int, keys=("merchant_id",)) -> DataFrame:
    """E17 / E18 in long form: per key the first ``days`` forecast days, one row each, with the
    period's length and total; a catalogue of any size is never gathered into one row."""
    days = D.check_days(days, 1, 30)
    keys = list(keys)
    first = forecast.where(F.col("h") <= days)
    per_day = first.groupBy(*keys, "h", "order_date").agg(F.sum(value).alias("daily_value"))
    total = first.groupBy(*keys).agg(F.sum(value).alias("total_value"))
    return per_day.join(total, keys).withColumn("forecast_period_days", F.lit(days))


def results(pairs: DataFrame) -> DataFrame:
    """J17 over (prediction, daily_quantity_sold) pairs."""
    return Q.holdout_results(pairs)

