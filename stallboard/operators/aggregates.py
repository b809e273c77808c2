"""Grouped aggregations over the order-line view.

Every aggregation keeps ``merchant_id`` as the leading key, so one job answers for all
merchants. All are plain ``groupBy().agg()``: Spark combines map-side before the shuffle,
so a merchant holding a third of the rows ships only one partial row per task and key.
Money is summed as an exact decimal and cast to double at the end, which makes the result
independent of partitioning and summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallboard.functions import dates as D
from stallboard.functions import numeric as N


def last_order_per_customer(cl: DataFrame) -> DataFrame:
    """(merchant_id, eater_id, last_order_date)."""
    return cl.groupBy("merchant_id", "eater_id").agg(F.max("order_time").alias("last_order_date"))


def item_frequency(cl: DataFrame) -> DataFrame:
    """Rows per (merchant, eater, item_name); equal names merge, quantity is not used."""
    return cl.groupBy("merchant_id", "eater_id", "item_name").agg(F.count(F.lit(1)).alias("item_count"))


def item_sales(lines: DataFrame) -> DataFrame:
    """Per (merchant, item_id, item_name) total quantity (int) and sales (double)."""
    return (lines.groupBy(F.col("order_merchant_id").alias("merchant_id"), "item_id", "item_name")
                 .agg(F.sum("quantity").cast("int").alias("total_quantity"),
                      N.exact_sum_double(F.col("item_price") * F.col("quantity")).alias("total_sales")))


def monthly_sales(lines: DataFrame) -> DataFrame:
    """Distinct (order, value, month) first, then the month total; no double counting."""
    uniq = lines.select(F.col("order_merchant_id").alias("merchant_id"), "order_id", "order_value",
                        D.month_key("order_time").alias("month")).distinct()
    return uniq.groupBy("merchant_id", "month").agg(N.exact_sum_double("order_value").alias("total_sales"))


REVENUE_KINDS = ("order_value_lines", "subtotal", "order_value_distinct")


def daily_summary(lines: DataFrame, revenue: str = "order_value_lines") -> DataFrame:
    """Per (merchant, order_date): distinct orders, revenue, items.

    ``revenue``: 'order_value_lines' sums order_value once per line (the API's figure, E5),
    'subtotal' sums line subtotals (the notebook's, E6), 'order_value_distinct' counts each
    order's value once (the monthly report's definition).
    """
    if revenue not in REVENUE_KINDS:
        raise ValueError(f"revenue must be one of {REVENUE_KINDS}")
    base = lines.select(F.col("order_merchant_id").alias("merchant_id"),
                        D.order_date("order_time").alias("order_date"),
                        "order_id", "order_value", "quantity", "subtotal")
    items_orders = base.groupBy("merchant_id", "order_date").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").cast("long").alias("total_items"),
        *([N.exact_sum_double("order_value").alias("total_revenue")] if revenue == "order_value_lines" else []),
        *([N.exact_sum_double("subtotal").alias("total_revenue")] if revenue == "subtotal" else []),
    )
    if revenue != "order_value_distinct":
        return items_orders.select("merchant_id", "order_date", "total_orders", "total_revenue", "total_items")
    per_order = (base.groupBy("merchant_id", "order_date", "order_id")
                     .agg(F.max("order_value").alias("order_value"),
                          F.sum("quantity").alias("q"))
                     .groupBy("merchant_id", "order_date")
                     .agg(F.count(F.lit(1)).alias("total_orders"),
                          N.exact_sum_double("order_value").alias("total_revenue"),
                          F.sum("q").cast("long").alias("total_items")))
    return per_order


def daily_item_quantity(lines: DataFrame, by_name: bool = True) -> DataFrame:
    """E8 (``by_name``): sum of quantity per (merchant, date, item_id, item_name).
    E7: per (merchant, date, item_id) with one name per id (smallest, deterministic)."""
    base = lines.select(F.col("order_merchant_id").alias("merchant_id"),
                        D.order_date("order_time").alias("order_date"), "item_id", "item_name", "quantity")
    if by_name:
        return base.groupBy("merchant_id", "order_date", "item_id", "item_name").agg(
            F.sum("quantity").cast("long").alias("daily_quantity_sold"))
    return base.groupBy("merchant_id", "order_date", "item_id").agg(
        F.min("item_name").alias("item_name"),
        F.sum("quantity").cast("long").alias("daily_quantity_sold"))


def label_histogram(df: DataFrame, label: str = "label", keys=("merchant_id",)) -> DataFrame:
    """E11 + F9: count per label and its share of the group, rounded to 2."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("pct", F.round(F.col("count") * 100.0 / F.sum("count").over(w), 2))


def argmax_item(daily_items: DataFrame, qty: str = "daily_quantity_sold") -> DataFrame:
    """Per merchant, the item with the largest summed quantity (ties: smallest id)."""
    tot = daily_items.groupBy("merchant_id", "item_id").agg(F.sum(qty).alias("total"))
    return tot.groupBy("merchant_id").agg(
        F.max_by("item_id", F.struct(F.col("total"), -F.col("item_id"))).alias("item_id"),
        F.max("total").alias("total_quantity"))


def forecast_actual_totals(df: DataFrame, keys=("merchant_id", "item_id", "order_date"),
                           pred: str = "predicted_quantity", actual: str = "daily_quantity_sold") -> DataFrame:
    """Predicted and actual totals per item and day, rounded to 2."""
    return df.groupBy(*keys).agg(N.round2(F.sum(pred)).alias("predicted_total"),
                                 N.round2(F.sum(actual)).alias("actual_total"))


def horizon_item_totals(forecast: DataFrame, days: int, qty: str = "predicted_quantity",
                        key: str = "safe_name") -> DataFrame:
    """E17 (+G6): total per item over the first ``days`` horizon days of a forecast, in long form or with a row per item
    (``quantities``), whose days are added up before the rows are shuffled."""
    days = D.check_days(days, 1, 30)
    if "quantities" in forecast.columns:
        per_item = sum((F.coalesce(F.get("quantities", F.lit(k)).cast("long"), F.lit(0).cast("long")) for k in range(1, days)),
                       F.coalesce(F.get("quantities", F.lit(0)).cast("long"), F.lit(0).cast("long")))
        return forecast.groupBy("merchant_id", key).agg(F.sum(per_item).alias("total_quantity"))
    return (forecast.where(F.col("h") <= days)
            .groupBy("merchant_id", key).agg(F.sum(qty).cast("long").alias("total_quantity")))


def horizon_revenue_total(forecast: DataFrame, days: int, value: str = "forecasted_revenue") -> DataFrame:
    """E18 (+G6): rounded total of the first ``days`` forecast days plus the daily breakdown."""
    days = D.check_days(days, 1, 30)
    first = forecast.where(F.col("h") <= days)
    return first.groupBy("merchant_id").agg(
        F.lit(days).alias("forecast_period_days"),
        N.round2(F.sum(value)).alias("total_forecasted_sales"),
        F.array_sort(F.collect_list(F.struct(F.col("h"), F.col("forecast_date").alias("order_date"),
                                             F.col(value).alias(value)))).alias("daily_breakdown"))


def sales_kpi(item_sales_df: DataFrame, target: float = 60000.0) -> DataFrame:
    """Per merchant total of item sales against a target (``> target``)."""
    return (item_sales_df.groupBy("merchant_id")
            .agg(F.sum(F.col("total_sales").cast("decimal(20,2)")).cast("double").alias("total_sales"))
            .withColumn("target", F.lit(float(target)))
            .withColumn("above_target", F.col("total_sales") > F.col("target")))


def distinct_items(df: DataFrame, with_name: bool = False) -> DataFrame:
    """Distinct items (or distinct (id, name) pairs) per merchant."""
    cols = ["merchant_id", "item_id"] + (["item_name"] if with_name else [])
    return df.select(*cols).distinct()
