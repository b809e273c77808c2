"""Sales jobs for all merchants at once: K2 item sales, K3 monthly sales, daily summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.functions import dates as D
from stallboard.operators import aggregates as A
from stallboard.operators.filters import merchant_filter


def item_sales_over_days(lines: DataFrame, days: int, as_of, merchant_id=None) -> DataFrame:
    """K2: D1 -> C1 + C2 -> E3 -> C4.

    The time range is two constants, so the filter reaches the orders scan as pushed
    parquet filters; the merchant filter, when given, reaches the lineitem scan.
    Ordering (G2) is left to the caller (``order_items_by_quantity``).
    """
    lo, hi = D.lookback_bounds(as_of, days)
    sel = merchant_filter(lines, merchant_id, "order_merchant_id").where(
        (F.col("order_time") >= D.ntz_lit(lo)) &
        (F.col("order_time") <= D.ntz_lit(hi)))
    return A.item_sales(sel).where(F.col("total_quantity") > 0)


def order_items_by_quantity(df: DataFrame) -> DataFrame:
    """Quantity desc; ties broken by item_id."""
    return df.orderBy("merchant_id", F.desc("total_quantity"), "item_id")


def monthly_sales(lines: DataFrame, merchant_id=None) -> DataFrame:
    """K3: D1 -> C1 -> E4 (G3 ascending months is ``.orderBy('merchant_id', 'month')``)."""
    return A.monthly_sales(merchant_filter(lines, merchant_id, "order_merchant_id"))


def daily_summary(lines: DataFrame, revenue: str = "order_value_lines", merchant_id=None) -> DataFrame:
    """E5 / E6 for all merchants."""
    return A.daily_summary(merchant_filter(lines, merchant_id, "order_merchant_id"), revenue)
