"""Customer jobs: K1 customer list and K6 re-engagement list, for every merchant at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.operators import filters as C
from stallboard.operators import ordering as G
from stallboard.operators.filters import merchant_filter


def customer_list(cl: DataFrame, merchant_id=None) -> DataFrame:
    """K1: per (merchant, customer) the last order time and the favourite item name.

    D2 lines -> E2 counts per (merchant, eater, name) -> one aggregate per (merchant, eater)
    that takes the max order time (E1) and the name with the largest count, ties to the
    smallest name (F1 + D3). Two hash aggregates with map-side combine replace the
    reference's window + self join: a merchant with a third of all lines is spread over its
    eaters, and a heavy eater is bounded by its number of distinct item names.
    Null eater ids are grouped and then dropped, as the SQL equality join drops them.
    Output order (G1, newest first) is left to ``order_customers``.
    """
    cl = merchant_filter(cl, merchant_id)
    per_name = cl.groupBy("merchant_id", "eater_id", "item_name").agg(
        F.count(F.lit(1)).alias("item_count"), F.max("order_time").alias("last_time"))
    return (per_name.where(F.col("eater_id").isNotNull())
            .groupBy("merchant_id", "eater_id")
            .agg(F.max("last_time").alias("last_order_date"),
                 F.min_by("item_name", F.struct(-F.col("item_count"), F.col("item_name"))).alias("favorite_food"))
            .select("merchant_id", F.col("eater_id").alias("customer_id"), "last_order_date", "favorite_food"))


def order_customers(df: DataFrame) -> DataFrame:
    """G1: newest last order first; customer_id breaks ties."""
    return df.orderBy("merchant_id", F.desc("last_order_date"), "customer_id")


def reengagement(customers: DataFrame, as_of, active_days=None, lapsed_days=None, search=None,
                 sort_col: str = "last_order_date", descending: bool = True,
                 page_index: int | None = None, page_size: int = 10) -> DataFrame:
    """K6: K1 -> C5 (active within) / C6 (lapsed for more than) -> C7 search -> G8 sort -> G7 page."""
    df = customers
    if active_days:
        df = C.active_within(df, active_days, as_of)
    if lapsed_days:
        df = C.lapsed_more_than(df, lapsed_days, as_of)
    df = C.search_all_columns(df, search, ["customer_id", "last_order_date", "favorite_food"])
    c = F.col(sort_col)
    order = [c.desc() if descending else c.asc(), F.col("customer_id").asc()]
    if page_index is None:
        return df
    return G.page(df, page_index, page_size, order)
