"""The order-line view (D1) and the unit-grain customer lines.

One row per order line. Joins are inner, as in the relational view, so a line survives only
if its order, item and the item's merchant exist. No join strategy is forced: dimension
tables are broadcast only when the planner's size estimate (or AQE's runtime size) is
under ``spark.sql.autoBroadcastJoinThreshold``; beyond that they stay shuffle joins, and
AQE splits skewed join partitions (a hot item or merchant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.sources import tables

ORDER_LINE_COLUMNS = [
    "order_id", "order_merchant_id", "item_id", "item_name", "item_price", "quantity",
    "subtotal", "item_merchant_id", "merchant_name", "order_value", "order_time",
    "driver_arrival_time", "driver_pickup_time", "delivery_time", "eater_id",
]


#: Lines that one task of the join with their orders holds, and of the per-order aggregates behind it.
TASK_LINES = 500_000


def dealt_by_order(lines: DataFrame, task_lines: int = TASK_LINES) -> DataFrame:
    """Lines in as many partitions by order as their number asks for, at least the configured ones.

    Adaptive execution sizes a join's partitions by their bytes in the shuffle. Lines are a few bytes there, and a task that
    is full by that measure sorts and hashes some twenty times as much, once per operator: joins and aggregates by
    order run in one stage. Partitions of a given number are not joined by it (nor split: an order's lines stay
    together), and the orders follow, so no shuffle is added. The count reads the files' footers. Fewer lines than a
    task holds are left as they are."""
    rows = lines.count()
    if rows <= task_lines:
        return lines
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return lines.repartition(max(n, -(-rows // task_lines)), "order_id")


def build_order_lines(lines: DataFrame, orders: DataFrame, items: DataFrame,
                      merchants: DataFrame) -> DataFrame:
    """Join logical tables into the combined view.

    ``lines`` needs order_id, merchant_id (the order's merchant), item_id, quantity and
    optionally delivery_time; ``items`` may carry its own merchant_id (the item's merchant),
    otherwise the line's merchant stands for both.
    """
    l = lines.alias("l")
    o = orders.alias("o")
    i = items.alias("i")
    m = merchants.alias("m")
    item_merchant = F.col("i.merchant_id") if "merchant_id" in items.columns else F.col("l.merchant_id")
    j = (l.join(o, F.col("l.order_id") == F.col("o.order_id"))
          .join(i, F.col("l.item_id") == F.col("i.item_id"))
          .join(m, item_merchant == F.col("m.merchant_id")))

    def opt(frame_cols, alias, name, typ):
        return F.col(f"{alias}.{name}") if name in frame_cols else F.lit(None).cast(typ)

    return j.select(
        F.col("l.order_id").alias("order_id"),
        (F.col("o.merchant_id") if "merchant_id" in orders.columns else F.col("l.merchant_id"))
        .alias("order_merchant_id"),
        F.col("l.item_id").alias("item_id"),
        F.col("i.item_name").alias("item_name"),
        F.col("i.item_price").alias("item_price"),
        F.col("l.quantity").alias("quantity"),
        (F.col("i.item_price") * F.col("l.quantity")).cast("decimal(12,2)").alias("subtotal"),
        item_merchant.alias("item_merchant_id"),
        F.col("m.merchant_name").alias("merchant_name"),
        F.col("o.order_value").alias("order_value"),
        F.col("o.order_time").alias("order_time"),
        opt(orders.columns, "o", "driver_arrival_time", "timestamp_ntz").alias("driver_arrival_time"),
        opt(orders.columns, "o", "driver_pickup_time", "timestamp_ntz").alias("driver_pickup_time"),
        (F.col("l.delivery_time") if "delivery_time" in lines.columns
         else opt(orders.columns, "o", "delivery_time", "timestamp_ntz")).alias("delivery_time"),
        F.col("o.eater_id").alias("eater_id"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """combined_order_view over the driver's tables."""
    return build_order_lines(dealt_by_order(tables.order_items(spark, sf_dir)), tables.orders(spark, sf_dir),
                             tables.items(spark, sf_dir), tables.merchants(spark, sf_dir))


def register_order_lines(spark: SparkSession, sf_dir: str, name: str = "combined_order_view") -> DataFrame:
    """Register the view; it is expanded (not materialised) in every query that names it."""
    df = order_lines(spark, sf_dir)
    df.createOrReplaceTempView(name)
    return df


def customer_lines(orders: DataFrame, unit_lines: DataFrame, items: DataFrame) -> DataFrame:
    """Orders x unit-grain lines x items -> (merchant_id, eater_id, order_time, item_id, item_name).

    The merchant is the order's merchant (the line's supplier in the driver adapter).
    """
    o = orders.alias("o")
    u = unit_lines.alias("u")
    i = items.alias("i")
    order_merchant = F.col("o.merchant_id") if "merchant_id" in orders.columns else F.col("u.merchant_id")
    return (o.join(u, F.col("o.order_id") == F.col("u.order_id"))
             .join(i, F.col("u.item_id") == F.col("i.item_id"))
             .select(order_merchant.alias("merchant_id"), F.col("o.eater_id").alias("eater_id"),
                     F.col("o.order_time").alias("order_time"), F.col("u.item_id").alias("item_id"),
                     F.col("i.item_name").alias("item_name")))


def driver_customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_lines(tables.orders(spark, sf_dir), dealt_by_order(tables.order_items(spark, sf_dir)),
                          tables.items(spark, sf_dir))
