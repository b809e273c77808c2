"""D1 / D2 without shuffling lines: order lines and orders stored in the same buckets.

Both tables are written once, bucketed and sorted by (order_id, part). A join on both columns then
reads bucket by bucket: no exchange on either side, whatever their size, for every use of the view.

Hot orders. A bucket is one task, so an order with more than ``limit`` lines would make one long: its
lines are dealt to parts 0, 1, 2, ... by a hash of the whole line (equal lines share a part), and the order itself is stored once per
part. All other orders have part 0 alone. The line counts that decide this are one aggregate
with a map-side part; only orders beyond the limit are joined back, which Spark plans by their size.

Lines without order (null or unknown order_id) are stored and meet nothing, as in the inner join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.operators import views as V

BUCKETS = 32
LIMIT = 1_000_000
PART = "order_part"


class StoredOrders:
    """Lines and orders, bucketed under ``root`` as tables of the session's catalog with names of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        own = uuid.uuid4().hex
        self.lines_table, self.orders_table = f"lines_{own}", f"orders_{own}"

    def write(self, lines: DataFrame, orders: DataFrame, buckets: int = BUCKETS, limit: int = LIMIT) -> "StoredOrders":
        hot = (lines.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
               .select("order_id", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
        spread = F.pmod(F.xxhash64(*lines.columns), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
        self._save(lines.join(hot, "order_id", "left").select(*(lines[c] for c in lines.columns), spread.alias(PART)), self.lines_table, buckets)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
        self._save(orders.join(hot, "order_id", "left").select(*(orders[c] for c in orders.columns), copies.alias(PART)), self.orders_table, buckets)
        return self

    def _save(self, rows: DataFrame, table: str, buckets: int) -> None:
        # dealt like the buckets, so each task writes few files
        (rows.repartition(buckets, "order_id", PART).write.bucketBy(buckets, "order_id", PART).sortBy("order_id", PART)
         .option("path", f"{self.root}/{table}").saveAsTable(table))

    def lines_with_orders(self) -> DataFrame:
        """Lines joined with their orders, bucket by bucket."""
        lines, orders = self.spark.table(self.lines_table), self.spark.table(self.orders_table)
        # never broadcast: a merge of sorted buckets moves nothing
        joined = lines.alias("l").join(orders.hint("merge").alias("o"), ["order_id", PART])
        own = [c for c in orders.columns if c not in ("order_id", PART) and c not in lines.columns]
        return joined.select("order_id", *(f"l.{c}" for c in lines.columns if c not in ("order_id", PART)), *(f"o.{c}" for c in own))

    def order_lines(self, items: DataFrame, merchants: DataFrame) -> DataFrame:
        """D1 over the stored pair; items and merchants are joined as in ``views.build_order_lines``."""
        both = self.lines_with_orders()
        return (both.join(items, "item_id").join(merchants, "merchant_id")
                .select("order_id", F.col("merchant_id").alias("order_merchant_id"), "item_id", "item_name", "item_price", "quantity",
                        (F.col("item_price") * F.col("quantity")).cast("decimal(12,2)").alias("subtotal"),
                        F.col("merchant_id").alias("item_merchant_id"), "merchant_name", "order_value", "order_time",
                        F.lit(None).cast("timestamp_ntz").alias("driver_arrival_time"), F.lit(None).cast("timestamp_ntz").alias("driver_pickup_time"),
                        "delivery_time", "eater_id").select(*V.ORDER_LINE_COLUMNS))
