"""E3 / E4 / E5 / K2 / K3 / K7 from a daily state that loads of order lines are merged into.

The state holds per merchant what any range of whole days needs, so a report reads rows by the
number of days and items, not by the number of lines:

    item_days    merchant, item_id, item_name, day    quantity, sales
    order_days   merchant, day                        orders, order_value (each order once),
                                                      line_value (once per line), items
    orders       merchant, order_id                   keys that were counted already

An order has one order time, so it belongs to one day, and distinct orders add up over days; the one
thing a partial sum cannot tell is whether an order that comes again was counted by an earlier load. So
a load's orders are inserted into ``orders`` if absent (``stores.keyed``), and only those that were
absent count. All other figures are plain sums. Every load appends its partial rows, one per key,
and publishes the three tables at once; ``fold`` adds them up over any range, ``compact``
writes them as one row per key. (Bitmaps of order numbers would take 4 KB per merchant and day whatever
they hold; merchant days here have about one order.)

Money is summed as exact decimals. A batch is named; a name that was loaded before changes nothing.
Lines of one order must agree on its time and value, as they do in the order-line view; of several values the
greatest counts. Lines without order time belong to no day and are left out, lines with a null merchant or order
count each time they come.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.functions import dates as D
from stallboard.stores import folders, keyed
from stallboard.stores.versions import Published

MONEY = "decimal(30,4)"
MONTH = "state_month"
#: Rows of a month that one task adds up, about.
TASK_ROWS = 200_000
#: What a load needs of its lines.
LINE_COLUMNS = ["order_id", "order_merchant_id", "item_id", "item_name", "item_price", "quantity", "order_value", "order_time"]
ITEM_KEYS = ["merchant_id", "item_id", "item_name", "order_date"]
ORDER_KEYS = ["merchant_id", "order_date"]


def item_parts(lines: DataFrame) -> DataFrame:
    """What each of some lines adds to its (merchant, item, day)."""
    return (lines.where(F.col("order_time").isNotNull())
            .select(F.col("order_merchant_id").alias("merchant_id"), "item_id", "item_name", D.order_date("order_time").alias("order_date"),
                    F.col("quantity").cast("long").alias("quantity"), (F.col("item_price") * F.col("quantity")).cast(MONEY).alias("sales")))


def order_rows(lines: DataFrame) -> DataFrame:
    """One row per (merchant, order) of some lines."""
    return (lines.where(F.col("order_time").isNotNull())
            .groupBy(F.col("order_merchant_id").alias("merchant_id"), "order_id")
            .agg(D.order_date(F.min("order_time")).alias("order_date"), F.max("order_value").cast(MONEY).alias("order_value"),
                 F.sum(F.col("order_value").cast(MONEY)).cast(MONEY).alias("line_value"), F.sum("quantity").cast("long").alias("items"),
                 F.count(F.lit(1)).alias("lines")))


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, D.month_key("order_date"))


class DailyState:
    """The state under ``root``; ``buckets`` is the number of folders of the counted orders."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = keyed.BUCKETS):
        self.spark, self.store, self.buckets = spark, Published(spark, root), buckets

    def add(self, lines: DataFrame, batch: str) -> bool:
        """Merges the lines of one named batch; False if it was there already."""
        done = self.store.read("batches")
        if done is not None and done.where(F.col("batch") == batch).take(1):
            return False
        load = self.store.begin()
        orders = load.replace("arrived", order_rows(lines))
        lines_size, orders_size = _sizes(_month(orders), F.sum("lines"), 2 * F.count(F.lit(1)))
        load.append("item_days", *_laid(item_parts(lines), ITEM_KEYS, lines_size))
        new = keyed.insert_if_absent(load, "orders", orders.select("merchant_id", "order_id", "order_date", "order_value"),
                                     ["merchant_id", "order_id"], "order_date", self.buckets, unique=True)
        parts = orders.select(*ORDER_KEYS, F.lit(0).cast("long").alias("orders"), F.lit(0).cast(MONEY).alias("order_value"), "line_value", "items")
        first = new.select(*ORDER_KEYS, F.lit(1).cast("long").alias("orders"), "order_value",
                           F.lit(0).cast(MONEY).alias("line_value"), F.lit(0).cast("long").alias("items"))
        load.append("order_days", *_laid(parts.unionByName(first), ORDER_KEYS, orders_size))
        staged = load.tables.pop("arrived")["folders"]  # for this load alone
        load.append("batches", self.spark.createDataFrame([(batch,)], "batch string"))
        load.publish()
        for path in staged:
            folders.remove(self.spark, f"{self.store.root}/data/{path}")
        return True

    def compact(self) -> None:
        """One row per key and one folder per table; readers see either form."""
        load = self.store.begin()
        for table, keys in (("item_days", ITEM_KEYS), ("order_days", ORDER_KEYS)):
            rows = load.read(table)
            load.replace(table, *_laid(rows.drop(MONTH), keys, *_sizes(rows, F.count(F.lit(1)))))
        load.publish()

    def _days(self, table: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
        """Partial rows of the days ``first`` to ``last``; months outside are pruned."""
        out = self.store.read(table)
        for day, month, bound in ((first, ">=", ">="), (last, "<=", "<=")):
            if day is not None:
                out = out.where(F.expr(f"{MONTH} {month} '{day:%Y-%m}' AND order_date {bound} DATE '{day}'"))
        return out.drop(MONTH)

    def item_sales(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """Quantity and sales of every item sold in a range of days."""
        return (self._days("item_days", first, last).groupBy("merchant_id", "item_id", "item_name")
                .agg(F.sum("quantity").cast("int").alias("total_quantity"), F.sum("sales").cast("double").alias("total_sales")))

    def monthly_sales(self) -> DataFrame:
        """Order values by month, each order once."""
        return (self._days("order_days", None, None).groupBy("merchant_id", D.month_key("order_date").alias("month"))
                .agg(F.sum("order_value").cast("double").alias("total_sales")))

    def daily_summary(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """E5: distinct orders, revenue by line and items per day."""
        return (_add_up(self._days("order_days", first, last), ORDER_KEYS)
                .select(*ORDER_KEYS, F.col("orders").alias("total_orders"), F.col("line_value").cast("double").alias("total_revenue"),
                        F.col("items").alias("total_items")))


def _sizes(rows: DataFrame, *counts) -> list[tuple[int, int]]:
    """(of the greatest month, of all months) of each of some counts of rows: a few numbers."""
    got = rows.groupBy(MONTH).agg(*(c.alias(f"n{i}") for i, c in enumerate(counts)))
    got = got.agg(*(f(f"n{i}") for i in range(len(counts)) for f in (F.max, F.sum))).first()
    return [(got[2 * i] or 0, got[2 * i + 1] or 0) for i in range(len(counts))]


def _laid(parts: DataFrame, keys: list[str], size: tuple[int, int], task_rows: int = TASK_ROWS) -> tuple:
    """``_add_up`` with the month, for a table in folders by month: arguments of ``Load.append`` behind the table's name.

    Rows are shuffled once, by month and a hash of their key, into as many slots a month as the greatest month of
    ``size`` (``_sizes``) asks for. Equal keys meet there, so they are added up in place, and a task holds few months, so it
    writes few files: no shuffle by key before, and none by folder behind."""
    most, total = size
    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // task_rows))
    placed = _month(parts).withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-most // task_rows))))).repartition(n, MONTH, "_slot")
    return _add_up(placed, [MONTH, "_slot", *keys]).drop("_slot"), [MONTH], True


def _add_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    sums = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*(F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in sums))
