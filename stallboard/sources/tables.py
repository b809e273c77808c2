"""Logical tables of the sales model, read from the driver's parquet star schema.

Mapping (see FIXTURES.md): merchant = supplier, item = part, order = orders, order line =
lineitem. A line's merchant is its supplier, for the order side and the item side alike.
Readers only rename and cast; Catalyst prunes the columns a query does not use and pushes
filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE = "decimal(10,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("merchant_id"),
        F.col("s_name").alias("merchant_name"),
        F.col("s_nationkey").alias("city_id"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("cuisine_tag"),
        F.col("p_name").alias("item_name"),
        F.col("p_retailprice").cast(PRICE).alias("item_price"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transaction_data: one row per order."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_time"),
        F.col("o_totalprice").cast(PRICE).alias("order_value"),
        F.col("o_custkey").alias("eater_id"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new_transaction_items: one row per order line with a quantity.

    The unit-grain table of the customer job counts rows of this same table, one per line.
    """
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("merchant_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").alias("delivery_time"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")
