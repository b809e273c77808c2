"""Declared table schemas (A2) and the constraint list the audits check.

Spark does not enforce keys or NOT NULL, so the constraints are data here and are checked
by ``operators.cleaning``.
"""

from pyspark.sql import types as T

MERCHANTS_RAW = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_name", T.StringType()),
    T.StructField("join_date", T.StringType()),      # text such as 1012023 until B4/B5
    T.StructField("city_id", T.IntegerType()),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.IntegerType()),
    T.StructField("cuisine_tag", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_price", T.DecimalType(10, 2)),
    T.StructField("merchant_id", T.StringType()),
])

KEYWORDS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("view", T.IntegerType()),
    T.StructField("menu", T.IntegerType()),
    T.StructField("checkout", T.IntegerType()),
    T.StructField("order_count", T.IntegerType()),
])

TRANSACTION_DATA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("order_time", T.TimestampNTZType()),
    T.StructField("driver_arrival_time", T.TimestampNTZType()),
    T.StructField("driver_pickup_time", T.TimestampNTZType()),
    T.StructField("delivery_time", T.TimestampNTZType()),
    T.StructField("order_value", T.DecimalType(10, 2)),
    T.StructField("eater_id", T.LongType()),
    T.StructField("merchant_id", T.StringType()),
])

# unit grain: one row per unit sold; the raw file also carries merchant_id (dropped by B3)
TRANSACTION_ITEMS_RAW = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("merchant_id", T.StringType()),
])

# quantity grain: one row per (order, item) with a quantity; no key at all
NEW_TRANSACTION_ITEMS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("quantity", T.IntegerType()),
])

RAW_SCHEMAS = {
    "merchants": MERCHANTS_RAW,
    "items": ITEMS,
    "keywords": KEYWORDS,
    "transaction_data": TRANSACTION_DATA,
    "transaction_items": TRANSACTION_ITEMS_RAW,
    "new_transaction_items": NEW_TRANSACTION_ITEMS,
}

# Declared constraints of the relational schema.
# table -> list of (column, max_length or None) that are NOT NULL
NOT_NULL = {
    "merchants": [("merchant_id", 5), ("merchant_name", 255), ("join_date", None)],
    "items": [("item_id", None), ("cuisine_tag", 100), ("item_name", 255), ("item_price", None),
              ("merchant_id", 5)],
    "keywords": [("id", None), ("keyword", 100)],
    "transaction_data": [("id", None), ("order_id", 100), ("order_time", None),
                         ("order_value", None), ("merchant_id", 5)],
    "transaction_items": [("id", None), ("order_id", 100), ("item_id", None)],
}
# columns in the NOT_NULL lists whose length limit applies but which may be null
NULLABLE = {("items", "cuisine_tag")}
# table -> key columns that must be unique
UNIQUE_KEYS = {
    "merchants": ["merchant_id"],
    "items": ["item_id"],
    "keywords": ["id"],
    "transaction_data": ["id"],
    "transaction_data#order_id": ["order_id"],
    "transaction_items": ["id"],
}
# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("items", "merchant_id", "merchants", "merchant_id"),
    ("transaction_data", "merchant_id", "merchants", "merchant_id"),
    ("transaction_items", "order_id", "transaction_data", "order_id"),
    ("transaction_items", "item_id", "items", "item_id"),
]
