"""Customer and sales jobs on hand-made frames (null eater, favourite tie, cross-merchant
line, multi-line order, recency edges, paging)."""

import datetime as dt

from pyspark.sql import functions as F

from stallboard.operators import aggregates as A
from stallboard.operators import filters as C
from stallboard.operators import views as V
from stallboard.plans import customers as PC
from stallboard.plans import sales as PS
from tests.conftest import rows

T0 = dt.datetime(2023, 12, 1, 10, 0)


def _frames(spark):
    merchants = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("E", "Empty")], "merchant_id string, merchant_name string")
    items = spark.createDataFrame([(1, "soup", 2.50, "A"), (2, "rice", 1.25, "A"), (3, "tea", 3.00, "B")],
                                  "item_id int, item_name string, item_price double, merchant_id string") \
        .withColumn("item_price", F.col("item_price").cast("decimal(10,2)"))
    orders = spark.createDataFrame([("o1", T0, 20.0, 7, "A"), ("o2", T0 + dt.timedelta(days=1), 5.0, None, "A"),
                                    ("o3", T0 + dt.timedelta(days=2), 3.0, 8, "A")],
                                   "order_id string, order_time timestamp_ntz, order_value double, eater_id bigint, merchant_id string") \
        .withColumn("order_value", F.col("order_value").cast("decimal(10,2)"))
    # o1 has three lines (one with B's item: cross-merchant); o3 sells tea of merchant B
    lines = spark.createDataFrame([("o1", 1, 2), ("o1", 2, 1), ("o1", 3, 1), ("o2", 1, 1), ("o3", 3, 4)],
                                  "order_id string, item_id int, quantity int")
    return merchants, items, orders, lines


def test_view_and_revenue_grains(spark):
    merchants, items, orders, lines = _frames(spark)
    ol = V.build_order_lines(lines, orders, items, merchants)
    r = rows(ol.where("order_id = 'o1' AND item_id = 3"))
    assert r[0]["order_merchant_id"] == "A" and r[0]["item_merchant_id"] == "B" and r[0]["merchant_name"] == "Beta"
    d5 = {x["order_date"]: x for x in rows(A.daily_summary(ol, "order_value_lines"))}
    d6 = {x["order_date"]: x for x in rows(A.daily_summary(ol, "subtotal"))}
    dd = {x["order_date"]: x for x in rows(A.daily_summary(ol, "order_value_distinct"))}
    day1 = T0.date()
    assert d5[day1]["total_revenue"] == 60.0                    # order value x 3 lines
    assert dd[day1]["total_revenue"] == 20.0                    # once per order
    assert d6[day1]["total_revenue"] == 2 * 2.5 + 1.25 + 3.0    # subtotals
    assert d5[day1]["total_orders"] == 1 and d5[day1]["total_items"] == 4
    m = rows(A.monthly_sales(ol))
    assert m == [{"merchant_id": "A", "month": "2023-12", "total_sales": 28.0}]


def test_item_sales_window_and_empty(spark):
    merchants, items, orders, lines = _frames(spark)
    ol = V.build_order_lines(lines, orders, items, merchants)
    k2 = rows(PS.item_sales_over_days(ol, 2, "2023-12-02"), "item_id")       # o1 and o2 only
    assert [(x["item_id"], x["total_quantity"], x["total_sales"]) for x in k2] == [(1, 3, 7.5), (2, 1, 1.25), (3, 1, 3.0)]
    empty = PS.item_sales_over_days(ol, 5, "2023-12-02", merchant_id="E")
    assert empty.count() == 0 and empty.columns == ["merchant_id", "item_id", "item_name", "total_quantity", "total_sales"]


def test_customer_list_null_eater_and_tie(spark):
    merchants, items, orders, lines = _frames(spark)
    cl = V.customer_lines(orders, lines, items)
    got = rows(PC.customer_list(cl), "customer_id")
    # eater 7: soup, rice, tea once each -> tie broken by name: rice; null eater dropped
    assert got == [{"merchant_id": "A", "customer_id": 7, "last_order_date": T0, "favorite_food": "rice"},
                   {"merchant_id": "A", "customer_id": 8, "last_order_date": T0 + dt.timedelta(days=2),
                    "favorite_food": "tea"}]


def test_recency_edges(spark):
    as_of = "2023-12-31"
    stamps = [dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 1, 0, 0, 0, 1), dt.datetime(2023, 12, 31, 23, 59, 59, 999999),
              dt.datetime(2023, 12, 31, 12), dt.datetime(2023, 11, 15), None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "customer_id int, last_order_date timestamp_ntz")
    active = sorted(r[0] for r in C.active_within(df, 30, as_of).select("customer_id").collect())
    assert active == [1, 3]                          # threshold day start and end-of-day excluded
    lapsed = sorted(r[0] for r in C.lapsed_more_than(df, 30, as_of).select("customer_id").collect())
    assert lapsed == [4]
    assert C.active_within(df, 0, as_of).count() == 6


def test_pages_concatenate_to_whole(spark):
    data = [("A", i, dt.datetime(2023, 1, 1) + dt.timedelta(hours=i % 7), f"f{i % 3}") for i in range(23)] + \
           [("B", 100 + i, dt.datetime(2023, 2, 1), "g") for i in range(4)]
    df = spark.createDataFrame(data, "merchant_id string, customer_id int, last_order_date timestamp_ntz, favorite_food string")
    order = [F.col("last_order_date").desc(), F.col("customer_id")]
    seen = []
    for p in range(3):
        pg = PC.reengagement(df, "2023-12-31", page_index=p, page_size=10)
        got = pg.where("merchant_id = 'A'").orderBy("row_number").collect()
        seen += [r["customer_id"] for r in got]
        assert all(r["page_count"] == 3 and r["row_count"] == 23 for r in got)
    whole = [r["customer_id"] for r in df.where("merchant_id = 'A'").orderBy(*order).collect()]
    assert seen == whole
    found = PC.reengagement(df, "2023-12-31", search="F2").select("customer_id").count()
    assert found == len([d for d in data if d[3] == "f2"])


def test_lookup_head_sort_suffix(spark):
    from stallboard.operators import ordering as G
    df = spark.createDataFrame([("A", 3, "b"), ("A", 1, "a"), ("B", 2, "c"), ("A", 2, "a")],
                               "merchant_id string, customer_id int, favorite_food string")
    first = C.first_by_key(df, "merchant_id", "A", order_by="customer_id").collect()
    assert [r["customer_id"] for r in first] == [1]
    assert [r["customer_id"] for r in G.head(df, 2, [F.col("customer_id").desc()]).collect()] == [3, 2]
    s = G.sort_by(df, "favorite_food", descending=False, tie_break="customer_id").collect()
    assert [(r["merchant_id"], r["customer_id"]) for r in s] == [("A", 1), ("A", 2), ("A", 3), ("B", 2)]
    wide = spark.createDataFrame([(1, 2, 3)], "order_date int, soup_pred int, tea_pred int")
    assert C.columns_with_suffix(wide) == ["soup_pred", "tea_pred"]
    best = G.best_per_group(df, ["merchant_id"], [F.col("customer_id").desc()]).orderBy("merchant_id").collect()
    assert [(r["merchant_id"], r["customer_id"]) for r in best] == [("A", 3), ("B", 2)]
