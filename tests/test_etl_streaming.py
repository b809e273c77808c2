"""K10 bootstrap ETL on hand-made CSV files, and the incremental daily summary."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stallboard.plans import etl
from stallboard.sources import files


def _write(folder, name, header, lines):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(header + "\n")
        for ln in lines:
            fh.write(ln + "\n")


def _raw(folder, orphan=False):
    # header names are ignored: columns bind by position
    _write(folder, "merchant.csv", "mid,name,jd,city", ["A0001,Alpha,1012023,1", "B0002,Beta,31122022,2"])
    _write(folder, "items.csv", "a,b,c,d,e", ["1,soup,Soup,2.50,A0001", "2,tea,Tea,3.00,B0002"])
    _write(folder, "keywords.csv", "a,b,c,d,e,f", ["1,noodles,10,,3,1"])
    _write(folder, "transaction_data.csv", "a,b,c,d,e,f,g,h,i",
           ["2,o1,2023-12-01 10:00:00,,,,9.00,7,A0001", "1,o1,2023-12-01 09:00:00,,,,7.50,7,A0001",
            "3,o2,2023-12-02 11:30:00,2023-12-02 11:40:00,2023-12-02 11:45:00,2023-12-02 12:10:00,3.00,,A0001"])
    _write(folder, "transaction_items.csv", "a,b,c,d", ["1,o1,1,A0001", "2,o2,2,A0001"] + (["3,o9,1,A0001"] if orphan else []))
    _write(folder, "new2_transaction_items.csv", "a,b,c,d", ["o1,A0001,1,3", "o1,A0001,1,3", "o2,A0001,2,1"])


def test_load_and_clean(spark):
    raw = tempfile.mkdtemp(prefix="stallboard-raw-")
    out = tempfile.mkdtemp(prefix="stallboard-clean-")
    _raw(raw)
    view = etl.load_and_clean(spark, raw, out)
    got = {(r["order_id"], r["item_id"]): r for r in view.collect()}
    assert len(got) == 2                                            # distinct quantity lines
    o1 = got[("o1", 1)]
    assert o1["order_value"] == 7.5 and o1["order_time"] == dt.datetime(2023, 12, 1, 9)   # lowest id kept
    assert float(o1["subtotal"]) == 7.5 and o1["merchant_name"] == "Alpha"
    o2 = got[("o2", 2)]
    assert o2["item_merchant_id"] == "B0002" and o2["order_merchant_id"] == "A0001"        # cross-merchant
    m = spark.read.parquet(os.path.join(out, "merchants")).orderBy("merchant_id").collect()
    assert [r["join_date"] for r in m] == [dt.date(2023, 1, 1), dt.date(2022, 12, 31)]
    kw = spark.read.parquet(os.path.join(out, "keywords")).first()
    assert kw["menu"] is None and kw["view"] == 10 and kw["checkout"] == 3   # empty field: null, not the default
    ti = spark.read.parquet(os.path.join(out, "transaction_items"))
    assert "merchant_id" not in ti.columns


def test_orphan_aborts_load(spark):
    raw = tempfile.mkdtemp(prefix="stallboard-raw-")
    out = tempfile.mkdtemp(prefix="stallboard-clean-")
    _raw(raw, orphan=True)
    with pytest.raises(ValueError):
        etl.load_and_clean(spark, raw, out)
    report = etl.audit(etl.clean_tables(files.read_raw_tables(spark, raw)))
    bad = {r["check"]: r["violations"] for r in report.where("violations > 0").collect()}
    assert bad == {"fk transaction_items.order_id->transaction_data.order_id": 1}


def test_incremental_daily_summary(spark):
    from stallboard.streaming import daily
    src = tempfile.mkdtemp(prefix="stallboard-src-")
    sink = tempfile.mkdtemp(prefix="stallboard-sink-")
    ck = tempfile.mkdtemp(prefix="stallboard-ck-")
    t = dt.datetime(2024, 1, 1, 8)
    b1 = spark.createDataFrame([(1, 10, 5.0, 2, t), (1, 10, 5.0, 1, t), (2, 10, 7.0, 1, t)],
                               "order_id bigint, order_merchant_id bigint, order_value double, quantity int, order_time timestamp_ntz") \
        .withColumn("order_value", F.col("order_value").cast("decimal(10,2)"))
    b1.write.mode("append").parquet(src)
    q = daily.start(spark, src, sink, ck)
    q.awaitTermination()
    b2 = b1.withColumn("order_id", F.col("order_id") + 10)
    b2.write.mode("append").parquet(src)
    q = daily.start(spark, src, sink, ck)
    q.awaitTermination()
    r = daily.compact(spark, sink).first()
    assert (r["total_orders"], r["total_revenue"], r["total_items"]) == (4, 34.0, 8)
    b1.write.mode("append").parquet(src)             # further lines of orders 1 and 2, in another file
    daily.start(spark, src, sink, ck).awaitTermination()
    r = daily.compact(spark, sink).first()
    assert (r["total_orders"], r["total_revenue"], r["total_items"]) == (4, 51.0, 12)


def test_month_partitions_prune_and_match(spark):
    from stallboard.functions import dates as D
    from stallboard.operators import views as V
    from stallboard.plans import sales as PS
    sf = "/root/testdata/sf0.001"
    path = os.path.join(tempfile.mkdtemp(prefix="stallboard-lines-"), "order_lines")
    etl.materialize_order_lines(V.order_lines(spark, sf), path)
    lo, hi = D.lookback_bounds("2001-08-01", 30)
    stored = etl.month_range_filter(etl.read_order_lines(spark, path), lo, hi)
    a = PS.item_sales_over_days(stored, 30, "2001-08-01")
    b = PS.item_sales_over_days(V.order_lines(spark, sf), 30, "2001-08-01")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan


def test_bucketed_daily_series_skips_shuffle(spark):
    from stallboard.operators import aggregates as A
    from stallboard.operators import views as V
    daily = A.daily_summary(V.order_lines(spark, "/root/testdata/sf0.001"))
    spark.sql("DROP TABLE IF EXISTS daily_bucketed")
    etl.bucket_by_merchant(daily, "daily_bucketed", 4)
    t = spark.table("daily_bucketed")
    agg = t.groupBy("merchant_id").agg(F.sum("total_revenue").alias("r"))
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert agg.count() == daily.select("merchant_id").distinct().count()
    spark.sql("DROP TABLE IF EXISTS daily_bucketed")
