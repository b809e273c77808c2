"""Cleaning and audits (B-family) on the hand-made frames of FIXTURES.md."""

import datetime as dt

from stallboard.operators import cleaning as B
from tests.conftest import rows


def test_keep_first_lowest_id(spark):
    df = spark.createDataFrame([(2, "o1", 9.5), (1, "o1", 7.0), (3, "o2", 1.0)], "id int, order_id string, order_value double")
    got = rows(B.keep_first(df, "order_id", "id"), "order_id")
    assert got == [{"id": 1, "order_id": "o1", "order_value": 7.0}, {"id": 3, "order_id": "o2", "order_value": 1.0}]


def test_distinct_lines(spark):
    df = spark.createDataFrame([("o", "m", 1, 2), ("o", "m", 1, 2), ("o", "m", 1, 3), (None, "m", 1, 2), (None, "m", 1, 2)],
                               "order_id string, merchant_id string, item_id int, quantity int")
    assert B.distinct_rows(df).count() == 3            # nulls compare equal


def test_join_date_conversion(spark):
    df = spark.createDataFrame([("a", "1012023"), ("b", "01012023"), ("c", "31122022"), ("d", "x")],
                               "merchant_id string, join_date string")
    got = {r["merchant_id"]: r["join_date"] for r in B.clean_join_date(df).collect()}
    assert got == {"a": dt.date(2023, 1, 1), "b": dt.date(2023, 1, 1), "c": dt.date(2022, 12, 31), "d": None}
    assert dict(B.clean_join_date(df).dtypes)["join_date"] == "date"


def test_snake_case_and_dedupe(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Order Time` int, itemID int, `order-time` int")
    assert B.snake_case_columns(df).columns == ["order_time", "item_id", "order_time_1"]
    dup = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    out = B.dedupe_column_names(dup)
    assert out.columns == ["a", "b"] and tuple(out.first()) == (1, 2)


def test_audits(spark):
    merchants = spark.createDataFrame([("m1", "Shop", "01012023"), ("m1", None, "1012023")],
                                      "merchant_id string, merchant_name string, join_date string")
    a = {r["column_name"]: (r["null_count"], r["too_long_count"]) for r in B.null_length_audit(merchants, "merchants").collect()}
    assert a == {"merchant_id": (0, 0), "merchant_name": (1, 0), "join_date": (0, 0)}
    u = B.unique_audit(merchants, ["merchant_id"]).first()
    assert (u["duplicated_keys"], u["surplus_rows"]) == (1, 1)
    items = spark.createDataFrame([(1, "m1"), (2, "zz"), (3, None)], "item_id int, merchant_id string")
    fk = B.foreign_key_audit(items, "merchant_id", merchants, "merchant_id").first()["orphan_rows"]
    assert fk == 1
    import pytest
    with pytest.raises(ValueError):
        B.require_clean(B.foreign_key_audit(items, "merchant_id", merchants, "merchant_id"), "orphan_rows")


def test_nulls_and_coercion(spark):
    df = spark.createDataFrame([("12",), ("x",), ("",), (None,), (" 3.5 ",)], "v string")
    got = [r[0] for r in df.select(B.coerce_numeric("v")).collect()]
    assert got[0] == 12.0 and got[1] is None and got[2] is None and got[3] is None
    lines = spark.createDataFrame([(None, 1, "a", 1), (dt.datetime(2024, 1, 1), None, "a", 1),
                                   (dt.datetime(2024, 1, 1), 1, None, 1), (dt.datetime(2024, 1, 1), 1, "a", None),
                                   (dt.datetime(2024, 1, 1), 1, "a", 2)],
                                  "order_time timestamp_ntz, item_id int, item_name string, quantity int")
    assert B.drop_null_rows(lines, ["order_time", "item_id", "item_name", "quantity"]).count() == 1
    audit = {r["column_name"]: r["null_count"] for r in B.dtype_null_audit(lines).collect()}
    assert audit == {"order_time": 1, "item_id": 1, "item_name": 1, "quantity": 1}


def test_profile(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, 4.0, None]], "v double")
    p = B.profile(df).first()
    assert (p["n"], p["null_count"], p["mean"], p["p0"], p["p50"], p["p100"]) == (4, 1, 2.5, 1.0, 2.5, 4.0)
    assert abs(p["sd"] - 1.2909944487) < 1e-9 and p["p25"] == 1.75
