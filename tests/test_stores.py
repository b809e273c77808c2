"""Stored tables: keyed inserts, published versions."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stallboard.plans import etl
from stallboard.stores import folders, keyed
from stallboard.stores.versions import Published


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="stallboard-store-")


def plain_insert(stored, batch, key, order):
    """ON CONFLICT DO NOTHING in plain Python, null keys never meet."""
    have = {key(r) for r in stored if None not in key(r)}
    for r in sorted(batch, key=order):
        if None in key(r):
            stored.append(r)
        elif key(r) not in have:
            have.add(key(r))
            stored.append(r)
    return stored


def test_inserts_equal_on_conflict_do_nothing(spark, root):
    rng = random.Random(1)
    store, want = Published(spark, root), []
    for k in range(4):
        batch = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), 1000 * k + n, f"v{k}") for n in range(rng.choice([0, 80, 200]))]
        batch += [(7, "hot", 1000 * k + 500 + n, f"hot{k}") for n in range(300)]
        for _ in range(2 if k == 2 else 1):  # the third load comes twice
            load = store.begin()
            keyed.insert_if_absent(load, "t", spark.createDataFrame(batch, "x int, y string, id int, v string"), ["x", "y"], "id", buckets=8)
            load.publish()
            want = plain_insert(want, batch, lambda r: (r[0], r[1]), lambda r: r[2])
        got = [tuple(r) for r in store.read("t").drop(keyed.BUCKET).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_a_load_reads_its_own_buckets_only(spark, root):
    store = Published(spark, root)
    load = store.begin()
    keyed.insert_if_absent(load, "t", spark.range(1000).withColumn("v", F.lit(1)), ["id"], "v", buckets=16)
    load.publish()
    one = spark.range(5, 6).withColumn("v", F.lit(2))
    rows = keyed.fresh_rows(one, store.read("t"), ["id"], "v", buckets=16)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "key_bucket" in plan
    assert rows.collect() == []


def test_readers_see_whole_versions(spark, root):
    """A load that stops after any step leaves both tables of the version before; the next writer clears it away."""
    store = Published(spark, root)
    assert store.manifest() == {} and store.read("a") is None
    load = store.begin()
    load.replace("a", spark.range(3))
    load.replace("b", spark.range(3).withColumnRenamed("id", "a_id"))
    assert store.manifest() == {}
    load.publish()

    def seen():
        tables = Published(spark, root).snapshot()
        return tables["a"].count(), tables["b"].count()

    steps = [lambda x: x.replace("a", spark.range(5)), lambda x: x.append("b", spark.range(2).withColumnRenamed("id", "a_id"))]
    for stop in range(len(steps) + 1):
        broken = store.begin()
        for step in steps[:stop]:
            step(broken)
        assert seen() == (3, 3)
        if stop:
            assert store.recover() == [broken.name]
    # broken off while the manifest was being written: a file aside, no version
    fs, at = folders.file_system(spark, root)
    fs.create(at(f"{root}/published/writing-x")).close()
    assert seen() == (3, 3) and store.versions() == [1]
    late = store.begin()
    other = store.begin()
    for load in (late, other):
        for step in steps:
            step(load)
    assert late.publish() == 2 and seen() == (5, 5)
    with pytest.raises(FileExistsError):
        other.publish()
    assert seen() == (5, 5)
    assert store.read("a", 1).count() == 3
    store.expire(1)
    assert store.versions() == [2] and seen() == (5, 5)


def _tables(spark, orders, items, units=()):
    return {
        "merchants": spark.createDataFrame([("A0001", "Alpha", dt.date(2023, 1, 1), 1)], "merchant_id string, merchant_name string, join_date date, city_id int"),
        "items": spark.createDataFrame([(1, "soup", "Soup", 2.5, "A0001")], "item_id int, cuisine_tag string, item_name string, item_price double, merchant_id string")
        .withColumn("item_price", F.col("item_price").cast("decimal(10,2)")),
        "keywords": spark.createDataFrame([(1, "noodles", 1, 1, 1, 1)], "id int, keyword string, view int, menu int, checkout int, order_count int"),
        "transaction_data": spark.createDataFrame(
            [(i, o, dt.datetime(2023, 1, 1, 10), v, 7, "A0001") for i, o, v in orders],
            "id int, order_id string, order_time timestamp_ntz, order_value double, eater_id long, merchant_id string"),
        "transaction_items": spark.createDataFrame(list(units), "id int, order_id string, item_id int"),
        "new_transaction_items": spark.createDataFrame(items, "order_id string, merchant_id string, item_id int, quantity int"),
    }


def test_incremental_load_publishes_all_or_nothing(spark, root):
    store = Published(spark, root)
    first = _tables(spark, [(2, "o1", 9.0), (3, "o2", 3.0)], [("o1", "A0001", 1, 3), ("o2", "A0001", 1, 1)], [(1, "o1", 1)])
    assert etl.add_load(store, first, buckets=4) == 1
    second = _tables(spark, [(1, "o1", 7.5), (4, "o3", 4.0)], [("o3", "A0001", 1, 2), ("o1", "A0001", 1, 3)], [(1, "o1", 1), (2, "o3", 1)])
    want = {("o1", 9.0, 3), ("o2", 3.0, 1), ("o3", 4.0, 2)}  # the stored o1 stays, although the new one has a lower id
    for version in (2, 3):  # the second load comes twice
        assert etl.add_load(store, second, buckets=4) == version
        assert {(r.order_id, r.order_value, r.quantity) for r in etl.published_view(store).collect()} == want
        assert etl.published_view(store).count() == 3
    orphan = _tables(spark, [(9, "o9", 1.0)], [("o9", "A0001", 1, 2)], [(5, "missing", 1)])
    with pytest.raises(ValueError):
        etl.add_load(store, orphan, buckets=4)
    assert {(r.order_id, r.order_value, r.quantity) for r in etl.published_view(store).collect()} == want
    assert store.read("transaction_data").count() == 3
    assert sorted(os.listdir(f"{root}/published"))[-1].endswith("3")


# ------------------------------------------------------------------ daily state

LINE = "order_merchant_id long, order_id long, item_id long, item_name string, item_price decimal(10,2), quantity int, order_value decimal(10,2), order_time timestamp_ntz"


def _lines(seed, n=600):
    from decimal import Decimal
    rng = random.Random(seed)
    orders = {o: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 70)), Decimal(rng.randrange(100, 9000)) / 100) for o in range(120)}
    out = []
    for _ in range(n):
        o = rng.randrange(120) if rng.random() < 0.7 else 5  # one hot order
        t, v = orders[o]
        i = rng.randrange(6)
        out.append((rng.choice([1, 1, 1, 2]), o, i, f"item {i % 4}", Decimal(i * 100 + 50) / 100, rng.randint(1, 5), v, t))
    return out + [(3, 999, 1, "item 1", Decimal("1.5"), 2, Decimal("3.00"), None)]


def test_state_equals_the_reports_over_all_lines(spark, root):
    from stallboard.operators import aggregates as A
    from stallboard.stores.daily_state import DailyState
    rows = _lines(3)
    lines = spark.createDataFrame(rows, LINE).withColumn("subtotal", (F.col("item_price") * F.col("quantity")).cast("decimal(12,2)"))
    state = DailyState(spark, root, buckets=4)
    for k in range(3):  # orders are cut across the loads, each batch is sent twice
        part = lines.where(F.pmod(F.xxhash64("item_id", "quantity"), F.lit(3)) == k)
        assert state.add(part, f"b{k}") and not state.add(part, f"b{k}")
    timed = lines.where("order_time IS NOT NULL")

    def same(a, b):
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))

    for _ in range(2):
        same(state.daily_summary(), A.daily_summary(timed))
        same(state.monthly_sales(), A.monthly_sales(timed))
        lo, hi = dt.date(2024, 1, 20), dt.date(2024, 2, 10)
        ranged = timed.where((F.to_date("order_time") >= F.lit(lo)) & (F.to_date("order_time") <= F.lit(hi)))
        same(state.item_sales(lo, hi), A.item_sales(ranged))
        same(state.daily_summary(lo, hi), A.daily_summary(ranged))
        state.compact()
    item_days = {(r[0], r[2], r[3], r[7].date()) for r in rows if r[7]}
    assert state.store.read("item_days").count() == len(item_days)  # rows by days and items, not by lines
    plan = state.item_sales(lo, hi)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_month" in plan
    assert not [n for n in os.listdir(f"{root}/data") for t in os.listdir(f"{root}/data/{n}") if t.startswith("arrived")]


def test_state_tables_are_shuffled_once_and_the_days_lie_in_few_files(spark, root, monkeypatch):
    from stallboard.stores import daily_state, versions
    lines = spark.createDataFrame(_lines(4, 500), LINE)
    state = daily_state.DailyState(spark, f"{root}/a", buckets=4)
    plans, write = {}, versions.Load._write

    def spied(self, table, rows, partition_by, *more):
        laid = bool(more and more[0])
        plans[table] = (rows if laid or not partition_by else rows.hint("rebalance", *partition_by))._jdf.queryExecution().executedPlan().toString()
        return write(self, table, rows, partition_by, *more)

    monkeypatch.setattr(versions.Load, "_write", spied)
    state.add(lines, "b")
    state.compact()
    assert plans["item_days"].count("Exchange") == 1 and plans["order_days"].count("Exchange") == 1
    # many slots a month, null keys among them: the same sums, no key in two rows
    parts = daily_state.item_parts(lines).unionByName(daily_state.item_parts(lines.withColumn("item_id", F.lit(None).cast("long"))))
    got = daily_state._laid(parts, daily_state.ITEM_KEYS, (parts.count(), parts.count()), 7)[0].drop(daily_state.MONTH)
    want = daily_state._add_up(parts, daily_state.ITEM_KEYS)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_daily_state_loads_read_lines_joined_once(spark, monkeypatch):
    from stallboard import registry_stores as S
    from stallboard.stores.daily_state import DailyState
    from tests.conftest import SF_SMALL
    seen, add = [], DailyState.add

    def spied(self, lines, batch):
        seen.append(lines._jdf.queryExecution().executedPlan().toString())
        return add(self, lines, batch)

    monkeypatch.setattr(DailyState, "add", spied)
    monkeypatch.setattr(S, "_STATES", {})
    S._state(spark, SF_SMALL)
    assert len(seen) == 4 and not any("Join" in p for p in seen)


# ------------------------------------------------------------------ buckets

def test_buckets_join_without_exchange_and_split_hot_orders(spark, root):
    from stallboard.operators import views as V
    from stallboard.stores.co_located import PART, StoredOrders
    rng = random.Random(4)
    lines = spark.createDataFrame([(rng.choice([7, 7, rng.randrange(50), None]), 1 + n % 3, n, 1 + n % 4, None) for n in range(900)],
                                  "order_id long, merchant_id long, item_id long, quantity int, delivery_time timestamp_ntz")
    lines = lines.withColumn("item_id", F.col("item_id") % 5)
    orders = spark.createDataFrame([(o, dt.datetime(2024, 1, 1), 5.0, o) for o in range(40)], "order_id long, order_time timestamp_ntz, order_value double, eater_id long")
    items = spark.createDataFrame([(i, f"i{i}", 2.5) for i in range(5)], "item_id long, item_name string, item_price double").withColumn("item_price", F.col("item_price").cast("decimal(10,2)"))
    merchants = spark.createDataFrame([(m, f"m{m}") for m in range(1, 4)], "merchant_id long, merchant_name string")
    stored = StoredOrders(spark, root).write(lines, orders, buckets=4, limit=100)
    parts = {r.order_id: r.n for r in spark.table(stored.lines_table).groupBy("order_id").agg(F.count_distinct(PART).alias("n")).collect()}
    assert parts[7] > 1 and all(n == 1 for o, n in parts.items() if o != 7)
    both = stored.lines_with_orders()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = sorted(map(str, stored.order_lines(items, merchants).collect()))
    assert got == sorted(map(str, V.build_order_lines(lines, orders, items, merchants).select(*V.ORDER_LINE_COLUMNS).collect()))


# ------------------------------------------------------------------ page index

def test_pages_read_only_their_files(spark, root):
    from stallboard.operators import ordering as G
    from stallboard.stores import page_index as P
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "merchant_id int, score int, id int")
    order = [F.desc("score"), "id"]
    P.write_index(df, root, order, parts=16)
    for index in (0, 7, 60, 500):
        want = sorted(map(str, G.page(df, index, 20, order).select("merchant_id", "score", "id", "row_number", "row_count", "page_index", "page_count")
                          .where("merchant_id IS NOT NULL").collect()))
        got = P.pages(spark, root, index, 20).select("merchant_id", "score", "id", "row_number", "row_count", "page_index", "page_count")
        assert sorted(map(str, got.collect())) == want
        one = P.page(spark, root, index, 20, merchant_id=1)
        ranked = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[20 * index:20 * index + 20]
        assert [(r.score, r.id) for r in sorted(one.collect(), key=lambda r: r.row_number)] == [r[1:] for r in ranked]
        files = one._jdf.inputFiles()
        read = {f.split("page_part=")[1].split("/")[0] for f in one.inputFiles() if "page_part=" in f}
        assert files is not None and read is not None
        held = one.select(F.col("merchant_id")).count()
        assert held == len(ranked)
    none = P.page(spark, root, 0, 10, merchant_id=None).collect()
    assert len(none) == 10 and all(r.merchant_id is None for r in none)
    place = P.directory(spark, root).where("merchant_id = 1 AND before < 160 AND before + rows > 140").count()
    assert 1 <= place <= 2
    with pytest.raises(ValueError):
        P.page(spark, root, 0, 7, merchant_id=1)


# ------------------------------------------------------------------ postings

def test_postings_find_what_a_scan_finds(spark, root):
    from stallboard.operators import filters as C
    from stallboard.stores.postings import Postings, query_grams
    rng = random.Random(6)
    words = ["Almond", "ALMOND cake", "ca%ke", "a_b", "été", "ÉTÉ", "日本語の", "x\\y", "'quoted'", "", None, "aaa", "aaaa", "ab", "gold fish"]
    rows = [(k, " ".join(str(w) for w in rng.choices(words[:-5] + words[-3:], k=rng.randint(1, 3)) if w) or None, rng.choice(words), rng.randrange(10 ** 6)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b string, n int")
    stored = Postings(spark, root, ["id"], ["a", "b", "n"]).write(df)
    for q in ("", "a", "É", "%", "ab", "alm", "MOND", "d ca", "日本語", "x\\y", "'quo", "aaa", "aaaa", "almond c", "123", "zzzz", "été", "_", "ca%k"):
        want = sorted(r.id for r in C.search_all_columns(df, q, ["a", "b", "n"]).collect())
        assert sorted(r.id for r in stored.search(q).collect()) == want, q
    assert query_grams("aaaa") == ["aaa"] and query_grams("ab") == []
    found = stored.candidates("almond c")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan or "In(gram" in plan
    empty = Postings(spark, root + "-empty", ["id"], ["a"]).write(df.where("false"))
    assert empty.search("almond").collect() == [] and empty.search("a").collect() == []


# ------------------------------------------------------------------ selection

def test_quantiles_by_narrowing(spark):
    import numpy as np

    from stallboard.operators import selection as S
    rng = np.random.default_rng(7)
    n = 20_000
    data = {
        "hot": np.where(rng.random(n) < 0.4, 3.25, rng.normal(0, 1e-3, n)),
        "wide": np.exp(rng.normal(0, 100, n)) * rng.choice([-1, 1], n),
        "ints": rng.integers(-5, 5, n).astype(float),
        "close": 1.0 + rng.integers(0, 3, n) * 2.0 ** -52,
        "ends": np.concatenate((rng.normal(0, 1, n - 4), [-8e307, 8e307, 1e-310, -1e-320])),
        "one": np.full(n, 7.5),
    }
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(5)
    shares = {f"q{q}": q for q in (0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0)}
    got = S.quantiles(df, list(data), shares)
    for c, x in data.items():
        x = np.sort(x)
        for name, q in shares.items():
            place = (n - 1) * q
            lo, hi = x[int(np.floor(place))], x[int(np.ceil(place))]
            assert got[c][name] == lo + (place - np.floor(place)) * (hi - lo), (c, name)
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,), (float("nan"),), (1.0,), (2.0,)], "x double")
    assert S.quantiles(odd, ["x"], {"lo": 0.0, "hi": 1.0, "third": 1 / 3}) == {"x": {"lo": float("-inf"), "hi": float("inf"), "third": 1.0}}
    many = odd.crossJoin(spark.range(3000).select())
    assert S.select_places(many, {"x": [0, 2999, 3000, 5999, 6000, 11999]}) == {
        ("x", 0): float("-inf"), ("x", 2999): float("-inf"), ("x", 3000): 1.0, ("x", 5999): 1.0, ("x", 6000): 2.0, ("x", 11999): float("inf")}
    assert S.quantiles(odd.where("false"), ["x"], {"m": 0.5}) == {"x": {"m": None}}


def test_profile_of_all_columns(spark):
    from stallboard.operators import selection as S
    rows = [("b", 1, dt.date(2024, 1, 1), True), ("b", 2, None, None), ("aaa", 3, dt.date(2023, 1, 1), False), (None, None, dt.date(2023, 1, 1), True)]
    got = {r.column_name: r for r in S.profile_all(spark.createDataFrame(rows, "t string, n int, d date, f boolean")).collect()}
    assert (got["t"].type, got["t"].rows, got["t"].null_count, got["t"].distinct_count) == ("string", 4, 1, 2)
    assert (got["t"].shortest, got["t"].longest, got["t"].top, got["t"].top_count, got["t"].least) == (1, 3, "b", 2, "aaa")
    assert (got["n"].p50, got["n"].mean, got["n"].null_count, got["n"].shortest) == (2.0, 2.0, 1, None)
    assert (got["d"].least, got["d"].greatest, got["d"].top, got["f"].top_count) == ("2023-01-01", "2024-01-01", "2023-01-01", 2)
    none = S.profile_all(spark.createDataFrame([], "t string, n int")).collect()
    assert [(r.column_name, r.rows, r.distinct_count, r.p50) for r in none] == [("t", 0, 0, None), ("n", 0, 0, None)]
