"""J12's fit and the reports on its forecast: how often rows are read, and what is left on disk."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stallboard import registry
from stallboard.operators import boosting as BT
from stallboard.operators import quantity as Q
from stallboard.plans import quantity as PQ
from stallboard.session import checkpoint_dir
from stallboard.stores import folders
from test_quantity_reports import _dense_lines

CUTOFF = "2023-10-15"


def _train(spark):
    rng = random.Random(3)
    rows = [(m, i, f"item {i % 9}", dt.date(2024, 1, d), rng.randint(1, 9)) for m in (1, 2) for i in range(25) for d in rng.sample(range(1, 29), rng.randint(1, 9))]
    return spark.createDataFrame(rows, "merchant_id long, item_id long, item_name string, order_date date, daily_quantity_sold long").localCheckpoint()


def _tables(spark):
    return {x for x in folders.names(spark, checkpoint_dir(spark)) if x.startswith("table-")}


def test_a_small_fit_runs_no_job_per_level(spark):
    train = _train(spark)
    spark.sparkContext.setJobGroup("small fit", "")
    try:
        model = PQ.fit_quantity_model(train, max_iter=20)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small fit")) < 40 and len(model.trees) == 20


def test_one_task_grows_the_trees_that_jobs_grow(spark, monkeypatch):
    train = _train(spark)
    alone = PQ.fit_quantity_model(train, max_iter=4)
    monkeypatch.setattr(BT, "ALONE_ROWS", 0)
    jobs = PQ.fit_quantity_model(train, max_iter=4)
    rows = Q.add_calendar(Q.add_levels(train))
    a, b = ([r["prediction"] for r in Q.predict(m, rows).orderBy("merchant_id", "item_id", "order_date").collect()] for m in (alone, jobs))
    assert max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-9


def test_equal_splits_are_taken_by_place_in_any_order_of_the_rows():
    import numpy as np
    rng = np.random.default_rng(2)
    day = rng.integers(0, 40, 300)
    bins = np.stack([day % 7, day // 7, day, rng.integers(0, 9, 300)]).astype(np.uint8)
    label, weight = rng.integers(0, 9, 300) / 3, rng.integers(1, 5, 300).astype(float)
    unseen = np.stack([rng.integers(0, 9, 5000) for _ in range(4)]).astype(np.uint8) * np.array([[1], [1], [5], [1]], np.uint8)
    found = []
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(300)
        trees = BT.grow_alone(iter([(np.ascontiguousarray(bins[:, order]), label[order], weight[order])]), 12, 0.3, 6, 40)
        found.append(sum(t.leaf.take(BT.route(unseen, t, 6)) for t in trees))
    assert np.allclose(found[0], found[1], atol=1e-9) and np.allclose(found[0], found[2], atol=1e-9)


def test_weighted_rows_count_as_often_as_they_occur(spark):
    rows = spark.createDataFrame([(k % 3, float(k % 5), float(k % 7)) if k % 11 else (k % 3, None, None) for k in range(400)], "a int, b double, label double")
    splits = Q.level_splits(rows, ["a", "b"])
    got = BT.distinct(rows, ["a", "b"], splits).collect()
    labelled = [(r.a, r.b) for r in rows.collect() if r.label is not None]
    assert sum(r.weight for r in got) == len(labelled) and len(got) == len(set(labelled)) == 15


def test_a_saved_model_is_the_same_number_for_number(spark, tmp_path):
    train = _train(spark)
    path = PQ.save_quantity_model(train, str(tmp_path / "model"), max_iter=3)
    kept, fresh = BT.BoostedTrees.load(spark, path), PQ.fit_quantity_model(train, max_iter=3)
    assert kept.inputs == fresh.inputs and kept.step_size == fresh.step_size and len(kept.trees) == 3
    rows = Q.add_calendar(Q.add_levels(train)).orderBy("merchant_id", "item_id", "order_date")
    assert Q.predict(kept, rows).collect() == Q.predict(BT.BoostedTrees.load(spark, path), rows).collect()


def test_items_share_a_place_where_the_model_sees_them_alike(spark):
    train = _train(spark)
    model = PQ.fit_quantity_model(train, max_iter=3)
    places = Q.horizon_items(train).withColumn("place", model.place(Q.LEVELS))
    again = places.select("place", *model.values_at("place", Q.LEVELS)).withColumn("again", model.place(Q.LEVELS))
    assert again.where("place <> again").count() == 0 and places.select("place").distinct().count() > 5


def test_the_panel_is_made_once_for_the_fit_and_the_forecast(spark, tmp_path, monkeypatch):
    """The fit of the saved model had a panel, and so an order-line join, of its own; what served the fit stayed on disk."""
    lines, made = _dense_lines(spark, 60), []
    panel = PQ.training_panel
    monkeypatch.setattr(registry, "CUTOFF", CUTOFF)
    monkeypatch.setattr(registry.V, "order_lines", lambda *a: lines)
    monkeypatch.setattr(PQ, "training_panel", lambda *a: made.append(1) or panel(*a))
    fit = PQ.fit_quantity_model
    monkeypatch.setattr(PQ, "fit_quantity_model", lambda train, step_size=0.3, max_iter=100: fit(train, step_size, 3))
    before = _tables(spark)
    wide = registry.e16_wide_forecast_records(spark, str(tmp_path))
    assert wide.count() == 2 * 30 and len(made) == 1
    assert len(_tables(spark) - before) == 2  # the items and their days, which the records read


def test_shuffles_of_a_written_table_are_dropped(spark):
    import glob
    import os

    from stallboard.session import DROP_SHUFFLES, table_of
    made = table_of(_train(spark).repartition(3).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = sum((glob.glob(f"{d.toString()}/**/*.data", recursive=True) for d in store.localDirs()), [])
    table_of(_train(spark).repartition(3).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))
    after = sum((glob.glob(f"{d.toString()}/**/*.data", recursive=True) for d in store.localDirs()), [])
    assert {os.path.basename(f) for f in after} <= {os.path.basename(f) for f in left} and made.count() == 25
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_wide_records_of_items_are_those_of_their_days(spark):
    rng = random.Random(5)
    for horizon in (1, 5, 7, 30):
        rows = [(m, i, f"item {i}", f"item_{i % 4}", dt.date(2024, 2, 1), [rng.choice([0, 3, None]) if i % 4 == 1 else rng.randint(0, 9) for _ in range(horizon)])
                for m in (1, 2) for i in range(12)]
        forecast = spark.createDataFrame(rows, "merchant_id long, item_id long, item_name string, safe_name string, first_day date, quantities array<int>")
        got, want = Q.wide_records(forecast), Q.long_records(forecast).groupBy("merchant_id", "order_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_key", "quantity")))).alias("predictions"))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted((r.merchant_id, r.order_date, list(r.predictions.items())) for r in got.collect()) == sorted((r.merchant_id, r.order_date, list(r.predictions.items())) for r in want.collect())
        assert got.count() == 2 * horizon
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # days come after the last shuffle


def test_the_bundle_joins_its_lines_once(spark, tmp_path, monkeypatch):
    """Months, items, revenue and quantities each joined all lines with their orders."""
    lines, made = _dense_lines(spark, 60), []
    monkeypatch.setattr(registry, "CUTOFF", CUTOFF)
    monkeypatch.setattr(registry, "AS_OF", "2023-07-30")
    monkeypatch.setattr(registry.V, "order_lines", lambda *a: made.append(1) or lines)
    fit = PQ.fit_quantity_model
    monkeypatch.setattr(PQ, "fit_quantity_model", lambda train, step_size=0.3, max_iter=100: fit(train, step_size, 3))
    got = {r.merchant_id: r for r in registry.k7_dashboard_bundle(spark, str(tmp_path)).collect()}
    assert len(made) == 1 and set(got) == {"A", "B"}
    months, items = registry._k3(spark, ""), registry._k2(spark, "")
    assert {m: [tuple(x) for x in r.monthly_sales] for m, r in got.items()} == {m: sorted((r.month, r.total_sales) for r in months.where(F.col("merchant_id") == m).collect()) for m in got}
    assert {(m, *x) for m, r in got.items() for x in r["items"]} == {tuple(r) for r in items.collect()}
    assert all(len(r.revenue_forecast) == 30 and set(r.forecast_quantities) for r in got.values())
