"""The notebook models' boosted trees (J13-J15) against Spark's own, and what their passes read."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from stallboard.operators import boosting as BT
from stallboard.operators import quantity as Q
from stallboard.plans import quantity as PQ

NAMES = ["a", "b", "c", "d"]


def _rows(spark, n=3000, nulls=False):
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 7, n), rng.integers(0, 50, n), rng.integers(0, 300, n) / 7
    y = np.where(b > 20, a, -a) + np.sin(c) * 3 + rng.integers(0, 3, n)
    data = [(int(a[k]), int(b[k]), None if nulls and k % 9 == 0 else float(c[k]), 1.5, float(y[k])) for k in range(n)]
    return spark.createDataFrame(data, "a int, b int, c double, d double, y double").repartition(5)


@pytest.mark.parametrize("nulls", [False, True])
def test_trees_are_those_of_sparks_trainer(spark, nulls):
    rows = _rows(spark, nulls=nulls)
    model = Q.fit(rows, NAMES, "y", 0.1, max_iter=12)
    got = [r["prediction"] for r in Q.predict(model, rows).orderBy(*NAMES, "y").collect()]
    # Spark finds split points of columns with NaN by another count; so it is given the bins
    points = [np.asarray(v) for v in Q.level_splits(rows, NAMES).values()]
    local = rows.orderBy(*NAMES, "y").toPandas()
    bins = BT.bins_of([local[c].to_numpy(float) for c in NAMES], points)
    given = spark.createDataFrame([(k, *map(float, bins[:, k]), float(local["y"][k])) for k in range(len(local))], "k long, a double, b double, c double, d double, y double")
    vec = VectorAssembler(inputCols=NAMES, outputCol="features").transform(given)
    theirs = GBTRegressor(featuresCol="features", labelCol="y", maxIter=12, maxDepth=6, stepSize=0.1, seed=42, maxBins=Q.MAX_BINS).fit(vec)
    want = [r["prediction"] for r in theirs.transform(vec).orderBy("k").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9
    assert len({round(x, 6) for x in got}) > 100


def test_a_null_label_is_an_error(spark):
    rows = _rows(spark, 200).withColumn("y", F.when(F.col("b") > 3, F.col("y")))
    with pytest.raises(Exception, match="label"):
        Q.fit(rows, NAMES, "y", 0.1, max_iter=2)


def test_more_tasks_than_rows_and_one_row(spark):
    one = spark.createDataFrame([(1, 2, 3.0, 1.5, 4.0)], "a int, b int, c double, d double, y double")
    model = Q.fit(one, NAMES, "y", 0.1, max_iter=3)
    assert math.isclose(Q.predict(model, one).first()["prediction"], 4.0)
    assert Q.predict(model, one.limit(0)).count() == 0


def test_a_pass_reads_bytes_of_bins_and_the_smaller_children(spark):
    """Fails where the fit keeps a row object per panel row, or reads all rows on every level."""
    rng = np.random.default_rng(1)
    bins, target = rng.integers(0, 9, (3, 500)).astype(np.uint8), rng.normal(size=500)
    tree = BT.Tree(np.zeros(3, np.intp), np.full(3, 255), np.zeros(4))
    root = next(BT.histograms(iter([(bins, target)]), tree, 0, np.zeros(1, np.intp), 9))
    feature, cut, _ = BT.best_splits(root)
    tree.feature[:1], tree.cut[:1] = feature, cut
    slots = BT.children(root, feature, cut)
    counted = next(BT.histograms(iter([(bins, target)]), tree, 1, slots, 9))
    assert bins.dtype == np.uint8 and 0 < counted[0, 0].sum() <= 250
    every = next(BT.histograms(iter([(bins, target)]), tree, 1, np.arange(2), 9))
    assert np.allclose(BT.next_level(root, slots, counted), every)


def test_encoded_panel_is_made_once(spark, monkeypatch):
    """J15's codes and rows read one written copy of the panel, not two plans of it."""
    from test_quantity_reports import _dense_lines
    seen = []
    real = Q.encode_items
    monkeypatch.setattr(Q, "encode_items", lambda panel, unseen="error": seen.append(panel._jdf.queryExecution().toString()) or real(panel, unseen))
    assert PQ.notebook_model(_dense_lines(spark, 60), "encoded", max_iter=2).count() > 0
    assert len(seen) == 1 and "Window" not in seen[0]
