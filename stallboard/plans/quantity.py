"""Quantity forecasting jobs (K5 and the notebook models J13-J17) for all merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.session import cut_lineage, passing_table
from stallboard.stores import folders

from stallboard.functions import dates as D
from stallboard.operators import aggregates as A
from stallboard.operators import filters as C
from stallboard.operators import quantity as Q
from stallboard.operators.boosting import BoostedTrees

# merchant and item enter the panel model by their levels (see operators.quantity)
API_FEATURES = [*Q.CAL_FEATURES, *Q.LEVELS]


def training_lines(lines: DataFrame, cutoff) -> DataFrame:
    """C3 + B11: the complete lines before cutoff + 1 day, keyed by merchant."""
    kept = C.before_cutoff(lines, cutoff).dropna(subset=["order_time", "item_id", "item_name", "quantity"])
    return kept.withColumnRenamed("order_merchant_id", "merchant_id")


def training_panel(lines: DataFrame, cutoff) -> DataFrame:
    """C3 (load before cutoff + 1 day) -> B11 -> E8 -> C3 (order_date <= cutoff)."""
    loaded = C.before_cutoff(lines, cutoff).dropna(subset=["order_time", "item_id", "item_name", "quantity"])
    daily = A.daily_item_quantity(loaded, by_name=True)
    _, last = D.training_cutoff(cutoff)
    return daily.where(F.col("order_date") <= F.lit(last))


def fit_quantity_model(train: DataFrame, step_size: float = 0.3, max_iter: int = 100):
    """J12 over a training panel."""
    label = "daily_quantity_sold"
    # calendar and binned levels repeat, so the fit reads far fewer rows than the panel has
    with passing_table(Q.add_calendar(Q.add_levels(train)).select(*API_FEATURES, label)) as features:
        return Q.fit(features, API_FEATURES, label, step_size, max_iter, binned=Q.LEVELS)


def quantity_forecast(lines: DataFrame, cutoff, horizon: int = 30, step_size: float = 0.3,
                      max_iter: int = 100, model_path: str | None = None) -> DataFrame:
    """K5 = D1 -> C3 -> E8 -> J12 -> J16: long-form per-item forecasts for ``horizon`` days."""
    return Q.predicted_days(item_quantities(lines, cutoff, horizon, step_size, max_iter, model_path))


def item_quantities(lines: DataFrame, cutoff, horizon: int = 30, step_size: float = 0.3,
                    max_iter: int = 100, model_path: str | None = None) -> DataFrame:
    """K5's forecast with a row per item (``Q.horizon_quantities``), for reports that add its days up.

    With ``model_path`` the forecast is scored by the model saved there; if there is none yet, it is fitted on the same
    panel and saved there (``save_quantity_model``)."""
    D.check_days(horizon, 1, 30)
    spark = lines.sparkSession
    with passing_table(training_panel(lines, cutoff)) as train:   # feeds the levels, the fit and the horizon frame
        if model_path is None:
            model = fit_quantity_model(train, step_size, max_iter)
        else:
            if not any(name.startswith("part-") for name in folders.names(spark, model_path)):
                save_quantity_model(train, model_path, step_size, max_iter)
            model = BoostedTrees.load(spark, model_path)
        return Q.horizon_quantities(model, train, cutoff, horizon)


def save_quantity_model(train: DataFrame, path: str, step_size: float = 0.3, max_iter: int = 100) -> str:
    """J12's model, fitted on a training panel and saved under ``path``."""
    fit_quantity_model(train, step_size, max_iter).save(train.sparkSession, path)
    return path


def notebook_panel(lines: DataFrame, variant: str = "lags", item_key: str = "item_id") -> DataFrame:
    """Feature panel of J13 ('lags'), J14 ('rolling') or J15 ('encoded') with its split.

    ``item_key='item_name'`` keys the series by name: a catalogue that lists one dish under many
    ids has series of useful length only by name."""
    daily = A.daily_item_quantity(lines, by_name=False) if item_key == "item_id" else (
        A.daily_item_quantity(lines, by_name=True).groupBy("merchant_id", "order_date", F.col("item_name").alias("item_id"))
        .agg(F.sum("daily_quantity_sold").cast("long").alias("daily_quantity_sold")))
    return Q.notebook_panel(daily, with_rolling=variant in ("rolling", "encoded"))


def notebook_model(lines: DataFrame, variant: str = "lags", unseen: str = "error",
                   max_iter: int = 100, item_key: str = "item_id") -> DataFrame:
    """Calendar holdout, depth 6, rate 0.1. Returns the J17 holdout table; item and
    merchant enter by their levels (train part only), J15 also by the item's code."""
    panel = notebook_panel(lines, variant, item_key)
    numeric = Q.NB_BASE + Q.NB_LAGS + (Q.NB_ROLL if variant in ("rolling", "encoded") else [])
    if variant == "encoded":
        panel = Q.encode_items(cut_lineage(panel), unseen)  # read by the codes and the rows
        numeric = numeric + ["item_id_encoded"]
    panel = cut_lineage(panel)
    train = panel.where(F.col("split") == "train")
    test = panel.where(F.col("split") == "test")
    if train.limit(1).count() == 0:
        # no item series long enough for the lag features: a typed empty result
        return Q.holdout_results(test.withColumn("prediction", F.lit(None).cast("double")))
    model = Q.fit(Q.add_levels(train), numeric + Q.LEVELS, "daily_quantity_sold", 0.1, max_iter)
    overall = train.agg(F.avg("daily_quantity_sold")).first()[0]   # one number: for merchants unseen in training
    levels = Q.final_levels(train)
    merchants = levels.groupBy("merchant_id").agg(F.max("merchant_level").alias("_m"))
    scored = (test.join(levels.drop("merchant_level"), ["merchant_id", "item_id"], "left").join(merchants, "merchant_id", "left")
              .withColumn("merchant_level", F.coalesce(F.col("_m"), F.lit(overall)))
              .withColumn("item_level", F.coalesce("item_level", "merchant_level"))
              .withColumn("item_days", F.coalesce("item_days", F.lit(0))).drop("_m"))
    return Q.holdout_results(Q.predict(model, scored))


def holdout_rmse(results: DataFrame) -> DataFrame:
    """E20 per merchant over the J17 table."""
    from stallboard.functions import numeric as N
    return results.groupBy("merchant_id").agg(
        N.rmse(F.col("actual_quantity") - F.col("forecasted_quantity")).alias("rmse"),
        F.count(F.lit(1)).alias("n_test"))
