"""Per-item daily quantity models.

The reference trains one boosted-tree model per merchant in one process, with the item as a
category. Here one distributed model is trained over the whole (merchant, item, day) panel by
``operators.boosting``, which grows the trees of Spark's ``GBTRegressor``; where binned rows repeat (J12), over the
distinct ones. A category with millions of values cannot be binned, so an item enters by its own level:
the mean and count of its quantities on *earlier* days, shrunk towards its merchant's level, and
the merchant by its mean on earlier days (``add_levels``). A row's own quantity is never part
of its features; a forecast uses the levels of the whole training part (``final_levels``). The
number of items does not limit how finely they are told apart: levels are ordered numbers in
``MAX_BINS`` bins. Tree training aggregates histograms per partition and merges them, so it
scales with the panel; the residuals are checkpointed to the shared folder every 10 trees.

Hyper-parameters follow the reference (100 trees, depth 6, learning rate 0.3 for the API
model and 0.1 for the notebook models, seed 42, squared error). xgboost's own histogram
trainer (regularisation lambda, child weight) is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallboard.session import cut_lineage, table_of

from stallboard.functions import dates as D
from stallboard.functions import labels as L
from stallboard.functions import numeric as N
from stallboard.functions import text as T
from stallboard.operators import boosting
from stallboard.operators.boosting import BoostedTrees

CAL_FEATURES = ["weekday", "month", "day", "year", "day_of_year"]
NB_BASE = ["day_of_week", "day_of_year", "month", "year", "is_weekend"]
NB_LAGS = ["lag_1", "lag_7"]
NB_ROLL = ["rolling_mean_3", "rolling_mean_7"]


def add_calendar(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """I5 + I7: weekday (ISO), month, day, year, day_of_year."""
    for name, c in D.date_parts(date_col).items():
        df = df.withColumn(name, c)
    return df


def add_notebook_calendar(df: DataFrame, date_col: str = "order_date", weekend_from: int = 5) -> DataFrame:
    """Notebook features: ISO day_of_week, day_of_year, month, year, is_weekend (I8)."""
    return (df.withColumn("day_of_week", D.iso_weekday(date_col))
              .withColumn("day_of_year", F.dayofyear(date_col))
              .withColumn("month", F.month(date_col))
              .withColumn("year", F.year(date_col))
              .withColumn("is_weekend", D.is_weekend(date_col, weekend_from)))


LEVELS = ["item_level", "item_days", "merchant_level"]
PRIOR_DAYS = 3.0
MAX_BINS = 128


def _shrunk(total, days, prior):
    return (F.coalesce(total, F.lit(0.0)) + PRIOR_DAYS * prior) / (F.coalesce(days, F.lit(0)) + PRIOR_DAYS)


def add_levels(panel: DataFrame, label: str = "daily_quantity_sold", keys=("merchant_id", "item_id"),
               order: str = "order_date") -> DataFrame:
    """Features of J12-J15 that tell items and merchants apart, from earlier days only.

    The item's running sum and count are windows over its own series; the merchant's come from
    its daily totals (one row per trading day) joined back on (merchant, day), so no window
    spans a merchant's whole item-day panel. Before a merchant's first day the level is 0."""
    keys = list(keys)
    y = F.col(label).cast("double")
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    days = Window.partitionBy(keys[0]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_day = panel.groupBy(keys[0], order).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    merchant = per_day.select(keys[0], order, F.coalesce(F.try_divide(F.sum("_s").over(days), F.sum("_c").over(days)),
                                                         F.lit(0.0)).alias("merchant_level"))
    return (panel.withColumn("_is", F.sum(y).over(earlier)).withColumn("item_days", F.count(y).over(earlier))
            .join(merchant, [keys[0], order])
            .withColumn("item_level", _shrunk(F.col("_is"), F.col("item_days"), F.col("merchant_level"))).drop("_is"))


def final_levels(panel: DataFrame, label: str = "daily_quantity_sold", keys=("merchant_id", "item_id")) -> DataFrame:
    """(keys, item_level, item_days, merchant_level) over the whole training part, for scoring."""
    keys = list(keys)
    y = F.col(label).cast("double")
    merchant = panel.groupBy(keys[0]).agg(F.avg(y).alias("merchant_level"))
    return (panel.groupBy(*keys).agg(F.sum(y).alias("_is"), F.count(y).alias("item_days")).join(merchant, keys[0])
            .withColumn("item_level", _shrunk(F.col("_is"), F.col("item_days"), F.col("merchant_level"))).drop("_is"))


SPLIT_SAMPLE = 16384


def level_splits(values: DataFrame, columns: list[str], bins: int = MAX_BINS, seed: int = 42) -> dict[str, list[float]]:
    """Split points of each column as Spark's trees find them: between neighbouring values, ``bins`` - 1 at most, by equal
    shares of a sample of max(bins^2, 10000) rows (all rows, if there are no more). The sample, bounded like Spark's own, comes to the driver."""
    import numpy as np
    wanted = max(bins * bins, SPLIT_SAMPLE)
    n = values.count()
    sample = values.select(*columns) if n <= wanted else values.select(*columns).sample(False, wanted / n, seed)
    rows = np.asarray([[np.nan if v is None else v for v in r] for r in sample.collect()], dtype=float).reshape(-1, len(columns))
    out = {}
    for j, c in enumerate(columns):
        found, counts = np.unique(rows[:, j][~np.isnan(rows[:, j])], return_counts=True)
        middle = (found[:-1] + found[1:]) / 2
        if len(middle) >= bins:
            stride = counts.sum() / bins
            reached, target, picked = np.cumsum(counts), stride, []
            for i in range(1, len(found)):
                if abs(reached[i - 1] - target) < abs(reached[i] - target):
                    picked.append(middle[i - 1])
                    target += stride
            middle = np.asarray(picked)
        out[c] = sorted(set(middle.tolist()))
    return out


def fit(train: DataFrame, features: list[str], label: str, step_size: float, max_iter: int = 100,
        max_depth: int = 6, seed: int = 42, binned: list[str] = ()) -> BoostedTrees:
    """J12-J15 training over the panel (one distributed fit).

    Features are made once and the (features, label) frame is checkpointed, as the split points and the bins both read it.

    With ``binned`` features, rows that are alike in the ``MAX_BINS`` bins that the trees divide every feature into are one
    row, with their mean label and their number as its weight: every sum that a tree compares stays what it was, but
    a pass reads distinct rows only; ``train`` is then read as it is, so it should be a written table. Without, rows are not
    taken to repeat."""
    inputs = list(dict.fromkeys(features))
    rows = train.select(*inputs, F.col(label).cast("double").alias("label"))
    if not binned:
        rows = cut_lineage(rows)
    splits = level_splits(rows, inputs, seed=seed)
    if binned:
        rows = cut_lineage(boosting.distinct(rows, inputs, splits))
    return boosting.fit(rows, inputs, splits, rows.count(), step_size, max_iter, max_depth)


def predict(model: BoostedTrees, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, "prediction")


# ------------------------------------------------------------------ API model

def name_map(daily: DataFrame) -> DataFrame:
    """One name per (merchant, item): the last one seen (latest date, then largest name)."""
    return daily.groupBy("merchant_id", "item_id").agg(
        F.max_by("item_name", F.struct("order_date", "item_name")).alias("item_name"))


def horizon_items(daily_train: DataFrame, levels: bool = True, more=()) -> DataFrame:
    """The items seen in training with display name (D8), key, levels (if asked for) and the aggregates ``more``, in one
    aggregate per item.

    The daily rows are dealt by item into a given number of partitions, which AQE does not coalesce, so what a job does per
    item next (the fan-out, a join by item) needs no shuffle at horizon size and is spread over all tasks."""
    keys = ["merchant_id", "item_id"]
    y = F.col("daily_quantity_sold").cast("double")
    name = F.coalesce(F.col("item_name"), F.concat(F.lit("UnknownID_"), F.col("item_id").cast("string")))
    dealt = daily_train.repartition(2 * int(daily_train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)
    items = dealt.groupBy(*keys).agg(F.max_by("item_name", F.struct("order_date", "item_name")).alias("item_name"),
                                     F.sum(y).alias("_is"), F.count(y).alias("item_days"), *more)
    if levels:
        merchant = daily_train.groupBy("merchant_id").agg(F.avg(y).alias("merchant_level"))
        items = items.join(merchant, "merchant_id").withColumn("item_level", _shrunk(F.col("_is"), F.col("item_days"), F.col("merchant_level")))
    else:
        items = items.drop("item_days")
    return items.drop("_is").withColumn("item_name", name).withColumn("safe_name", T.safe_key("item_name"))


def fan_out(items: DataFrame, cutoff, horizon: int = 30) -> DataFrame:
    """D6 over rows that hold items once: each row explodes its own dates and ``h`` from 1 on -- a bounded fan-out, no join."""
    dates = D.date_sequence(F.date_add(F.lit(D.as_date(cutoff)), 1), horizon)
    return items.select("*", F.posexplode(dates).alias("_h0", "order_date")).withColumn("h", F.col("_h0") + 1).drop("_h0")


def horizon_frame(daily_train: DataFrame, cutoff, horizon: int = 30, with_names: bool = False) -> DataFrame:
    """Every (date, item) pair for the ``horizon`` days after ``cutoff``, per merchant, over
    the items seen in training. Each distinct item row explodes its own date sequence -- a
    bounded fan-out per item, no join. With ``with_names`` the item's display name (D8) is
    and its levels for scoring are attached to the distinct items *before* the fan-out, so nothing is joined or shuffled at
    horizon size."""
    items = horizon_items(daily_train) if with_names else daily_train.select("merchant_id", "item_id").distinct()
    # the distinct items are few bytes, so AQE would coalesce them into a handful of
    # partitions; the fan-out then multiplies the rows (and the scoring) by ``horizon``,
    # so spread them explicitly (a count-only repartition: neither elided as redundant nor
    # coalesced by AQE; Spark sorts before it, so a retried task sees the same rows)
    items = items.repartition(2 * int(daily_train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    extra = ["item_name", "safe_name", *LEVELS] if with_names else []
    return fan_out(items.select("merchant_id", "item_id", *extra), cutoff, horizon)


def horizon_quantities(model: BoostedTrees, daily_train: DataFrame, cutoff, horizon: int = 30) -> DataFrame:
    """J16 with a row per item: (merchant_id, item_id, item_name, safe_name, first_day, quantities), the quantities of the
    ``horizon`` days from ``first_day`` on. ``predicted_days`` has them as rows.

    The model sees an item by the bins of its levels alone, and many items share them, so the model scores
    every day once per combination of bins; the items join the list of their combination's days. That list is written: where
    it is small, the planner knows it, and no item is shuffled."""
    # read twice: its bins, and the items themselves
    items = table_of(horizon_items(daily_train).withColumn("place", model.place(LEVELS)).drop(*LEVELS))
    n = 2 * int(daily_train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # few bytes, which AQE would leave to a handful of tasks, but scoring is CPU-heavy
    places = items.select("place").distinct().repartition(n)
    grid = fan_out(places.select("place", *model.values_at("place", LEVELS)), cutoff, horizon)
    scored = predict(model, add_calendar(grid)).select("place", "h", N.nonneg_int("prediction").alias("predicted_quantity"))
    # one value per day of the horizon
    days = table_of(scored.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "predicted_quantity"))), lambda x: x["predicted_quantity"]).alias("quantities")))
    return items.join(days, "place").select("merchant_id", "item_id", "item_name", "safe_name",
                                           F.date_add(F.lit(D.as_date(cutoff)), 1).alias("first_day"), "quantities")


def predicted_days(forecast: DataFrame) -> DataFrame:
    """The long form of a forecast with a row per item: (merchant_id, h, order_date, item_id, item_name, safe_name, predicted_quantity)."""
    return (forecast.select("*", F.posexplode("quantities").alias("_h0", "predicted_quantity"))
            .select("merchant_id", (F.col("_h0") + 1).alias("h"), F.date_add("first_day", F.col("_h0")).alias("order_date"), "item_id", "item_name",
                    "safe_name", "predicted_quantity"))


def horizon_forecast(model: BoostedTrees, daily_train: DataFrame, cutoff, horizon: int = 30) -> DataFrame:
    """J16 in long form: (merchant_id, h, order_date, item_id, item_name, safe_name,
    predicted_quantity), prediction = max(0, round half to even) as int (I21). Items without
    a known name would show as 'UnknownID_<id>' (D8's fallback)."""
    return predicted_days(horizon_quantities(model, daily_train, cutoff, horizon))


def _summed_names(forecast: DataFrame, horizon: int) -> DataFrame:
    """A row per (merchant, name) of a forecast with a row per item: its ``horizon`` quantities added up, null beyond the last."""
    sums = [F.sum(F.get("quantities", F.lit(k))).cast("long") for k in range(horizon)]
    return forecast.groupBy("merchant_id", "first_day", T.add_suffix("safe_name").alias("record_key")).agg(F.array(*sums).alias("_sums"))


def long_records(forecast: DataFrame, horizon: int = 30) -> DataFrame:
    """E16 as rows: (merchant_id, order_date, '<safe_name>_pred', quantity). Items whose safe names
    collide are summed (the reference keeps the last one). The form for catalogues of any size.

    ``forecast`` is in long form or has a row per item with its ``horizon`` quantities; the latter are added up per name
    before they become days, so nothing is shuffled at horizon size."""
    if "quantities" not in forecast.columns:
        return (forecast.groupBy("merchant_id", "order_date", T.add_suffix("safe_name").alias("record_key"))
                .agg(F.sum("predicted_quantity").cast("long").alias("quantity")))
    return (_summed_names(forecast, horizon).select("merchant_id", "first_day", "record_key", F.posexplode("_sums").alias("_h0", "quantity"))
            .where(F.col("quantity").isNotNull())  # days beyond the horizon
            .select("merchant_id", F.date_add("first_day", F.col("_h0")).alias("order_date"), "record_key", "quantity"))


#: Days of a merchant's records that are gathered as one value before they become records.
DAYS_TOGETHER = 5


def wide_records(forecast: DataFrame, horizon: int = 30) -> DataFrame:
    """E16 as the reference returns it: one record per (merchant, date) with a map
    '<safe_name>_pred' -> quantity. A record holds a merchant's whole catalogue, so this is an
    output format for catalogues that fit one value; jobs use ``long_records``.

    Where ``forecast`` has a row per item, a name and its quantities of ``DAYS_TOGETHER`` days travel as one row, and what a
    merchant gathers becomes that many records: names are shuffled that much less often."""
    if "quantities" in forecast.columns:
        span = F.sequence(F.lit(0), F.lit(horizon - 1), F.lit(DAYS_TOGETHER))
        parts = (_summed_names(forecast, horizon).select("merchant_id", "first_day", "record_key", "_sums", F.explode(span).alias("_from"))
                 .select("merchant_id", "first_day", "_from", "record_key", F.slice("_sums", F.col("_from") + 1, DAYS_TOGETHER).alias("_days")))
        lists = parts.groupBy("merchant_id", "first_day", "_from").agg(F.array_sort(F.collect_list(F.struct("record_key", "_days"))).alias("_names"))
        day = (lists.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(DAYS_TOGETHER), F.lit(horizon) - F.col("_from")) - 1)).alias("_k"))
               .select("merchant_id", F.date_add("first_day", F.col("_from") + F.col("_k")).alias("order_date"), F.filter(
                   F.transform("_names", lambda x: F.struct(x["record_key"], F.get(x["_days"], F.col("_k")).alias("quantity"))),
                   lambda x: x["quantity"].isNotNull()).alias("_entries")))
        return day.where(F.size("_entries") > 0).select("merchant_id", "order_date", F.map_from_entries("_entries").alias("predictions"))
    return (long_records(forecast).groupBy("merchant_id", "order_date")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_key", "quantity")))).alias("predictions")))


# ------------------------------------------------------------------ notebook models

def notebook_panel(daily_items: DataFrame, with_rolling: bool, weekend_from: int = 5) -> DataFrame:
    """Features of J13 (lags) / J14 (+ rolling means) over E7 daily item quantities, rows
    with missing lag or rolling features dropped (B11), calendar split F8."""
    from stallboard.operators import windows as W
    df = add_notebook_calendar(daily_items, weekend_from=weekend_from)
    df = W.add_lags(df, "daily_quantity_sold")
    need = list(NB_LAGS)
    if with_rolling:
        df = W.add_rolling_means(df, "daily_quantity_sold")
        need += NB_ROLL
    df = df.dropna(subset=need)
    return W.calendar_holdout(df)


def dense_codes(values: DataFrame, col: str) -> DataFrame:
    """0-based dense rank of the distinct non-null values of ``col`` (label encoding over the
    sorted classes), without a global window: range-partition the distinct values, count each
    partition, prefix-sum those few counts, and add each partition's offset to the row
    number inside it. Only the per-partition offsets (one row per partition, a proven bound)
    are broadcast."""
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    n_parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(d.repartitionByRange(n_parts, col).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(col)
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .select(col, (F.col("_off") + F.row_number().over(w) - 1).cast("int").alias(f"{col}_encoded")))


def encode_items(panel: DataFrame, unseen: str = "error") -> DataFrame:
    """item_id_encoded = position of the item among the sorted distinct *train* items
    (label encoding). An item that only occurs in the test part raises, as the reference's
    encoder does; ``unseen='keep'`` gives such items the next free code instead."""
    codes = dense_codes(panel.where(F.col("split") == "train"), "item_id")
    out = panel.join(codes, "item_id", "left")
    if unseen == "error":
        bad = out.where(F.col("item_id_encoded").isNull()).limit(1).count()
        if bad:
            raise ValueError("test rows contain items unseen in training")
        return out
    n = codes.count()  # one number: the number of train classes
    return out.withColumn("item_id_encoded", F.coalesce(F.col("item_id_encoded"), F.lit(n).cast("int")))


def holdout_results(pred: DataFrame) -> DataFrame:
    """Predicted vs actual per test row, notebook deviation (I24) and the inclusive
    three-way label (I28), rounded to 2."""
    return pred.select("merchant_id", "item_id", F.col("order_date").alias("forecast_date"),
                       N.round2("prediction").alias("forecasted_quantity"),
                       F.col("daily_quantity_sold").cast("double").alias("actual_quantity"),
                       N.round2(L.deviation_nb("daily_quantity_sold", "prediction")).alias("deviation_pct"),
                       L.label3_inclusive(F.col("daily_quantity_sold") - F.col("prediction"),
                                          F.col("prediction")).alias("label"))


def pivot_pred_actual(results: DataFrame, items: list, days: DataFrame | None = None) -> DataFrame:
    """One row per (merchant, date) with item_<id>_pred / item_<id>_actual columns for an
    explicit item list (a pivot needs its values known up front).

    With ``days`` (merchant_id, forecast_date) these have a row each; ``results`` then need no rows of other items."""
    g = results.groupBy("merchant_id", "forecast_date").pivot("item_id", items).agg(
        F.first("forecasted_quantity").alias("pred"), F.first("actual_quantity").alias("actual"))
    ren = {}
    for c in g.columns:
        if c.endswith("_pred") or c.endswith("_actual"):
            iid, kind = c.rsplit("_", 1)
            ren[c] = f"item_{iid}_{kind}"
    g = g.select(*[F.col(c).alias(ren.get(c, c)) for c in g.columns])
    return g if days is None else days.join(g, ["merchant_id", "forecast_date"], "left")


PIVOT_WIDTH = 256


def item_dictionary(pairs: DataFrame) -> DataFrame:
    """(merchant_id, item_id, position): a merchant's items in ascending order, numbered from 0."""
    from stallboard.operators import ordering as G
    items = pairs.select("merchant_id", "item_id").distinct().withColumn("one", F.lit(1).cast("long"))
    return G.running_total(items, ["merchant_id"], ["item_id"], "one", "position").select("merchant_id", "item_id", F.col("position").cast("int").alias("position"))


def pivot_all_items(results: DataFrame, width: int = PIVOT_WIDTH) -> DataFrame:
    """E15 / D7 with the columns found in the data: (merchant_id, forecast_date, chunk, items, predicted, actual).

    The columns of a merchant's pivot are its items in ascending order, ``width`` to a row; ``items`` are the
    ids that the columns ``item_<id>_pred`` and ``item_<id>_actual`` would be named after, ``predicted`` and
    ``actual`` their values on the day, null where the item has none. No list of items is given and none is lost; a row holds
    ``width`` items at most, whatever the catalogue."""
    names = item_dictionary(results).withColumn("chunk", F.floor(F.col("position") / width).cast("int"))
    columns = names.groupBy("merchant_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("position", "item_id"))).alias("columns"))
    cells = (results.join(names, ["merchant_id", "item_id"]).groupBy("merchant_id", "forecast_date", "chunk")
             .agg(F.map_from_entries(F.collect_list(F.struct("item_id", F.struct("forecasted_quantity", "actual_quantity")))).alias("cells")))
    # days on which none of a chunk's items has a value have a row too, as the pivot has
    days = results.select("merchant_id", "forecast_date").distinct()
    rows = days.join(columns, "merchant_id").join(cells, ["merchant_id", "forecast_date", "chunk"], "left")

    def values(kind: str):
        return F.transform("columns", lambda c: F.element_at(F.col("cells"), c["item_id"])[kind])
    return rows.select("merchant_id", "forecast_date", "chunk", F.transform("columns", lambda c: c["item_id"]).alias("items"),
                       values("forecasted_quantity").alias("predicted"), values("actual_quantity").alias("actual"))


def pivot_item_days(items: DataFrame, cutoff, horizon: int, predicted, actual, width: int = PIVOT_WIDTH) -> DataFrame:
    """``pivot_all_items`` for a forecast that has a row per item and a value on every day of the horizon.

    ``predicted`` and ``actual`` tell an item's value on a day: functions of (the item's row, the day). The items of
    a chunk meet once, with their lists, and the row becomes days after that, so nothing is shuffled at horizon size."""
    values = [c for c in items.columns if c not in ("merchant_id", "item_id")]
    names = item_dictionary(items).select(F.col("merchant_id").alias("_m"), F.col("item_id").alias("_i"), "position")
    placed = items.join(names, (F.col("merchant_id") == F.col("_m")) & (F.col("item_id") == F.col("_i")))
    chunks = (placed.groupBy("merchant_id", F.floor(F.col("position") / width).cast("int").alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("position", "item_id", *values))).alias("columns")))
    days = fan_out(chunks, cutoff, horizon)
    return days.select("merchant_id", F.col("order_date").alias("forecast_date"), "chunk", F.transform("columns", lambda c: c["item_id"]).alias("items"),
                       F.transform("columns", lambda c: predicted(c, F.col("order_date"))).alias("predicted"),
                       F.transform("columns", lambda c: actual(c, F.col("order_date"))).alias("actual"))
