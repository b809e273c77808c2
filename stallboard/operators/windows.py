"""Window features over daily series (F2-F8).

Windows are partitioned by the series' own key, (merchant) over daily totals or (merchant,
item) over the item panel, and ordered by date over *daily aggregates*, so a partition holds at
most one row per calendar day -- bounded regardless of order volume.
Lags and rolling frames count rows (selling days), not calendar days, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def add_lags(df: DataFrame, value: str, lags=(1, 7), keys=("merchant_id", "item_id"),
             order: str = "order_date") -> DataFrame:
    """lag_k = value k rows earlier in the same item's series."""
    w = _w(keys, order)
    for k in lags:
        df = df.withColumn(f"lag_{k}", F.lag(value, k).over(w))
    return df


def add_rolling_means(df: DataFrame, value: str, sizes=(3, 7), keys=("merchant_id", "item_id"),
                      order: str = "order_date", exclude_current: bool = False) -> DataFrame:
    """mean of the last k rows including the current one (the reference's choice, which
    leaks the target), null until k rows exist. ``exclude_current`` shifts the frame back one
    row for honest features."""
    w = _w(keys, order)
    end = -1 if exclude_current else 0
    for k in sizes:
        frame = w.rowsBetween(end - k + 1, end)
        df = df.withColumn(f"rolling_mean_{k}",
                           F.when(F.count(F.col(value)).over(frame) == k, F.avg(F.col(value).cast("double")).over(frame)))
    return df


def add_rolling_mean_std(df: DataFrame, value: str, k: int = 12, keys=("merchant_id",),
                         order: str = "order_date", prefix: str = "rolling") -> DataFrame:
    """Rolling mean and sample std over k rows, null until the window is full."""
    frame = _w(keys, order).rowsBetween(-(k - 1), 0)
    full = F.count(F.col(value)).over(frame) == k
    x = F.col(value).cast("double")
    return (df.withColumn(f"{prefix}_mean_{k}", F.when(full, F.avg(x).over(frame)))
              .withColumn(f"{prefix}_std_{k}", F.when(full, F.stddev_samp(x).over(frame))))


def positional_holdout(df: DataFrame, n_test: int = 30, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """the last ``n_test`` rows of each merchant's series are 'test', the rest 'train'."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("split", F.when(F.row_number().over(w) <= n_test, "test").otherwise("train"))


def calendar_holdout(df: DataFrame, days: int = 30, keys=("merchant_id",), order: str = "order_date") -> DataFrame:
    """F8: split date = max(date) - ``days`` per merchant; train before it, test from it.

    A merchant's rows are items x days, so the last date is a grouped maximum (map-side
    combined) joined back, not a window over the merchant."""
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.date_sub(F.max(order), days).alias("split_date"))
    return (df.join(last, keys)
              .withColumn("split", F.when(F.col(order) < F.col("split_date"), "train").otherwise("test")))
