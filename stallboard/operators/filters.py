"""Projections, filters and predicates.

Predicates on scan columns with constant bounds reach the parquet reader as pushed filters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallboard.functions import dates as D


def merchant_filter(df: DataFrame, merchant_id=None, col: str = "merchant_id") -> DataFrame:
    """Optional merchant filter (one id or a list); None keeps every merchant."""
    if merchant_id is None:
        return df
    if isinstance(merchant_id, (list, tuple, set)):
        return df.where(F.col(col).isin(list(merchant_id)))
    return df.where(F.col(col) == F.lit(merchant_id))


def lookback(df: DataFrame, days: int, as_of, col: str = "order_time") -> DataFrame:
    """Closed range of ``days`` days ending with the whole of ``as_of``."""
    lo, hi = D.lookback_bounds(as_of, days)
    return df.where((F.col(col) >= D.ntz_lit(lo)) & (F.col(col) <= D.ntz_lit(hi)))


def before_cutoff(df: DataFrame, cutoff, col: str = "order_time") -> DataFrame:
    """Half-open training cutoff ``col < cutoff + 1 day``."""
    bound, _ = D.training_cutoff(cutoff)
    return df.where(F.col(col) < D.ntz_lit(bound))


def _day_start(as_of) -> dt.datetime:
    return dt.datetime.combine(D.as_date(as_of), dt.time(0, 0))


def active_within(df: DataFrame, days, as_of, col: str = "last_order_date") -> DataFrame:
    """Strictly after 00:00 of ``as_of - days`` and strictly before the last microsecond
    of ``as_of``. Non-positive or missing ``days``: no filter. Null dates are dropped."""
    if days is None or days <= 0:
        return df
    lo = _day_start(as_of) - dt.timedelta(days=int(days))
    hi = _day_start(as_of) + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    c = F.col(col)
    return df.where(c.isNotNull() & (c > D.ntz_lit(lo)) & (c < D.ntz_lit(hi)))


def lapsed_more_than(df: DataFrame, days: int, as_of, col: str = "last_order_date") -> DataFrame:
    """Last order before 00:00 of ``as_of - days`` (the 'more than N days ago' reading)."""
    lo = _day_start(as_of) - dt.timedelta(days=int(days))
    return df.where(F.col(col) < D.ntz_lit(lo))


def search_all_columns(df: DataFrame, query: str | None, cols=None) -> DataFrame:
    """Case-insensitive 'contains' over every column (as text); empty query keeps all."""
    if not query:
        return df
    cols = cols or df.columns
    texts = F.array(*[F.lower(F.col(c).cast("string")) for c in cols])
    return df.where(F.exists(texts, lambda x: F.coalesce(x.contains(query.lower()), F.lit(False))))


def first_by_key(df: DataFrame, key: str, value, order_by: str | None = None) -> DataFrame:
    """Point lookup, first row (by ``order_by`` when given, for determinism)."""
    sel = df.where(F.col(key) == F.lit(value))
    if order_by:
        sel = sel.orderBy(order_by)
    return sel.limit(1)


def outlier_flag(x, lo, hi) -> Column:
    """X outside [lo, hi]."""
    x = F.col(x) if isinstance(x, str) else x
    return (x < lo) | (x > hi)


def keep_items(df: DataFrame, chosen: DataFrame, keys=("merchant_id", "item_id")) -> DataFrame:
    """C11: rows of the chosen item(s) per merchant; a semi join, no columns added."""
    return df.join(chosen.select(*keys), list(keys), "left_semi")


def columns_with_suffix(df: DataFrame, suffix: str = "_pred") -> list[str]:
    """Column names ending with ``suffix`` (wide forecast records)."""
    return [c for c in df.columns if c.endswith(suffix)]
