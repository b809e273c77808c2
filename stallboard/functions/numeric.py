"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x) -> Column:
    """numeric(10,2)."""
    return _c(x).cast("decimal(10,2)")


def line_subtotal(price, qty) -> Column:
    """I16: price x quantity, cast back to two decimals as the view does."""
    return (_c(price) * _c(qty)).cast("decimal(12,2)")


def exact_sum_double(x) -> Column:
    """Sum of money as an exact decimal, then double: independent of summation order."""
    return F.sum(_c(x).cast("decimal(20,2)")).cast("double")


def winsorize(x, lo, hi) -> Column:
    """Clip to [lo, hi]; null stays null (``greatest``/``least`` would skip it)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, _c(lo)), _c(hi)))


def log1p(x) -> Column:
    """I18."""
    return F.log1p(_c(x))


def minmax_scale(x, mn, mx) -> Column:
    """(x-mn)/(mx-mn); a constant column gives null (the reference gets NaN)."""
    return F.try_divide(_c(x) - _c(mn), _c(mx) - _c(mn))


def round2(x, digits: int = 2) -> Column:
    """numpy's rounding, ``rint(x * 10^d) / 10^d`` (half to even on the scaled double,
    so 2.675 -> 2.68 because 2.675*100 is exactly 267.5, and 0.125 -> 0.12)."""
    scale = float(10 ** digits)
    return F.rint(_c(x).cast("double") * scale) / scale


def nonneg_int(x) -> Column:
    """max(0, round half to even) as int."""
    return F.greatest(F.lit(0.0), F.rint(_c(x))).cast("int")


def rmse(err) -> Column:
    """E20."""
    return F.sqrt(F.avg(F.pow(_c(err), 2)))


def mse(err) -> Column:
    """E20."""
    return F.avg(F.pow(_c(err), 2))
