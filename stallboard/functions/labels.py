"""Forecast deviation and labels.

The reference divides with pandas, so x/0 is +-inf and 0/0 is NaN, and its labels branch on
those. Here the percentage is null when the denominator is 0 (``try_divide``; ANSI mode
would raise) and each label is decided from the sign of the numerator exactly as the
infinite or NaN value would have been.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Label texts.
MUCH_BETTER = "Much Better than Expected"
BETTER = "Better than Expected"
AS_EXPECTED = "As Expected"
WORSE = "Worse than Expected"
MUCH_WORSE = "Much Worse than Expected"
FUTURE = "Future date"
BETTER_T = "Better Than Expected"
WORSE_T = "Worse Than Expected"


def deviation_api(forecast, actual) -> Column:
    """(forecast - actual) / actual * 100."""
    return F.try_divide(_c(forecast) - _c(actual), _c(actual)) * 100


def deviation_nb(actual, forecast) -> Column:
    """(actual - forecast) / forecast * 100."""
    return F.try_divide(_c(actual) - _c(forecast), _c(forecast)) * 100


def _parts(num, den):
    num, den = _c(num), _c(den)
    pct = F.try_divide(num, den) * 100
    pos_inf = (den == 0) & (num > 0)
    neg_inf = (den == 0) & (num < 0)
    nan = (den == 0) & (num == 0)
    return pct, pos_inf, neg_inf, nan


def label5(num, den) -> Column:
    """I25 on pct = num/den*100: >=10, (0,10), 0, (-10,0), else (so -10, NaN, null -> Much Worse)."""
    pct, pos_inf, neg_inf, nan = _parts(num, den)
    return (F.when(pos_inf, MUCH_BETTER)
             .when(neg_inf | nan | pct.isNull() | F.isnan(pct), MUCH_WORSE)
             .when(pct >= 10, MUCH_BETTER)
             .when((pct > 0) & (pct < 10), BETTER)
             .when(pct == 0, AS_EXPECTED)
             .when((pct > -10) & (pct < 0), WORSE)
             .otherwise(MUCH_WORSE))


def label3(num, den, future=None) -> Column:
    """|pct| < 10 As Expected; pct > 10 Better; else Worse (+-10 and NaN are Worse).

    With ``future`` (a boolean column, e.g. the actual is missing) the first branch is
    'Future date' (I26).
    """
    pct, pos_inf, neg_inf, nan = _parts(num, den)
    w = F.when(F.lit(False), F.lit(None).cast("string"))
    if future is not None:
        w = F.when(_c(future), FUTURE)
    return (w.when(pos_inf, BETTER)
             .when(neg_inf | nan | pct.isNull() | F.isnan(pct), WORSE)
             .when(F.abs(pct) < 10, AS_EXPECTED)
             .when(pct > 10, BETTER)
             .otherwise(WORSE))


def label3_inclusive(num, den) -> Column:
    """|pct| <= 10 As Expected; pct > 10 'Better Than Expected'; else 'Worse Than Expected'."""
    pct, pos_inf, neg_inf, nan = _parts(num, den)
    return (F.when(pos_inf, BETTER_T)
             .when(neg_inf | nan | pct.isNull() | F.isnan(pct), WORSE_T)
             .when(F.abs(pct) <= 10, AS_EXPECTED)
             .when(pct > 10, BETTER_T)
             .otherwise(WORSE_T))
