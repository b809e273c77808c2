"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fallback key and suffixes used by the reference's forecast records.
UNKNOWN_ITEM = "unknown_item"
PRED_SUFFIX = "_pred"
ACTUAL_SUFFIX = "_actual"
TRUNCATION_MARKER = "\n... (data truncated)"


def safe_key(name) -> Column:
    """Runs of non-word characters -> '_', strip '_' at both ends, '_' before a leading
    digit, empty -> 'unknown_item'. ``(?U)`` makes ``\\W`` Unicode-aware like Python's."""
    s = F.regexp_replace(_c(name), r"(?U)\W+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    s = F.when(s.rlike(r"(?U)^\d"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(s.isNull() | (s == ""), F.lit(UNKNOWN_ITEM)).otherwise(s)


def add_suffix(s, suffix: str = PRED_SUFFIX) -> Column:
    """I30."""
    return F.concat(_c(s), F.lit(suffix))


def strip_suffix(s, suffix: str = PRED_SUFFIX) -> Column:
    """Remove a trailing suffix if present."""
    return F.regexp_replace(_c(s), _regex_escape(suffix) + "$", "")


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def item_line(name, qty, sales=None) -> Column:
    """I31: '* name: N units (Sales: $x.xx)', or '* name: N units' for forecasts."""
    if sales is None:
        return F.format_string("* %s: %d units", _c(name), _c(qty).cast("long"))
    return F.format_string("* %s: %d units (Sales: $%.2f)", _c(name), _c(qty).cast("long"),
                           _c(sales).cast("double"))


def money_text(x) -> Column:
    """I32: thousands-grouped, two decimals."""
    return F.format_number(_c(x).cast("double"), 2)


def cut_text(s, limit: int = 4000) -> Column:
    """Keep the first ``limit`` characters and append the truncation marker."""
    c = _c(s)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(TRUNCATION_MARKER))).otherwise(c)


def strip_text(s) -> Column:
    """Leading and trailing whitespace removed (all whitespace, like Python's ``strip``;
    Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")


def clean_text(s) -> Column:
    """Stripped text, null when blank."""
    t = strip_text(s)
    return F.when(F.length(t) > 0, t)
