"""Exact quantiles of whole columns by narrowing histograms, and profiles of all column types.

Selection. For every (column, quantile) the wanted row numbers are known from the counts. A pass
divides the value range in which a wanted row lies into ``BINS`` bins and counts them in one aggregate for all
columns and targets together (map-side combined: ``BINS`` rows per target and task); the bin that
holds the wanted row is the next range. A bin also tells its least and greatest value, so a range with one
value is finished, whatever its number of rows, and a bin with few rows is listed as counted values. Nothing is
sorted and no task or driver holds a column: the driver sees at most ``BINS`` rows per target and pass.

Values are compared as doubles. Nulls are counted apart; NaN counts as null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 256
#: Rows of a bin that are listed as counted values instead of divided again.
LISTED = 2048
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
QUANTILES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


@dataclass
class Target:
    """The range of values in which row ``place`` (from 0, among those of the range) of a column lies."""
    column: str
    place: int
    low: float
    high: float
    rows: int

    def narrow(self) -> bool:
        """Whether no double lies well inside the range, so that it holds a few different values at most."""
        middle = self.low / 2 + self.high / 2
        return not self.low < middle < self.high or max(abs(self.low), abs(self.high)) < 1e-300


def _values(df: DataFrame, columns: list[str]) -> list:
    return [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]


def _bin(x: Column, target: Target) -> Column:
    """Bin of a value of the target's range; it never falls as the value rises."""
    low, high = target.low, target.high
    if math.isinf(low) or math.isinf(high):  # finite values share a bin, which then has finite ends
        return F.when(x == F.lit(float("-inf")), -1).when(x == F.lit(float("inf")), 1).otherwise(0)
    if low >= 0 and high <= 4 * low or high <= 0 and low >= 4 * high:
        share = (x - F.lit(low)) / F.lit(high - low)
    else:  # by powers of two, so that values of any size are told apart in two or three passes
        first, last = _scale(F.lit(low)), _scale(F.lit(high))
        share = (_scale(x) - first) / (last - first)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def _scale(x: Column) -> Column:
    """A logarithm that keeps the order of all finite doubles: 0 for zero, the sign of the value elsewhere."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1080))


def _count_bins(data: DataFrame, targets: list[Target]) -> dict[int, dict[int, tuple]]:
    """(rows, least, greatest) per target and bin, in one pass over the data."""
    cells = []
    for t, target in enumerate(targets):
        x = F.col(f"`{target.column}`")
        own = F.when((x >= F.lit(target.low)) & (x <= F.lit(target.high)),
                     F.struct(F.lit(t).alias("t"), _bin(x, target).alias("bin"), x.alias("x")))
        cells.append(own)
    flat = data.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    out: dict[int, dict[int, tuple]] = {}
    for r in flat.groupBy("t", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        out.setdefault(r.t, {})[r.bin] = (r.n, r.lo, r.hi)
    return out


def _list_values(data: DataFrame, targets: list[Target]) -> dict[int, list[tuple[float, int]]]:
    """Counted values of small ranges, ascending."""
    cells = [F.when(F.col(f"`{t.column}`").between(t.low, t.high), F.struct(F.lit(k).alias("t"), F.col(f"`{t.column}`").alias("x")))
             for k, t in enumerate(targets)]
    flat = data.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
    out: dict[int, list[tuple[float, int]]] = {}
    for r in flat.groupBy("t", "x").agg(F.count(F.lit(1)).alias("n")).collect():  # LISTED rows per target at most
        out.setdefault(r.t, []).append((r.x, r.n))
    return {k: sorted(v) for k, v in out.items()}


def _at(values: list[tuple[float, int]], place: int) -> float:
    for x, n in values:
        if place < n:
            return x
        place -= n
    raise ValueError("fewer rows than the wanted one")


def select_places(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The value of row ``place`` (from 0, ascending, nulls left out) of each column, exactly."""
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {}
    data = df.select(*_values(df, columns))
    ends = data.agg(*(f(f"`{c}`").alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    rows = data.agg(*(F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(columns))).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], Target] = {}
    for k, c in enumerate(columns):
        for place in dict.fromkeys(wanted[c]):
            open_[(c, place)] = Target(c, place, ends[f"lo{k}"], ends[f"hi{k}"], rows[f"n{k}"])
    while open_:
        # places that lie in one range share it
        ranges = list({(t.column, t.low, t.high): t for t in open_.values()}.values())
        small = [t for t in ranges if t.rows <= LISTED or math.isfinite(t.high - t.low) and t.narrow()]
        listed = _list_values(data, small) if small else {}
        values = {(t.column, t.low, t.high): listed[k] for k, t in enumerate(small)}
        large = [t for t in ranges if (t.column, t.low, t.high) not in values]
        bins = _count_bins(data, large) if large else {}
        order = {(t.column, t.low, t.high): k for k, t in enumerate(large)}
        for key, t in list(open_.items()):
            own = (t.column, t.low, t.high)
            if own in values:
                found[key] = _at(values[own], t.place)
                del open_[key]
                continue
            place = t.place
            for _, (n, lo, hi) in sorted(bins[order[own]].items()):
                if place < n:
                    break
                place -= n
            if lo == hi:
                found[key] = lo
                del open_[key]
            else:
                open_[key] = Target(t.column, place, lo, hi, n)
    return found


def quantiles(df: DataFrame, columns: list[str], shares: dict[str, float] | None = None) -> dict[str, dict[str, float | None]]:
    """Exact quantiles with linear interpolation of every column; None for a column without values."""
    shares = shares or QUANTILES
    data = df.select(*_values(df, columns))
    counts = data.agg(*(F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(columns))).first()
    size = {c: counts[f"n{k}"] for k, c in enumerate(columns)}
    wanted = {c: sorted({f((size[c] - 1) * q) for q in shares.values() for f in (math.floor, math.ceil)}) if size[c] else [] for c in columns}
    found = select_places(df, wanted)

    def value(c: str, q: float) -> float | None:
        if not size[c]:
            return None
        place = (size[c] - 1) * q
        lo, hi = found[(c, math.floor(place))], found[(c, math.ceil(place))]
        return lo if lo == hi else lo + (place - math.floor(place)) * (hi - lo)
    return {c: {name: value(c, q) for name, q in shares.items()} for c in columns}


def profile_all(df: DataFrame) -> DataFrame:
    """B15 over all columns, one row each: type, rows (the shape's first number; its second is the number of rows of
    the profile), nulls, distinct values, mean, sd and quantiles of numbers, shortest and longest text, least and greatest value as text,
    and the most frequent value (ties: the least by its text).

    Distinct and most frequent values come from one count per (column, value), map-side combined."""
    spark = df.sparkSession
    names = df.columns
    texts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(names))))
    counted = df.select(texts.alias("c")).select("c.*").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("v").isNotNull()
    per = {r.k: r for r in counted.groupBy("k").agg(
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"), F.sum("n").alias("rows"), F.count("v").alias("distinct"),
        F.min_by("v", F.when(present, F.struct(-F.col("n"), F.col("v")))).alias("top"), F.max(F.when(present, F.col("n"))).alias("top_count"),
        F.min(F.length("v")).alias("shortest"), F.max(F.length("v")).alias("longest")).collect()}  # one row per column
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    whole = df.agg(*(f.alias(f"{a}{k}") for k, c in enumerate(names) for a, f in (
        ("lo", F.min(f"`{c}`").cast("string")), ("hi", F.max(f"`{c}`").cast("string")),
        *((("mean", F.avg(F.col(f"`{c}`").cast("double"))), ("sd", F.stddev_samp(F.col(f"`{c}`").cast("double")))) if c in numeric else ())))).first()
    places = quantiles(df, numeric)
    out = []
    for k, f in enumerate(df.schema.fields):
        own, text = per.get(k), isinstance(f.dataType, T.StringType)
        q = places.get(f.name, {})
        out.append((f.name, f.dataType.simpleString(), own.rows if own else 0, own.nulls if own else 0, own.distinct if own else 0,
                    whole[f"mean{k}"] if f.name in numeric else None, whole[f"sd{k}"] if f.name in numeric else None, *(q.get(name) for name in QUANTILES),
                    own.shortest if own and text else None, own.longest if own and text else None,
                    None if f.name in numeric else whole[f"lo{k}"], None if f.name in numeric else whole[f"hi{k}"],
                    own.top if own else None, own.top_count if own else None))
    return spark.createDataFrame(out, "column_name string, type string, rows long, null_count long, distinct_count long, mean double, sd double, "
                                 + ", ".join(f"{q} double" for q in QUANTILES)
                                 + ", shortest int, longest int, least string, greatest string, top string, top_count long")
