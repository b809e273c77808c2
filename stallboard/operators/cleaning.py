"""Cleaning, conversion and integrity audits.

Spark enforces no keys, so the declared constraints of ``sources.schemas`` become audits:
each returns a small DataFrame of violation counts computed in one distributed pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallboard.session import cut_lineage

from stallboard.sources import schemas as S


def keep_first(df: DataFrame, key: str | list[str] = "order_id", order="id") -> DataFrame:
    """B1: one row per ``key`` (a column or several), the one with the lowest ``order`` (a column or
    an expression; ``ON CONFLICT DO NOTHING`` after loading in id order).

    An aggregate (``min_by`` over the whole row) rather than a window: partial aggregation
    collapses a heavily duplicated key map-side instead of sorting it in one task.
    """
    cols = df.columns
    keys = [key] if isinstance(key, str) else list(key)
    order = F.col(order) if isinstance(order, str) else order
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_r"))
              .select(*[F.col(f"_r.{c}").alias(c) for c in cols]))


def distinct_rows(df: DataFrame) -> DataFrame:
    """B2: full-row SELECT DISTINCT (nulls compare equal)."""
    return df.distinct()


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """B3."""
    return df.drop(*cols)


def pad_date_text(col: str = "join_date", width: int = 8):
    """Left-pad with '0' to ``width`` when shorter."""
    c = F.col(col)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def text_to_date(col: str = "join_date", fmt: str = "ddMMyyyy"):
    """Text -> date; unparseable text becomes null."""
    return F.try_to_date(F.col(col) if isinstance(col, str) else col, fmt)


def clean_join_date(df: DataFrame, col: str = "join_date") -> DataFrame:
    """B4 + B5 + B6: pad, convert, replace the column in place."""
    return (df.withColumn(f"{col}_converted", text_to_date(pad_date_text(col)))
              .drop(col).withColumnRenamed(f"{col}_converted", col))


_CAMEL1 = re.compile(r"(.)([A-Z][a-z]+)")
_CAMEL2 = re.compile(r"([a-z0-9])([A-Z])")
_NONWORD = re.compile(r"[^0-9a-zA-Z]+")


def snake(name: str) -> str:
    s = _CAMEL2.sub(r"\1_\2", _CAMEL1.sub(r"\1_\2", name))
    s = _NONWORD.sub("_", s).strip("_").lower()
    return s or "column"


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake case (schema only); repeats get _1, _2 ..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = snake(c)
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 0
        out.append(n)
    return df.toDF(*out)


def null_length_audit(df: DataFrame, table: str) -> DataFrame:
    """Per declared column: nulls where NOT NULL is declared, values longer than the limit.

    One aggregate pass; result rows (table, column, null_count, too_long_count). Declared
    columns the frame does not carry are skipped.
    """
    specs = [(c, n) for c, n in S.NOT_NULL[table] if c in df.columns]
    aggs = []
    for col, max_len in specs:
        nullable = (table, col) in S.NULLABLE
        aggs.append(F.lit(0).cast("long") if nullable else F.count_if(F.col(col).isNull()))
        aggs.append(F.count_if(F.length(F.col(col).cast("string")) > max_len) if max_len
                    else F.lit(0).cast("long"))
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    stack = ", ".join(f"'{c}', a{2 * i}, a{2 * i + 1}" for i, (c, _) in enumerate(specs))
    return row.selectExpr(f"stack({len(specs)}, {stack}) as (column_name, null_count, too_long_count)") \
              .select(F.lit(table).alias("table_name"), "column_name",
                      F.col("null_count").cast("long"), F.col("too_long_count").cast("long"))


def unique_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key values that occur more than once, and the surplus rows."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicated_keys"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"))


def foreign_key_audit(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose key has no parent (null keys are not violations, as in SQL)."""
    orphans = (child.where(F.col(child_col).isNotNull())
               .join(parent.select(F.col(parent_col).alias(child_col)).distinct(), child_col, "left_anti"))
    return orphans.agg(F.count(F.lit(1)).alias("orphan_rows"))


def require_clean(audit: DataFrame, *count_cols: str) -> None:
    """B10's load semantics: a violation aborts the load instead of filtering rows."""
    total = audit.agg(*[F.sum(c).alias(c) for c in count_cols]).first()
    bad = {c: total[c] for c in count_cols if total[c]}
    if bad:
        raise ValueError(f"constraint violated: {bad}")


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """B11."""
    return df.dropna(subset=subset)


def coerce_numeric(col) -> "F.Column":
    """Text to double, bad values -> null."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("double")


def dtype_null_audit(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_count) in one pass."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{types[c]}', n{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, data_type, null_count)")


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """Keep the first column of each name, by position."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in keep])


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


QUANTILES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def profile(df: DataFrame, cols: list[str] | None = None, keys=()) -> DataFrame:
    """Per numeric column n, nulls, mean, sd, p0/p25/p50/p75/p100 (exact, linear).
    ``keys`` profiles per group (e.g. merchant).

    Quantiles come from distributed ranks: equal values are counted first (map-side combined),
    the distinct (group, column, value) rows are range-partitioned, and each partition adds the
    counts of the same column in the partitions before it; no task holds a whole column."""
    keys = list(keys)
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in cols)
    long = df.selectExpr(*keys, f"stack({len(cols)}, {stack}) as (column_name, x)")
    group = [*keys, "column_name"]
    summary = long.groupBy(*group).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("null_count"),
                                       F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    values = long.where(F.col("x").isNotNull()).groupBy(*group, "x").agg(F.count(F.lit(1)).alias("c"))
    ranged = cut_lineage(values.repartitionByRange(parts, *group, "x").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_part").agg(F.sum("c").alias("_c"))
               .select(*group, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*group, "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "_part"]]
    ranked = (ranged.withColumn("_to", F.sum("c").over(inside)).alias("v").join(offsets.alias("o"), same)
              .select(*[F.col(f"v.{c}").alias(c) for c in group], "x", "c", (F.col("_before") + F.col("_to")).alias("_to")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    placed = ranked.alias("r").join(summary.alias("s"), same).select(
        *[F.col(f"s.{c}").alias(c) for c in group], "x", "c", "_to", "n")
    picks = []
    for name, q in QUANTILES.items():
        place = (F.col("n") - 1) * F.lit(q)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((at < F.col("_to")) & (at >= F.col("_to") - F.col("c")), F.col("x"))).alias(f"{name}_{end}"))
    picked = placed.groupBy(*group).agg(F.max("n").alias("_n"), *picks)

    def value(name: str, q: float):
        place = (F.col("_n") - 1) * F.lit(q)
        return F.col(f"{name}_lo") + (place - F.floor(place)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
    quantiles = picked.select(*group, *[value(name, q).alias(name) for name, q in QUANTILES.items()])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in group]
    return summary.alias("s").join(quantiles.alias("q"), same, "left").select(
        *[F.col(f"s.{c}").alias(c) for c in group], "n", "null_count", "mean", "sd", *QUANTILES)
