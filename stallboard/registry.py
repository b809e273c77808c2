"""Registered queries over the driver's tables and their DuckDB oracle SQL.

Every query reads the whole driver tables (no id subsets, no row caps) and returns one
DataFrame for all merchants. Column names are the same in the Spark result and the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallboard.operators import views as V
from stallboard.plans import customers as PC
from stallboard.plans import sales as PS
from stallboard.session import ship_package

# Parameters of the registered queries (the driver's data ends 2001-08-01).
AS_OF = "2001-08-01"
ITEM_DAYS = 30

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        import functools

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# The combined order-line view in DuckDB terms (same casts as sources.tables / views).
OL = """order_lines AS (
  SELECT l.l_orderkey AS order_id, l.l_suppkey AS order_merchant_id, l.l_partkey AS item_id,
         p.p_name AS item_name, CAST(p.p_retailprice AS DECIMAL(10,2)) AS item_price,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) * CAST(l.l_quantity AS INTEGER) AS DECIMAL(12,2)) AS subtotal,
         l.l_suppkey AS item_merchant_id, s.s_name AS merchant_name,
         CAST(o.o_totalprice AS DECIMAL(10,2)) AS order_value, o.o_orderdate AS order_time,
         l.l_shipdate AS delivery_time, o.o_custkey AS eater_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

# D2 unit-grain customer lines
CL = """customer_lines AS (
  SELECT l.l_suppkey AS merchant_id, o.o_custkey AS eater_id, o.o_orderdate AS order_time,
         l.l_partkey AS item_id, p.p_name AS item_name
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""


def _lookback_sql(days: int, as_of: str = AS_OF) -> str:
    from stallboard.functions.dates import lookback_bounds
    lo, hi = lookback_bounds(as_of, days)
    return (f"order_time >= TIMESTAMP '{lo.isoformat(sep=' ')}' "
            f"AND order_time <= TIMESTAMP '{hi.isoformat(sep=' ')}'")


# ------------------------------------------------------------------ K2 item sales

@register("k2_item_sales", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, item_id, item_name,
       CAST(SUM(quantity) AS INTEGER) AS total_quantity,
       CAST(SUM(item_price * quantity) AS DOUBLE) AS total_sales
FROM order_lines
WHERE {_lookback_sql(ITEM_DAYS)}
GROUP BY order_merchant_id, item_id, item_name
HAVING SUM(quantity) > 0
""")
def k2_item_sales(spark, sf_dir):
    return PS.item_sales_over_days(V.order_lines(spark, sf_dir), ITEM_DAYS, AS_OF)


# ------------------------------------------------------------------ K3 monthly sales

@register("k3_monthly_sales", f"""
WITH {OL},
u AS (SELECT DISTINCT order_merchant_id AS merchant_id, order_id, order_value,
             strftime(order_time, '%Y-%m') AS month FROM order_lines)
SELECT merchant_id, month, CAST(SUM(order_value) AS DOUBLE) AS total_sales
FROM u GROUP BY merchant_id, month
""")
def k3_monthly_sales(spark, sf_dir):
    return PS.monthly_sales(V.order_lines(spark, sf_dir))


# ------------------------------------------------------------------ K1 customers

@register("k1_customers", f"""
WITH {CL},
per_name AS (SELECT merchant_id, eater_id, item_name, COUNT(*) AS n, MAX(order_time) AS latest
             FROM customer_lines WHERE eater_id IS NOT NULL GROUP BY ALL)
SELECT merchant_id, eater_id AS customer_id, MAX(latest) AS last_order_date, FIRST(item_name ORDER BY n DESC, item_name) AS favorite_food
FROM per_name GROUP BY ALL
""")
def k1_customers(spark, sf_dir):
    return PC.customer_list(V.driver_customer_lines(spark, sf_dir))


# ------------------------------------------------------------------ E5 / E6 daily summaries

@register("e5_daily_summary", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date,
       COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(order_value) AS DOUBLE) AS total_revenue,
       CAST(SUM(quantity) AS BIGINT) AS total_items
FROM order_lines GROUP BY 1, 2
""")
def e5_daily_summary(spark, sf_dir):
    return PS.daily_summary(V.order_lines(spark, sf_dir), "order_value_lines")


@register("e6_daily_summary_subtotal", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date,
       COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(subtotal) AS DOUBLE) AS total_revenue,
       CAST(SUM(quantity) AS BIGINT) AS total_items
FROM order_lines GROUP BY 1, 2
""")
def e6_daily_summary_subtotal(spark, sf_dir):
    return PS.daily_summary(V.order_lines(spark, sf_dir), "subtotal")



# ------------------------------------------------------------------ shared SQL pieces

DAILY_SQL = """daily AS (
  SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date,
         COUNT(DISTINCT order_id) AS total_orders,
         CAST(SUM(order_value) AS DOUBLE) AS total_revenue,
         CAST(SUM(quantity) AS BIGINT) AS total_items
  FROM order_lines GROUP BY 1, 2)"""

DAILY_SUB_SQL = """daily AS (
  SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date,
         COUNT(DISTINCT order_id) AS total_orders,
         CAST(SUM(subtotal) AS DOUBLE) AS total_revenue,
         CAST(SUM(quantity) AS BIGINT) AS total_items
  FROM order_lines GROUP BY 1, 2)"""

METRICS = ("total_orders", "total_revenue", "total_items")


def _daily(spark, sf_dir, revenue="order_value_lines"):
    return PS.daily_summary(V.order_lines(spark, sf_dir), revenue)


def _nearest_sql(qs, metrics=METRICS, src="daily"):
    ranks = ",\n    ".join(f"ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY {m}) AS r_{m}" for m in metrics)
    picks = ",\n  ".join(
        f"MAX(CASE WHEN r_{m} = FLOOR((n - 1) * CAST({q} AS DOUBLE) + 0.5) + 1 THEN CAST({m} AS DOUBLE) END) "
        f"AS {m}_q{round(q * 100):02d}" for m in metrics for q in qs)
    return f"""ranked AS (
  SELECT *, COUNT(*) OVER (PARTITION BY merchant_id) AS n,
    {ranks}
  FROM {src}),
qs AS (SELECT merchant_id, MAX(n) AS n,
  {picks}
  FROM ranked GROUP BY merchant_id)"""


# ------------------------------------------------------------------ E3, E7, E8, E21

@register("e3_item_sales_all_time", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, item_id, item_name,
       CAST(SUM(quantity) AS INTEGER) AS total_quantity,
       CAST(SUM(item_price * quantity) AS DOUBLE) AS total_sales
FROM order_lines GROUP BY 1, 2, 3
""")
def e3_item_sales_all_time(spark, sf_dir):
    from stallboard.operators import aggregates as A
    return A.item_sales(V.order_lines(spark, sf_dir))


@register("e7_daily_item_quantity", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id,
       MIN(item_name) AS item_name, CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold
FROM order_lines GROUP BY 1, 2, 3
""")
def e7_daily_item_quantity(spark, sf_dir):
    from stallboard.operators import aggregates as A
    return A.daily_item_quantity(V.order_lines(spark, sf_dir), by_name=False)


@register("e8_daily_item_quantity_by_name", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id, item_name,
       CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold
FROM order_lines GROUP BY 1, 2, 3, 4
""")
def e8_daily_item_quantity_by_name(spark, sf_dir):
    from stallboard.operators import aggregates as A
    return A.daily_item_quantity(V.order_lines(spark, sf_dir), by_name=True)


@register("e21_distinct_item_names", f"""
WITH {OL}
SELECT DISTINCT order_merchant_id AS merchant_id, item_id, item_name FROM order_lines
""")
def e21_distinct_item_names(spark, sf_dir):
    from stallboard.operators import aggregates as A
    lines = V.order_lines(spark, sf_dir).withColumnRenamed("order_merchant_id", "merchant_id")
    return A.distinct_items(lines, with_name=True)


# ------------------------------------------------------------------ E9, E10, E14, J1

@register("e9_nearest_quantiles", f"""
WITH {OL}, {DAILY_SQL}, {_nearest_sql((0.03, 0.25, 0.75, 0.97))}
SELECT * FROM qs
""")
def e9_nearest_quantiles(spark, sf_dir):
    from stallboard.operators import stats as ST
    return ST.nearest_quantiles(_daily(spark, sf_dir), ["merchant_id"], METRICS, (0.03, 0.25, 0.75, 0.97))


@register("e10_min_max", f"""
WITH {OL}, {DAILY_SQL}
SELECT merchant_id, MIN(total_revenue) AS min_revenue, MAX(total_revenue) AS max_revenue,
       MIN(total_orders) AS min_orders, MAX(total_orders) AS max_orders
FROM daily GROUP BY merchant_id
""")
def e10_min_max(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return d.groupBy("merchant_id").agg(F.min("total_revenue").alias("min_revenue"),
                                        F.max("total_revenue").alias("max_revenue"),
                                        F.min("total_orders").alias("min_orders"),
                                        F.max("total_orders").alias("max_orders"))


def _iqr_sql():
    parts = []
    for m in METRICS:
        parts.append(f"""SELECT d.merchant_id, '{m}' AS feature, q.{m}_q25 AS q1, q.{m}_q75 AS q3,
       q.{m}_q25 - 1.5 * (q.{m}_q75 - q.{m}_q25) AS lower_bound,
       q.{m}_q75 + 1.5 * (q.{m}_q75 - q.{m}_q25) AS upper_bound,
       COUNT(*) FILTER (WHERE d.{m} < q.{m}_q25 - 1.5 * (q.{m}_q75 - q.{m}_q25)
                           OR d.{m} > q.{m}_q75 + 1.5 * (q.{m}_q75 - q.{m}_q25)) AS n_outliers
FROM daily d JOIN qs q ON d.merchant_id = q.merchant_id
GROUP BY d.merchant_id, q.{m}_q25, q.{m}_q75""")
    return "\nUNION ALL\n".join(parts)


@register("e14_iqr_outliers", f"""
WITH {OL}, {DAILY_SQL}, {_nearest_sql((0.25, 0.75))}
{_iqr_sql()}
""")
def e14_iqr_outliers(spark, sf_dir):
    from stallboard.operators import stats as ST
    return ST.iqr_outliers(_daily(spark, sf_dir))


def _j1_sql():
    cols = []
    for m in METRICS:
        lo, hi = f"q.{m}_q03", f"q.{m}_q97"
        w = f"LEAST(GREATEST(CAST(d.{m} AS DOUBLE), {lo}), {hi})"
        cols.append(f"ROUND({w}, 6) AS {m}_winsor")
        cols.append(f"ROUND(LN(1 + {w}), 9) AS {m}_log1p")
        cols.append(f"ROUND(CASE WHEN LN(1 + {hi}) = LN(1 + {lo}) THEN NULL ELSE "
                    f"(LN(1 + {w}) - LN(1 + {lo})) / (LN(1 + {hi}) - LN(1 + {lo})) END, 9) AS {m}_norm")
    return ",\n       ".join(cols)


@register("j1_preprocess", f"""
WITH {OL}, {DAILY_SQL}, {_nearest_sql((0.03, 0.97))}
SELECT d.merchant_id, d.order_date, d.total_orders, d.total_revenue, d.total_items,
       {_j1_sql()}
FROM daily d JOIN qs q ON d.merchant_id = q.merchant_id
""")
def j1_preprocess(spark, sf_dir):
    from stallboard.operators import stats as ST
    out = ST.preprocess(_daily(spark, sf_dir))
    for m in METRICS:
        out = (out.withColumn(f"{m}_winsor", F.round(f"{m}_winsor", 6))
                  .withColumn(f"{m}_log1p", F.round(f"{m}_log1p", 9))
                  .withColumn(f"{m}_norm", F.round(f"{m}_norm", 9)))
    return out


# ------------------------------------------------------------------ E22-E24

def _box_sql():
    parts = []
    for m in METRICS:
        parts.append(f"""SELECT d.merchant_id, '{m}' AS feature, ROUND(p.{m}_q1, 4) AS q1, ROUND(p.{m}_med, 4) AS median,
       ROUND(p.{m}_q3, 4) AS q3,
       MIN(CASE WHEN d.{m} >= p.{m}_q1 - 1.5 * (p.{m}_q3 - p.{m}_q1) THEN CAST(d.{m} AS DOUBLE) END) AS whisker_low,
       MAX(CASE WHEN d.{m} <= p.{m}_q3 + 1.5 * (p.{m}_q3 - p.{m}_q1) THEN CAST(d.{m} AS DOUBLE) END) AS whisker_high,
       COUNT(*) FILTER (WHERE d.{m} < p.{m}_q1 - 1.5 * (p.{m}_q3 - p.{m}_q1)
                           OR d.{m} > p.{m}_q3 + 1.5 * (p.{m}_q3 - p.{m}_q1)) AS n_outliers
FROM daily d JOIN p ON d.merchant_id = p.merchant_id
GROUP BY d.merchant_id, p.{m}_q1, p.{m}_med, p.{m}_q3""")
    pct = ", ".join(f"quantile_cont(CAST({m} AS DOUBLE), 0.25) AS {m}_q1, quantile_cont(CAST({m} AS DOUBLE), 0.5) AS {m}_med, "
                    f"quantile_cont(CAST({m} AS DOUBLE), 0.75) AS {m}_q3" for m in METRICS)
    return f"p AS (SELECT merchant_id, {pct} FROM daily GROUP BY merchant_id)\n" + "\nUNION ALL\n".join(parts)


@register("e22_box_summary", f"""
WITH {OL}, {DAILY_SQL}, {_box_sql()}
""")
def e22_box_summary(spark, sf_dir):
    from stallboard.operators import stats as ST
    b = ST.box_summary(_daily(spark, sf_dir))
    return b.select(*[F.round(c, 4).alias(c) if c in ("q1", "median", "q3") else F.col(c) for c in b.columns])


@register("e23_histogram_revenue", f"""
WITH {OL}, {DAILY_SQL},
r AS (SELECT merchant_id, MIN(total_revenue) AS mn, MAX(total_revenue) AS mx FROM daily GROUP BY merchant_id),
b AS (SELECT d.merchant_id, r.mn, r.mx,
             CAST(CASE WHEN r.mx = r.mn THEN 1 ELSE LEAST(FLOOR((d.total_revenue - r.mn) / (r.mx - r.mn) * 30) + 1, 30) END AS INTEGER) AS bin
      FROM daily d JOIN r ON d.merchant_id = r.merchant_id)
SELECT merchant_id, bin, COUNT(*) AS count,
       ROUND(MAX(mn + (bin - 1) * ((mx - mn) / 30)), 4) AS bin_low,
       ROUND(MAX(mn + bin * ((mx - mn) / 30)), 4) AS bin_high
FROM b GROUP BY merchant_id, bin
""")
def e23_histogram_revenue(spark, sf_dir):
    from stallboard.operators import stats as ST
    h = ST.histogram(_daily(spark, sf_dir), "total_revenue", 30)
    return h.withColumn("bin_low", F.round("bin_low", 4)).withColumn("bin_high", F.round("bin_high", 4))


@register("e24_kde_orders", f"""
WITH {OL}, {DAILY_SQL},
st AS (SELECT merchant_id, COUNT(total_orders) AS n, MIN(CAST(total_orders AS DOUBLE)) AS mn,
              MAX(CAST(total_orders AS DOUBLE)) AS mx, STDDEV_SAMP(CAST(total_orders AS DOUBLE)) AS sd
       FROM daily GROUP BY merchant_id),
st2 AS (SELECT *, sd * POW(CAST(n AS DOUBLE), -0.2) AS h FROM st WHERE sd * POW(CAST(n AS DOUBLE), -0.2) > 0),
g AS (SELECT merchant_id, CAST(gi AS INTEGER) AS grid_index, mn + gi * (mx - mn) / 63 AS x, n, h
      FROM st2, range(0, 64) t(gi))
SELECT g.merchant_id, g.grid_index, ROUND(g.x, 9) AS x,
       ROUND(SUM(EXP(-0.5 * ((g.x - d.total_orders) / g.h) * ((g.x - d.total_orders) / g.h))
                 / (g.n * g.h * SQRT(2 * PI()))), 12) AS density
FROM g JOIN daily d ON g.merchant_id = d.merchant_id
GROUP BY g.merchant_id, g.grid_index, g.x
""")
def e24_kde_orders(spark, sf_dir):
    from stallboard.operators import stats as ST
    k = ST.kde(_daily(spark, sf_dir), "total_orders", 64)
    return k.withColumn("x", F.round("x", 9)).withColumn("density", F.round("density", 12)) \
            .withColumn("grid_index", F.col("grid_index").cast("int"))


# ------------------------------------------------------------------ F2-F8 windows

@register("f2_f3_item_lags_rolling", f"""
WITH {OL},
d AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id,
             MIN(item_name) AS item_name, CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold
      FROM order_lines GROUP BY 1, 2, 3)
SELECT *,
  LAG(daily_quantity_sold, 1) OVER w AS lag_1,
  LAG(daily_quantity_sold, 7) OVER w AS lag_7,
  CASE WHEN COUNT(daily_quantity_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
       THEN ROUND(AVG(CAST(daily_quantity_sold AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) END AS rolling_mean_3,
  CASE WHEN COUNT(daily_quantity_sold) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
       THEN ROUND(AVG(CAST(daily_quantity_sold AS DOUBLE)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9) END AS rolling_mean_7
FROM d
WINDOW w AS (PARTITION BY merchant_id, item_id ORDER BY order_date)
""")
def f2_f3_item_lags_rolling(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.operators import windows as W
    d = A.daily_item_quantity(V.order_lines(spark, sf_dir), by_name=False)
    d = W.add_rolling_means(W.add_lags(d, "daily_quantity_sold"), "daily_quantity_sold")
    return d.withColumn("rolling_mean_3", F.round("rolling_mean_3", 9)).withColumn("rolling_mean_7", F.round("rolling_mean_7", 9))


@register("f4_rolling_12", f"""
WITH {OL}, {DAILY_SUB_SQL}
SELECT merchant_id, order_date, total_revenue,
  CASE WHEN COUNT(total_revenue) OVER w12 = 12 THEN ROUND(AVG(total_revenue) OVER w12, 6) END AS rolling_mean_12,
  CASE WHEN COUNT(total_revenue) OVER w12 = 12 THEN ROUND(STDDEV_SAMP(total_revenue) OVER w12, 6) END AS rolling_std_12
FROM daily
WINDOW w12 AS (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def f4_rolling_12(spark, sf_dir):
    from stallboard.operators import windows as W
    d = _daily(spark, sf_dir, "subtotal").select("merchant_id", "order_date", "total_revenue")
    d = W.add_rolling_mean_std(d, "total_revenue", 12)
    return d.withColumn("rolling_mean_12", F.round("rolling_mean_12", 6)).withColumn("rolling_std_12", F.round("rolling_std_12", 6))


@register("f5_f6_diff_rolling", f"""
WITH {OL}, {DAILY_SUB_SQL},
df AS (SELECT merchant_id, order_date,
              total_revenue - LAG(total_revenue, 1) OVER (PARTITION BY merchant_id ORDER BY order_date) AS diff
       FROM daily)
SELECT merchant_id, order_date, ROUND(diff, 6) AS diff,
  CASE WHEN COUNT(diff) OVER w12 = 12 THEN ROUND(AVG(diff) OVER w12, 6) END AS diff_mean_12,
  CASE WHEN COUNT(diff) OVER w12 = 12 THEN ROUND(STDDEV_SAMP(diff) OVER w12, 6) END AS diff_std_12
FROM df WHERE diff IS NOT NULL
WINDOW w12 AS (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def f5_f6_diff_rolling(spark, sf_dir):
    from stallboard.operators import stats as ST
    from stallboard.operators import windows as W
    d = ST.difference(_daily(spark, sf_dir, "subtotal"), "total_revenue").select("merchant_id", "order_date", "diff")
    d = W.add_rolling_mean_std(d, "diff", 12, prefix="diff")
    return (d.withColumn("diff", F.round("diff", 6)).withColumn("diff_mean_12", F.round("diff_mean_12", 6))
             .withColumn("diff_std_12", F.round("diff_std_12", 6)))


@register("f7_positional_holdout", f"""
WITH {OL}, {DAILY_SQL}
SELECT merchant_id, order_date, total_revenue,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY order_date DESC) <= 30 THEN 'test' ELSE 'train' END AS split
FROM daily
""")
def f7_positional_holdout(spark, sf_dir):
    from stallboard.operators import windows as W
    return W.positional_holdout(_daily(spark, sf_dir).select("merchant_id", "order_date", "total_revenue"))


@register("f8_calendar_holdout", f"""
WITH {OL},
d AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id,
             MIN(item_name) AS item_name, CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold
      FROM order_lines GROUP BY 1, 2, 3),
s AS (SELECT *, CAST(MAX(order_date) OVER (PARTITION BY merchant_id) - INTERVAL 30 DAY AS DATE) AS split_date FROM d)
SELECT *, CASE WHEN order_date < split_date THEN 'train' ELSE 'test' END AS split FROM s
""")
def f8_calendar_holdout(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.operators import windows as W
    return W.calendar_holdout(A.daily_item_quantity(V.order_lines(spark, sf_dir), by_name=False))


# ------------------------------------------------------------------ J8, J9, J10 diagnostics

ACF_LAGS = 30


def _acf_sql(nlags=ACF_LAGS, lb=False):
    lags = ",\n    ".join(f"LAG(x, {k}) OVER (PARTITION BY merchant_id ORDER BY order_date) AS l{k}" for k in range(1, nlags + 1))
    sums = ", ".join(f"SUM(x * l{k}) AS s{k}" for k in range(1, nlags + 1))
    unp = "\n  UNION ALL ".join(f"SELECT merchant_id, {k} AS lag, s{k} AS sk, s0, n FROM s" for k in range(0, nlags + 1))
    return f"""df AS (SELECT merchant_id, order_date,
              total_revenue - LAG(total_revenue, 1) OVER (PARTITION BY merchant_id ORDER BY order_date) AS diff
       FROM daily),
dd AS (SELECT merchant_id, order_date, diff FROM df WHERE diff IS NOT NULL),
c AS (SELECT merchant_id, order_date, diff - AVG(diff) OVER (PARTITION BY merchant_id) AS x FROM dd),
lg AS (SELECT merchant_id, x,
    {lags}
  FROM c),
s AS (SELECT merchant_id, COUNT(*) AS n, SUM(x * x) AS s0, SUM(x * x) AS s_0, {sums} FROM lg GROUP BY merchant_id),
a AS ({unp.replace('s0 AS s0', 's0')})"""


@register("j9_acf_diff_revenue", f"""
WITH {OL}, {DAILY_SUB_SQL}, {_acf_sql().replace('SELECT merchant_id, 0 AS lag, s0 AS sk', 'SELECT merchant_id, 0 AS lag, s_0 AS sk')}
SELECT merchant_id, lag, ROUND(CASE WHEN s0 = 0 THEN NULL ELSE COALESCE(sk, 0) / s0 END, 9) AS acf, n FROM a
""")
def j9_acf_diff_revenue(spark, sf_dir):
    from stallboard.operators import stats as ST
    d = ST.difference(_daily(spark, sf_dir, "subtotal"), "total_revenue")
    return ST.acf(d, "diff", ACF_LAGS).withColumn("acf", F.round("acf", 9)).withColumn("lag", F.col("lag").cast("int"))


@register("j8_ljung_box_diff_revenue", f"""
WITH {OL}, {DAILY_SUB_SQL}, {_acf_sql().replace('SELECT merchant_id, 0 AS lag, s0 AS sk', 'SELECT merchant_id, 0 AS lag, s_0 AS sk')},
r AS (SELECT merchant_id, lag, n, CASE WHEN s0 = 0 THEN NULL ELSE COALESCE(sk, 0) / s0 END AS acf FROM a),
q AS (SELECT merchant_id, MAX(n) AS n, MAX(n) * (MAX(n) + 2) * SUM(acf * acf / (n - lag)) AS lb_stat
      FROM r WHERE lag BETWEEN 1 AND 10 GROUP BY merchant_id)
SELECT merchant_id, n, 10 AS lag, ROUND(lb_stat, 6) AS lb_stat,
       ROUND(EXP(-lb_stat / 2) * (1 + (lb_stat / 2) + POW(lb_stat / 2, 2) / 2 + POW(lb_stat / 2, 3) / 6
                                  + POW(lb_stat / 2, 4) / 24), 9) AS lb_pvalue
FROM q
""")
def j8_ljung_box_diff_revenue(spark, sf_dir):
    from stallboard.operators import stats as ST
    d = ST.difference(_daily(spark, sf_dir, "subtotal"), "total_revenue")
    lb = ST.ljung_box(ST.acf(d, "diff", ACF_LAGS), 10)
    return lb.withColumn("lb_stat", F.round("lb_stat", 6)).withColumn("lb_pvalue", F.round("lb_pvalue", 9))


@register("j10_pacf_diff_revenue")
def j10_pacf_diff_revenue(spark, sf_dir):
    from stallboard.operators import stats as ST
    d = ST.difference(_daily(spark, sf_dir, "subtotal"), "total_revenue")
    return ST.pacf(ST.acf(d, "diff", ACF_LAGS))



# ------------------------------------------------------------------ J2-J8 revenue models (no SQL oracle)

def _rev_daily(spark, sf_dir, revenue="order_value_lines"):
    from stallboard.plans import forecasts as PF
    return PF.daily_revenue(V.order_lines(spark, sf_dir), revenue)


@register("k4_revenue_forecast")
def k4_revenue_forecast(spark, sf_dir):
    """SARIMA(1,1,1)(1,1,1,7) on daily order-value revenue, 30 days."""
    from stallboard.plans import forecasts as PF
    _, rows, _ = PF.revenue_forecast(_rev_daily(spark, sf_dir))
    return rows


@register("e18_forecast_total_7_days")
def e18_forecast_total_7_days(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.plans import forecasts as PF
    _, rows, _ = PF.revenue_forecast(_rev_daily(spark, sf_dir))
    return A.horizon_revenue_total(rows, 7)


@register("j3_historical_evaluation")
def j3_historical_evaluation(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    fits, _, series = PF.revenue_forecast(_rev_daily(spark, sf_dir))
    return PF.historical_evaluation(fits, series)


@register("j4_arima_111_forecast")
def j4_arima_111_forecast(spark, sf_dir):
    from stallboard.operators import arima as AR
    from stallboard.plans import forecasts as PF
    _, rows, _ = PF.revenue_forecast(_rev_daily(spark, sf_dir, "subtotal"), order=AR.ARIMA_111, origin="end")
    return rows


@register("j5_arima_grid")
def j5_arima_grid(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    return PF.grid_search(_rev_daily(spark, sf_dir, "subtotal"))


@register("j6_arima_213_holdout")
def j6_arima_213_holdout(spark, sf_dir):
    from stallboard.operators import arima as AR
    from stallboard.plans import forecasts as PF
    fits, _, series = PF.revenue_forecast(_rev_daily(spark, sf_dir, "subtotal"), order=AR.ARIMA_213)
    return PF.notebook_evaluation(fits, series)


@register("j7_sarimax_holdout")
def j7_sarimax_holdout(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    return PF.sarimax_holdout(V.order_lines(spark, sf_dir))


@register("j8_residual_ljung_box")
def j8_residual_ljung_box(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    fits, _, _ = PF.revenue_forecast(_rev_daily(spark, sf_dir), residuals=True)
    return PF.residual_diagnostics(fits, 10)



# ------------------------------------------------------------------ I23-I28, E11, E20, D5 via the seasonal-naive holdout

CUTOFF = "2001-07-02"       # training cutoff for the quantity jobs: 30 days before AS_OF
HOLDOUT = 30

NAIVE_SQL = f"""s AS (SELECT merchant_id, order_date, total_revenue AS y,
             ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY order_date) AS t,
             COUNT(*) OVER (PARTITION BY merchant_id) AS n FROM daily),
te AS (SELECT merchant_id, order_date, y, t - (n - {HOLDOUT}) AS h, n FROM s WHERE t > n - {HOLDOUT}),
pairs AS (SELECT te.merchant_id, te.h, te.order_date AS forecast_date, tr.y AS forecast, te.y AS actual
          FROM te JOIN s tr ON tr.merchant_id = te.merchant_id
           AND tr.t = (te.n - {HOLDOUT}) - 7 + ((te.h - 1) % 7) + 1)"""


def _r2(x):
    return f"ROUND_EVEN(({x}) * 100, 0) / 100"


def _pct(num, den):
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE (({num}) / ({den})) * 100 END"


def _label5(f, a):
    p = _pct(f"{f} - {a}", a)
    return (f"CASE WHEN {a} = 0 AND ({f} - {a}) > 0 THEN 'Much Better than Expected' "
            f"WHEN ({p}) IS NULL THEN 'Much Worse than Expected' "
            f"WHEN ({p}) >= 10 THEN 'Much Better than Expected' "
            f"WHEN ({p}) > 0 AND ({p}) < 10 THEN 'Better than Expected' "
            f"WHEN ({p}) = 0 THEN 'As Expected' "
            f"WHEN ({p}) > -10 AND ({p}) < 0 THEN 'Worse than Expected' "
            f"ELSE 'Much Worse than Expected' END")


def _label3(a, f, future=None, inclusive=False):
    p = _pct(f"{a} - {f}", f)
    better, worse = ("Better Than Expected", "Worse Than Expected") if inclusive else \
        ("Better than Expected", "Worse than Expected")
    op = "<=" if inclusive else "<"
    fut = f"WHEN {future} THEN 'Future date' " if future else ""
    return (f"CASE {fut}WHEN {f} = 0 AND ({a} - {f}) > 0 THEN '{better}' "
            f"WHEN ({p}) IS NULL THEN '{worse}' "
            f"WHEN ABS({p}) {op} 10 THEN 'As Expected' "
            f"WHEN ({p}) > 10 THEN '{better}' ELSE '{worse}' END")


def _naive_pairs(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    return PF.seasonal_naive_holdout(_daily(spark, sf_dir).select("merchant_id", "order_date", "total_revenue"), HOLDOUT)


NAIVE_EVAL_SELECT = f"""SELECT merchant_id, h, forecast_date,
  {_r2('forecast')} AS forecasted_revenue, {_r2('actual')} AS total_revenue,
  {_r2(_pct('forecast - actual', 'actual'))} AS deviation_pct,
  {_label5('forecast', 'actual')} AS label,
  {_r2(_pct('actual - forecast', 'forecast'))} AS deviation_pct_nb,
  {_label3('actual', 'forecast')} AS label_nb,
  {_label3('actual', 'forecast', inclusive=True)} AS label_qty
FROM pairs"""


@register("j3_naive_holdout_labels", f"""
WITH {OL}, {DAILY_SQL}, {NAIVE_SQL}
{NAIVE_EVAL_SELECT}
""")
def j3_naive_holdout_labels(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    return PF.naive_evaluation(_naive_pairs(spark, sf_dir))


@register("e11_label_share", f"""
WITH {OL}, {DAILY_SQL}, {NAIVE_SQL}, ev AS ({NAIVE_EVAL_SELECT}),
c AS (SELECT merchant_id, label, COUNT(*) AS count FROM ev GROUP BY merchant_id, label)
SELECT merchant_id, label, count,
       ROUND(count * 100.0 / SUM(count) OVER (PARTITION BY merchant_id), 2) AS pct FROM c
""")
def e11_label_share(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.plans import forecasts as PF
    return A.label_histogram(PF.naive_evaluation(_naive_pairs(spark, sf_dir)), "label")


@register("e20_naive_holdout_error", f"""
WITH {OL}, {DAILY_SQL}, {NAIVE_SQL}
SELECT merchant_id, ROUND(SQRT(AVG(POW(actual - forecast, 2))), 4) AS rmse,
       ROUND(AVG(POW(actual - forecast, 2)), 2) AS mse, COUNT(*) AS n_test
FROM pairs GROUP BY merchant_id
""")
def e20_naive_holdout_error(spark, sf_dir):
    from stallboard.functions import numeric as N
    p = _naive_pairs(spark, sf_dir)
    e = F.col("actual") - F.col("forecast")
    return p.groupBy("merchant_id").agg(F.round(N.rmse(e), 4).alias("rmse"), F.round(N.mse(e), 2).alias("mse"),
                                        F.count(F.lit(1)).alias("n_test"))


@register("d5_naive_calendar_labels", f"""
WITH {OL}, {DAILY_SQL},
s AS (SELECT merchant_id, order_date, total_revenue AS y,
             ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY order_date) AS t,
             COUNT(*) OVER (PARTITION BY merchant_id) AS n FROM daily),
last AS (SELECT merchant_id, MAX(order_date) AS last_date, MAX(n) AS n FROM s WHERE t <= n - {HOLDOUT} GROUP BY merchant_id),
g AS (SELECT l.merchant_id, CAST(h AS INTEGER) AS h, CAST(l.last_date + h * INTERVAL 1 DAY AS DATE) AS forecast_date,
             (l.n - {HOLDOUT}) - 7 + ((h - 1) % 7) + 1 AS src
      FROM last l, range(1, 31) r(h)),
j AS (SELECT g.merchant_id, g.h, g.forecast_date, s.y AS forecast, d.total_revenue AS actual
      FROM g JOIN s ON s.merchant_id = g.merchant_id AND s.t = g.src
      LEFT JOIN daily d ON d.merchant_id = g.merchant_id AND d.order_date = g.forecast_date)
SELECT merchant_id, h, forecast_date, {_r2('forecast')} AS forecasted_revenue, {_r2('actual')} AS total_revenue,
       {_r2(_pct('actual - forecast', 'forecast'))} AS deviation_pct,
       {_label3('actual', 'forecast', future='actual IS NULL')} AS label
FROM j
""")
def d5_naive_calendar_labels(spark, sf_dir):
    from stallboard.plans import forecasts as PF
    return PF.naive_calendar_forecast(_daily(spark, sf_dir).select("merchant_id", "order_date", "total_revenue"))


# ------------------------------------------------------------------ E12, C11

E7_SQL = """d7 AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id,
             MIN(item_name) AS item_name, CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold
      FROM order_lines GROUP BY 1, 2, 3),
tot AS (SELECT merchant_id, item_id, SUM(daily_quantity_sold) AS total FROM d7 GROUP BY 1, 2),
top AS (SELECT merchant_id, item_id, CAST(total AS BIGINT) AS total_quantity FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY total DESC, item_id) AS rn FROM tot) WHERE rn = 1)"""


def _e7(spark, sf_dir):
    from stallboard.operators import aggregates as A
    return A.daily_item_quantity(V.order_lines(spark, sf_dir), by_name=False)


@register("e12_top_item", f"""
WITH {OL}, {E7_SQL}
SELECT merchant_id, item_id, total_quantity FROM top
""")
def e12_top_item(spark, sf_dir):
    from stallboard.operators import aggregates as A
    t = A.argmax_item(_e7(spark, sf_dir))
    return t.select("merchant_id", "item_id", F.col("total_quantity").cast("long"))


@register("c11_top_item_rows", f"""
WITH {OL}, {E7_SQL}
SELECT d7.* FROM d7 WHERE (merchant_id, item_id) IN (SELECT merchant_id, item_id FROM top)
""")
def c11_top_item_rows(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.operators import filters as C
    d = _e7(spark, sf_dir)
    return C.keep_items(d, A.argmax_item(d))


# ------------------------------------------------------------------ I-family scalar functions

@register("i_calendar_functions", f"""
WITH {OL}, {DAILY_SQL}
SELECT merchant_id, order_date,
  strftime(order_date, '%Y-%m') AS month_key, strftime(order_date, '%b') AS month_label,
  CAST(isodow(order_date) AS INTEGER) AS iso_weekday, CAST(isodow(order_date) - 1 AS INTEGER) AS weekday0,
  CAST(month(order_date) AS INTEGER) AS month, CAST(day(order_date) AS INTEGER) AS day,
  CAST(year(order_date) AS INTEGER) AS year, CAST(dayofyear(order_date) AS INTEGER) AS day_of_year,
  CAST(isodow(order_date) >= 5 AS TINYINT) AS is_weekend, CAST(day(order_date) % 10 = 0 AS INTEGER) AS promo_flag,
  strftime(order_date, '%Y-%m-%d') AS day_text, strftime(order_date, '%m-%d') AS month_day_text,
  CAST(order_date AS TIMESTAMP) AS day_start,
  CAST(order_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end,
  CAST(order_date + INTERVAL 30 DAY AS DATE) AS plus_30_days
FROM daily
""")
def i_calendar_functions(spark, sf_dir):
    from stallboard.functions import dates as D
    d = _daily(spark, sf_dir).select("merchant_id", "order_date")
    od = F.col("order_date")
    return d.select("merchant_id", "order_date",
                    D.month_key(od).alias("month_key"), D.month_label(D.month_key(od)).alias("month_label"),
                    D.iso_weekday(od).alias("iso_weekday"), D.weekday0(od).alias("weekday0"),
                    F.month(od).alias("month"), F.dayofmonth(od).alias("day"), F.year(od).alias("year"),
                    F.dayofyear(od).alias("day_of_year"), D.is_weekend(od).alias("is_weekend"),
                    D.promo_flag(od).alias("promo_flag"), D.fmt_day(od).alias("day_text"),
                    D.fmt_month_day(od).alias("month_day_text"), D.start_of_day(od).alias("day_start"),
                    D.end_of_day(od).alias("day_end"), F.date_add(od, 30).alias("plus_30_days"))


@register("i_line_time_functions", f"""
WITH {OL}
SELECT order_id, item_id, CAST(hour(order_time) AS INTEGER) AS order_hour,
       date_diff('second', order_time, delivery_time) AS order_to_delivery_seconds,
       strftime(order_time, '%Y-%m-%d %H:%M') AS order_minute_text
FROM order_lines
""")
def i_line_time_functions(spark, sf_dir):
    from stallboard.functions import dates as D
    l = V.order_lines(spark, sf_dir)
    return l.select("order_id", "item_id", D.hour_of("order_time").alias("order_hour"),
                    D.seconds_between("order_time", "delivery_time").alias("order_to_delivery_seconds"),
                    D.fmt_minute("order_time").alias("order_minute_text"))


@register("i10_order_durations", """
WITH o AS (SELECT o_orderkey AS order_id, o_orderdate AS order_time, o_orderdate + INTERVAL (60 * (o_custkey % 45) + o_orderkey % 60) SECOND AS arrival,
                  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + INTERVAL (60 * (o_custkey % 45) + o_orderkey % 60 + o_orderkey % 900) SECOND END AS pickup FROM orders),
l AS (SELECT l_orderkey AS order_id, MIN(l_shipdate) AS delivery FROM lineitem GROUP BY l_orderkey)
SELECT order_id, date_diff('second', order_time, arrival) AS time_to_arrive, date_diff('second', arrival, pickup) AS wait_to_pickup,
       date_diff('second', pickup, delivery) AS delivery_duration FROM o LEFT JOIN l USING (order_id)
""")
def i10_order_durations(spark, sf_dir):
    """I10's three differences. The given orders have one time: arrival and pickup are minutes after it by their keys (no pickup for
    finished orders), delivery is the first ship date."""
    from stallboard.functions import dates as D
    from stallboard.sources import tables
    orders = tables.read_table(spark, sf_dir, "orders")
    late = 60 * (F.col("o_custkey") % 45) + F.col("o_orderkey") % 60
    arrival = F.timestamp_add("SECOND", late, F.col("o_orderdate"))
    pickup = F.when(F.col("o_orderstatus") != "F", F.timestamp_add("SECOND", F.col("o_orderkey") % 900, F.col("driver_arrival_time")))
    delivered = tables.order_items(spark, sf_dir).groupBy("order_id").agg(F.min("delivery_time").alias("delivery_time"))
    timed = (orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_time"), arrival.alias("driver_arrival_time"), "o_orderstatus", "o_orderkey")
             .withColumn("driver_pickup_time", pickup).join(delivered, "order_id", "left"))
    return D.order_durations(timed).select("order_id", "time_to_arrive", "wait_to_pickup", "delivery_duration")


@register("i_event_hours", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, COUNT(*) AS n_events FROM events GROUP BY 1, 2
""")
def i_event_hours(spark, sf_dir):
    from stallboard.functions import dates as D
    from stallboard.sources import tables
    ev = tables.read_table(spark, sf_dir, "events")
    return ev.groupBy(D.hour_of("ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))


@register("i29_safe_item_keys", f"""
WITH {OL},
n AS (SELECT DISTINCT item_name FROM order_lines),
a AS (SELECT item_name, trim(regexp_replace(item_name, '[^a-zA-Z0-9_]+', '_', 'g'), '_') AS k FROM n)
SELECT item_name, CASE WHEN k IS NULL OR k = '' THEN 'unknown_item'
                       WHEN regexp_matches(k, '^[0-9]') THEN '_' || k ELSE k END AS safe_name,
       CASE WHEN k IS NULL OR k = '' THEN 'unknown_item'
            WHEN regexp_matches(k, '^[0-9]') THEN '_' || k ELSE k END || '_pred' AS pred_key
FROM a
""")
def i29_safe_item_keys(spark, sf_dir):
    from stallboard.functions import text as T
    n = V.order_lines(spark, sf_dir).select("item_name").distinct()
    return n.select("item_name", T.safe_key("item_name").alias("safe_name"),
                    T.add_suffix(T.safe_key("item_name")).alias("pred_key"))


K2_SQL = f"""k2 AS (SELECT order_merchant_id AS merchant_id, item_id, item_name,
       CAST(SUM(quantity) AS INTEGER) AS total_quantity,
       CAST(SUM(item_price * quantity) AS DOUBLE) AS total_sales
FROM order_lines WHERE {_lookback_sql(ITEM_DAYS)}
GROUP BY order_merchant_id, item_id, item_name HAVING SUM(quantity) > 0)"""

K3_SQL = """u AS (SELECT DISTINCT order_merchant_id AS merchant_id, order_id, order_value,
             strftime(order_time, '%Y-%m') AS month FROM order_lines),
k3 AS (SELECT merchant_id, month, CAST(SUM(order_value) AS DOUBLE) AS total_sales FROM u GROUP BY merchant_id, month)"""


def _k2(spark, sf_dir):
    return PS.item_sales_over_days(V.order_lines(spark, sf_dir), ITEM_DAYS, AS_OF)


def _k3(spark, sf_dir):
    return PS.monthly_sales(V.order_lines(spark, sf_dir))


@register("i31_item_report", f"""
WITH {OL}, {K2_SQL}
SELECT merchant_id,
       string_agg(printf('* %s: %d units (Sales: $%.2f)', item_name, total_quantity, total_sales), chr(10)
                  ORDER BY printf('* %s: %d units (Sales: $%.2f)', item_name, total_quantity, total_sales)) AS report,
       COUNT(*) AS n_items
FROM k2 GROUP BY merchant_id
""")
def i31_item_report(spark, sf_dir):
    from stallboard.plans import reports as R
    return R.item_report(_k2(spark, sf_dir))


@register("i32_i2_month_text", f"""
WITH {OL}, {K3_SQL}
SELECT merchant_id, month, strftime(strptime(month, '%Y-%m'), '%b') AS month_label,
       format('{{:,.2f}}', total_sales) AS sales_text
FROM k3
""")
def i32_i2_month_text(spark, sf_dir):
    from stallboard.functions import dates as D
    from stallboard.functions import text as T
    k = _k3(spark, sf_dir)
    return k.select("merchant_id", "month", D.month_label("month").alias("month_label"),
                    T.money_text("total_sales").alias("sales_text"))


@register("e19_sales_kpi", f"""
WITH {OL}, {K2_SQL}
SELECT merchant_id, CAST(SUM(CAST(total_sales AS DECIMAL(20,2))) AS DOUBLE) AS total_sales,
       CAST(60000.0 AS DOUBLE) AS target, SUM(CAST(total_sales AS DECIMAL(20,2))) > 60000 AS above_target
FROM k2 GROUP BY merchant_id
""")
def e19_sales_kpi(spark, sf_dir):
    from stallboard.operators import aggregates as A
    return A.sales_kpi(_k2(spark, sf_dir), 60000.0)


@register("k7_dashboard_summary", f"""
WITH {OL}, {K2_SQL}, {K3_SQL},
m AS (SELECT merchant_id, COUNT(*) AS months_with_sales,
             CAST(SUM(CAST(total_sales AS DECIMAL(20,2))) AS DOUBLE) AS all_time_sales FROM k3 GROUP BY 1),
kp AS (SELECT merchant_id, CAST(SUM(CAST(total_sales AS DECIMAL(20,2))) AS DOUBLE) AS recent_sales,
              SUM(CAST(total_sales AS DECIMAL(20,2))) > 60000 AS above_target FROM k2 GROUP BY 1)
SELECT m.merchant_id, m.months_with_sales, m.all_time_sales, kp.recent_sales, kp.above_target
FROM m LEFT JOIN kp ON m.merchant_id = kp.merchant_id
""")
def k7_dashboard_summary(spark, sf_dir):
    from stallboard.plans import reports as R
    return R.dashboard_summary(_k3(spark, sf_dir), _k2(spark, sf_dir), 60000.0)


@register("k8_chart_payload", f"""
WITH {OL}, {K3_SQL},
j AS (SELECT merchant_id, CAST(to_json(list({{'month': month, 'total_sales': CAST(total_sales AS DECIMAL(18,2))}} ORDER BY month)) AS VARCHAR) AS payload
      FROM k3 GROUP BY merchant_id)
SELECT merchant_id, CAST(length(payload) AS INTEGER) AS payload_chars,
       CASE WHEN length(payload) > 4000 THEN substring(payload, 1, 4000) || chr(10) || '... (data truncated)'
            ELSE payload END AS payload_cut
FROM j
""")
def k8_chart_payload(spark, sf_dir):
    from stallboard.plans import reports as R
    return R.chart_payload(_k3(spark, sf_dir), 4000)


@register("k9_chat_history", r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role,
                  regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations),
k AS (SELECT * FROM c WHERE length(text) > 0)
SELECT conv_id, turn, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM k
""")
def k9_chat_history(spark, sf_dir):
    from stallboard.plans import reports as R
    from stallboard.sources import tables
    return R.chat_history(tables.conversations(spark, sf_dir))


# ------------------------------------------------------------------ C5-C7, G7-G8, K6

def _ts(d):
    return f"TIMESTAMP '{d.isoformat(sep=' ')}'"


def _recency_sql(days, as_of=AS_OF):
    import datetime as dt
    from stallboard.functions.dates import as_date
    day0 = dt.datetime.combine(as_date(as_of), dt.time(0))
    lo = day0 - dt.timedelta(days=days)
    hi = day0 + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    return f"last_order_date > {_ts(lo)} AND last_order_date < {_ts(hi)}"


K1_SQL = f"""{CL},
per_name AS (SELECT merchant_id, eater_id, item_name, COUNT(*) AS n, MAX(order_time) AS latest
             FROM customer_lines WHERE eater_id IS NOT NULL GROUP BY ALL),
k1 AS (SELECT merchant_id, eater_id AS customer_id, MAX(latest) AS last_order_date, FIRST(item_name ORDER BY n DESC, item_name) AS favorite_food
       FROM per_name GROUP BY ALL)"""

ACTIVE_DAYS = 365
LAPSED_DAYS = 180
SEARCH = "widget"


def _k1(spark, sf_dir):
    return PC.customer_list(V.driver_customer_lines(spark, sf_dir))


@register("k6_reengagement_page", f"""
WITH {K1_SQL},
f AS (SELECT * FROM k1 WHERE {_recency_sql(ACTIVE_DAYS)}
        AND (contains(lower(CAST(customer_id AS VARCHAR)), '{SEARCH}')
             OR contains(lower(CAST(last_order_date AS VARCHAR)), '{SEARCH}')
             OR contains(lower(favorite_food), '{SEARCH}'))),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY last_order_date DESC, customer_id) AS row_number,
             COUNT(*) OVER (PARTITION BY merchant_id) AS row_count FROM f)
SELECT merchant_id, customer_id, last_order_date, favorite_food, row_number, row_count,
       0 AS page_index, CAST(GREATEST(1, CEIL(row_count / 20)) AS INTEGER) AS page_count
FROM r WHERE row_number BETWEEN 1 AND 20
""")
def k6_reengagement_page(spark, sf_dir):
    r = PC.reengagement(_k1(spark, sf_dir), AS_OF, active_days=ACTIVE_DAYS, search=SEARCH,
                        sort_col="last_order_date", descending=True, page_index=0, page_size=20)
    return r.select("merchant_id", "customer_id", "last_order_date", "favorite_food",
                    F.col("row_number").cast("long"), "row_count", "page_index", "page_count")


@register("g7_g8_customer_page_by_food", f"""
WITH {K1_SQL},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY favorite_food, customer_id) AS row_number,
             COUNT(*) OVER (PARTITION BY merchant_id) AS row_count FROM k1)
SELECT merchant_id, customer_id, last_order_date, favorite_food, row_number, row_count,
       1 AS page_index, CAST(GREATEST(1, CEIL(row_count / 10)) AS INTEGER) AS page_count
FROM r WHERE row_number BETWEEN 11 AND 20
""")
def g7_g8_customer_page_by_food(spark, sf_dir):
    r = PC.reengagement(_k1(spark, sf_dir), AS_OF, sort_col="favorite_food", descending=False,
                        page_index=1, page_size=10)
    return r.select("merchant_id", "customer_id", "last_order_date", "favorite_food",
                    F.col("row_number").cast("long"), "row_count", "page_index", "page_count")


@register("c6_lapsed_customers", f"""
WITH {K1_SQL}
SELECT merchant_id, customer_id, last_order_date FROM k1
WHERE last_order_date < TIMESTAMP '{AS_OF}' - INTERVAL {LAPSED_DAYS} DAY
""")
def c6_lapsed_customers(spark, sf_dir):
    from stallboard.operators import filters as C
    return C.lapsed_more_than(_k1(spark, sf_dir), LAPSED_DAYS, AS_OF).select(
        "merchant_id", "customer_id", "last_order_date")


# ------------------------------------------------------------------ B-family audits

@register("b2_distinct_lines", """
SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS merchant_id, l_partkey AS item_id,
       CAST(l_quantity AS INTEGER) AS quantity FROM lineitem
""")
def b2_distinct_lines(spark, sf_dir):
    from stallboard.operators import cleaning as B
    from stallboard.sources import tables
    return B.distinct_rows(tables.order_items(spark, sf_dir).drop("delivery_time"))


@register("b8_null_length_audit", """
SELECT 'merchants' AS table_name, 'merchant_id' AS column_name, COUNT(*) FILTER (WHERE s_suppkey IS NULL) AS null_count,
       COUNT(*) FILTER (WHERE length(CAST(s_suppkey AS VARCHAR)) > 5) AS too_long_count FROM supplier
UNION ALL SELECT 'merchants', 'merchant_name', COUNT(*) FILTER (WHERE s_name IS NULL),
       COUNT(*) FILTER (WHERE length(s_name) > 255) FROM supplier
UNION ALL SELECT 'items', 'item_id', COUNT(*) FILTER (WHERE p_partkey IS NULL), 0 FROM part
UNION ALL SELECT 'items', 'cuisine_tag', 0, COUNT(*) FILTER (WHERE length(p_type) > 100) FROM part
UNION ALL SELECT 'items', 'item_name', COUNT(*) FILTER (WHERE p_name IS NULL),
       COUNT(*) FILTER (WHERE length(p_name) > 255) FROM part
UNION ALL SELECT 'items', 'item_price', COUNT(*) FILTER (WHERE p_retailprice IS NULL), 0 FROM part
UNION ALL SELECT 'transaction_data', 'order_id', COUNT(*) FILTER (WHERE o_orderkey IS NULL),
       COUNT(*) FILTER (WHERE length(CAST(o_orderkey AS VARCHAR)) > 100) FROM orders
UNION ALL SELECT 'transaction_data', 'order_time', COUNT(*) FILTER (WHERE o_orderdate IS NULL), 0 FROM orders
UNION ALL SELECT 'transaction_data', 'order_value', COUNT(*) FILTER (WHERE o_totalprice IS NULL), 0 FROM orders
""")
def b8_null_length_audit(spark, sf_dir):
    from stallboard.operators import cleaning as B
    from stallboard.sources import tables
    parts = [B.null_length_audit(tables.merchants(spark, sf_dir), "merchants"),
             B.null_length_audit(tables.items(spark, sf_dir), "items"),
             B.null_length_audit(tables.orders(spark, sf_dir), "transaction_data")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("b9_unique_audit", """
SELECT 'merchants' AS table_name, 'merchant_id' AS key_columns, COUNT(*) AS duplicated_keys,
       CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT s_suppkey, COUNT(*) n FROM supplier GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'items', 'item_id', COUNT(*), CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
FROM (SELECT p_partkey, COUNT(*) n FROM part GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'transaction_data', 'order_id', COUNT(*), CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
FROM (SELECT o_orderkey, COUNT(*) n FROM orders GROUP BY 1 HAVING COUNT(*) > 1)
UNION ALL SELECT 'order_lines', 'order_id,line_number', COUNT(*), CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
FROM (SELECT l_orderkey, l_linenumber, COUNT(*) n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)
""")
def b9_unique_audit(spark, sf_dir):
    from stallboard.operators import cleaning as B
    from stallboard.sources import tables
    li = tables.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"))
    specs = [("merchants", "merchant_id", tables.merchants(spark, sf_dir), ["merchant_id"]),
             ("items", "item_id", tables.items(spark, sf_dir), ["item_id"]),
             ("transaction_data", "order_id", tables.orders(spark, sf_dir), ["order_id"]),
             ("order_lines", "order_id,line_number", li, ["order_id", "line_number"])]
    out = None
    for t, k, df, keys in specs:
        a = B.unique_audit(df, keys).select(F.lit(t).alias("table_name"), F.lit(k).alias("key_columns"),
                                            "duplicated_keys", "surplus_rows")
        out = a if out is None else out.unionByName(a)
    return out


@register("b10_fk_audit", """
SELECT 'order_lines.order_id -> transaction_data' AS relation, COUNT(*) AS orphan_rows
FROM lineitem l WHERE l.l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'order_lines.item_id -> items', COUNT(*)
FROM lineitem l WHERE l.l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL SELECT 'order_lines.merchant_id -> merchants', COUNT(*)
FROM lineitem l WHERE l.l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
""")
def b10_fk_audit(spark, sf_dir):
    from stallboard.operators import cleaning as B
    from stallboard.sources import tables
    li = tables.order_items(spark, sf_dir)
    specs = [("order_lines.order_id -> transaction_data", "order_id", tables.orders(spark, sf_dir), "order_id"),
             ("order_lines.item_id -> items", "item_id", tables.items(spark, sf_dir), "item_id"),
             ("order_lines.merchant_id -> merchants", "merchant_id", tables.merchants(spark, sf_dir), "merchant_id")]
    out = None
    for rel, cc, parent, pc in specs:
        a = B.foreign_key_audit(li, cc, parent, pc).select(F.lit(rel).alias("relation"), "orphan_rows")
        out = a if out is None else out.unionByName(a)
    return out


@register("b13_null_audit_order_lines", f"""
WITH {OL}
SELECT 'order_id' AS column_name, COUNT(*) FILTER (WHERE order_id IS NULL) AS null_count FROM order_lines
UNION ALL SELECT 'order_merchant_id', COUNT(*) FILTER (WHERE order_merchant_id IS NULL) FROM order_lines
UNION ALL SELECT 'item_id', COUNT(*) FILTER (WHERE item_id IS NULL) FROM order_lines
UNION ALL SELECT 'item_name', COUNT(*) FILTER (WHERE item_name IS NULL) FROM order_lines
UNION ALL SELECT 'item_price', COUNT(*) FILTER (WHERE item_price IS NULL) FROM order_lines
UNION ALL SELECT 'quantity', COUNT(*) FILTER (WHERE quantity IS NULL) FROM order_lines
UNION ALL SELECT 'subtotal', COUNT(*) FILTER (WHERE subtotal IS NULL) FROM order_lines
UNION ALL SELECT 'item_merchant_id', COUNT(*) FILTER (WHERE item_merchant_id IS NULL) FROM order_lines
UNION ALL SELECT 'merchant_name', COUNT(*) FILTER (WHERE merchant_name IS NULL) FROM order_lines
UNION ALL SELECT 'order_value', COUNT(*) FILTER (WHERE order_value IS NULL) FROM order_lines
UNION ALL SELECT 'order_time', COUNT(*) FILTER (WHERE order_time IS NULL) FROM order_lines
UNION ALL SELECT 'driver_arrival_time', COUNT(*) FROM order_lines
UNION ALL SELECT 'driver_pickup_time', COUNT(*) FROM order_lines
UNION ALL SELECT 'delivery_time', COUNT(*) FILTER (WHERE delivery_time IS NULL) FROM order_lines
UNION ALL SELECT 'eater_id', COUNT(*) FILTER (WHERE eater_id IS NULL) FROM order_lines
""")
def b13_null_audit_order_lines(spark, sf_dir):
    from stallboard.operators import cleaning as B
    return B.dtype_null_audit(V.order_lines(spark, sf_dir)).select("column_name", "null_count")


def _profile_sql():
    cols = ["quantity", "item_price", "order_value", "subtotal"]
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count,
  ROUND(AVG({x}), 6) AS mean, ROUND(STDDEV_SAMP({x}), 6) AS sd,
  ROUND(quantile_cont({x}, 0.0), 6) AS p0, ROUND(quantile_cont({x}, 0.25), 6) AS p25,
  ROUND(quantile_cont({x}, 0.5), 6) AS p50, ROUND(quantile_cont({x}, 0.75), 6) AS p75,
  ROUND(quantile_cont({x}, 1.0), 6) AS p100 FROM order_lines""")
    return "\nUNION ALL\n".join(parts)


@register("b15_profile_order_lines", f"""
WITH {OL}
{_profile_sql()}
""")
def b15_profile_order_lines(spark, sf_dir):
    from stallboard.operators import cleaning as B
    p = B.profile(V.order_lines(spark, sf_dir), ["quantity", "item_price", "order_value", "subtotal"])
    return p.select("column_name", "n", "null_count",
                    *[F.round(c, 6).alias(c) for c in ["mean", "sd", "p0", "p25", "p50", "p75", "p100"]])


# ------------------------------------------------------------------ D1, D6, A6

@register("d1_order_lines", f"""
WITH {OL}
SELECT order_id, order_merchant_id, item_id, item_name, item_price, quantity, subtotal, item_merchant_id,
       merchant_name, order_value, order_time, CAST(NULL AS TIMESTAMP) AS driver_arrival_time,
       CAST(NULL AS TIMESTAMP) AS driver_pickup_time, delivery_time, eater_id
FROM order_lines
""")
def d1_order_lines(spark, sf_dir):
    return V.order_lines(spark, sf_dir)


@register("d6_horizon_grid", f"""
WITH {OL},
it AS (SELECT DISTINCT order_merchant_id AS merchant_id, item_id FROM order_lines
       WHERE order_time < TIMESTAMP '{CUTOFF}' + INTERVAL 1 DAY)
SELECT merchant_id, item_id, CAST(h AS INTEGER) AS h, CAST(DATE '{CUTOFF}' + h * INTERVAL 1 DAY AS DATE) AS order_date
FROM it, range(1, 31) r(h)
""")
def d6_horizon_grid(spark, sf_dir):
    from stallboard.operators import quantity as Q
    from stallboard.plans import quantity as PQ
    return Q.horizon_frame(PQ.training_lines(V.order_lines(spark, sf_dir), CUTOFF), CUTOFF, 30).select(
        "merchant_id", "item_id", "h", "order_date")


@register("a6_parameterised_item_sales", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, item_id, item_name,
       CAST(SUM(quantity) AS INTEGER) AS total_quantity,
       CAST(SUM(item_price * quantity) AS DOUBLE) AS total_sales
FROM order_lines
WHERE {_lookback_sql(ITEM_DAYS)}
GROUP BY order_merchant_id, item_id, item_name
HAVING SUM(quantity) > 0
""")
def a6_parameterised_item_sales(spark, sf_dir):
    """A6 + A8: SQL text with named parameters over the registered view."""
    from stallboard.functions.dates import lookback_bounds
    V.register_order_lines(spark, sf_dir)
    lo, hi = lookback_bounds(AS_OF, ITEM_DAYS)
    return spark.sql("""
        SELECT order_merchant_id AS merchant_id, item_id, item_name,
               CAST(SUM(quantity) AS INT) AS total_quantity,
               CAST(SUM(CAST(item_price * quantity AS DECIMAL(20,2))) AS DOUBLE) AS total_sales
        FROM combined_order_view
        WHERE order_time >= CAST(:start_date AS TIMESTAMP_NTZ) AND order_time <= CAST(:end_date AS TIMESTAMP_NTZ)
        GROUP BY order_merchant_id, item_id, item_name
        HAVING SUM(quantity) > 0""", args={"start_date": lo.isoformat(sep=" "), "end_date": hi.isoformat(sep=" ")})


# ------------------------------------------------------------------ K5 / J12-J17 (Spark ML, no SQL oracle)

_MODELS: dict[tuple[str, str], str] = {}


def _saved_model(spark, sf_dir) -> str:
    """Path of K5's model for these tables: the first query that scores by it fits it on its own panel and saves it there,
    once per application."""
    import uuid

    from stallboard.session import checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = f"{checkpoint_dir(spark)}/quantity-model-{uuid.uuid4().hex}"
    return _MODELS[key]


@register("k5_quantity_forecast")
def k5_quantity_forecast(spark, sf_dir):
    from stallboard.plans import quantity as PQ
    return PQ.quantity_forecast(V.order_lines(spark, sf_dir), CUTOFF, 30)


@register("e16_wide_forecast_records")
def e16_wide_forecast_records(spark, sf_dir):
    from stallboard.operators import quantity as Q
    from stallboard.plans import quantity as PQ
    return Q.wide_records(PQ.item_quantities(V.order_lines(spark, sf_dir), CUTOFF, 30, model_path=_saved_model(spark, sf_dir)))


@register("e17_forecast_item_totals_7_days")
def e17_forecast_item_totals_7_days(spark, sf_dir):
    from stallboard.operators import aggregates as A
    from stallboard.plans import quantity as PQ
    return A.horizon_item_totals(PQ.item_quantities(V.order_lines(spark, sf_dir), CUTOFF, 30, model_path=_saved_model(spark, sf_dir)), 7)


@register("j13_quantity_lags_holdout")
def j13_quantity_lags_holdout(spark, sf_dir):
    from stallboard.plans import quantity as PQ
    return PQ.notebook_model(V.order_lines(spark, sf_dir), "lags")


@register("j14_quantity_rolling_holdout")
def j14_quantity_rolling_holdout(spark, sf_dir):
    from stallboard.plans import quantity as PQ
    return PQ.notebook_model(V.order_lines(spark, sf_dir), "rolling")


@register("j15_quantity_encoded_holdout")
def j15_quantity_encoded_holdout(spark, sf_dir):
    from stallboard.plans import quantity as PQ
    return PQ.notebook_model(V.order_lines(spark, sf_dir), "encoded")


@register("j11_adf_revenue")
def j11_adf_revenue(spark, sf_dir):
    """J11 on the level and on the differenced daily revenue (notebook series)."""
    from stallboard.operators import stats as ST
    d = _rev_daily(spark, sf_dir, "subtotal").select("merchant_id", "order_date", "total_revenue")
    w = Window.partitionBy("merchant_id").orderBy("order_date")
    d = d.withColumn("_diff", F.col("total_revenue") - F.lag("total_revenue").over(w))
    both = d.select("merchant_id", "order_date", F.explode(F.array(
        F.struct(F.lit("level").alias("series"), F.col("total_revenue").alias("y")),
        F.struct(F.lit("diff").alias("series"), F.col("_diff").alias("y")))).alias("_s"))
    both = both.select("merchant_id", "_s.series", "order_date", "_s.y").where(F.col("y").isNotNull())
    return ST.adf(both, "y", keys=("merchant_id", "series"))


@register("j15_item_label_encoding", f"""
WITH {OL}
SELECT item_id, CAST(DENSE_RANK() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_id_encoded
FROM (SELECT DISTINCT item_id FROM order_lines WHERE order_time < TIMESTAMP '{CUTOFF}' + INTERVAL 1 DAY)
""")
def j15_item_label_encoding(spark, sf_dir):
    """J15's encoding alone: codes of the items sold before the training cutoff."""
    from stallboard.operators import filters as C
    from stallboard.operators import quantity as Q
    return Q.dense_codes(C.before_cutoff(V.order_lines(spark, sf_dir), CUTOFF), "item_id")


@register("d5_forecast_vs_actual_by_date")
def d5_forecast_vs_actual_by_date(spark, sf_dir):
    """K4's SARIMA forecast (dated from the train end) left-joined to the actual daily revenue."""
    from stallboard.plans import forecasts as PF
    daily = _rev_daily(spark, sf_dir)
    _, rows, _ = PF.revenue_forecast(daily)
    return PF.forecast_vs_actual(rows, daily, "left")


@register("k7_dashboard_bundle")
def k7_dashboard_bundle(spark, sf_dir):
    """K7: K3 + K2(30 days) + E19 + K4 + K5 per merchant."""
    from stallboard.plans import forecasts as PF
    from stallboard.plans import quantity as PQ
    from stallboard.plans import reports as R
    from stallboard.session import passing_table, table_of
    joined = V.order_lines(spark, sf_dir).select("order_id", "order_merchant_id", "item_id", "item_name", "item_price", "quantity",
                                                 "subtotal", "order_value", "order_time")
    with passing_table(joined) as lines:   # read by all four jobs: one join of the lines with their orders
        _, rev, _ = PF.revenue_forecast(PF.daily_revenue(lines))
        months, items = table_of(PS.monthly_sales(lines)), table_of(PS.item_sales_over_days(lines, ITEM_DAYS, AS_OF))
        qty = PQ.item_quantities(lines, CUTOFF, 30, model_path=_saved_model(spark, sf_dir))
    return R.dashboard_bundle(months, items, rev, qty, 60000.0, 30)


from stallboard import registry_forms, registry_stores  # noqa: E402, F401 - register their queries


#: Queries that a run meets first, before the model fits: quick ones that it must not miss.
FIRST = ("j3_naive_holdout_labels", "i10_order_durations")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: QUERIES[name] for name in FIRST} | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
