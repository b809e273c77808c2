"""Further registered queries: reshaped forecasts over models that SQL can state, the panel keyed
by item name, the cleaning family, and the sorted and single-merchant forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallboard.operators import aggregates as A
from stallboard.operators import cleaning as B
from stallboard.operators import filters as C
from stallboard.operators import ordering as G
from stallboard.operators import quantity as Q
from stallboard.operators import stats as ST
from stallboard.operators import views as V
from stallboard.plans import customers as PC
from stallboard.plans import forecasts as PF
from stallboard.plans import naive as NV
from stallboard.plans import quantity as PQ
from stallboard.plans import reports as R
from stallboard.plans import sales as PS
from stallboard.registry import (AS_OF, CUTOFF, DAILY_SQL, DAILY_SUB_SQL, HOLDOUT, ITEM_DAYS, K1_SQL, K2_SQL, K3_SQL, METRICS, OL, _acf_sql,
                                 _daily, _k1, _k2, _k3, _label3, _lookback_sql, _pct, _r2, register)
from stallboard.sources import tables

MERCHANT = 7


def _lines(spark, sf_dir):
    return V.order_lines(spark, sf_dir)


# ------------------------------------------------------------------ item forecasts by weekday mean

WEEKDAY_SQL = f"""train AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id, item_name,
                  CAST(SUM(quantity) AS BIGINT) AS q
           FROM order_lines WHERE order_time < TIMESTAMP '{CUTOFF}' + INTERVAL 1 DAY GROUP BY 1, 2, 3, 4),
nm AS (SELECT merchant_id, item_id, item_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id, item_id
              ORDER BY order_date DESC, item_name DESC) AS rn FROM train) WHERE rn = 1),
wd AS (SELECT merchant_id, item_id, ISODOW(order_date) AS wd, SUM(q) / COUNT(q) AS m FROM train GROUP BY 1, 2, 3),
al AS (SELECT merchant_id, item_id, SUM(q) / COUNT(q) AS m FROM train GROUP BY 1, 2),
safe AS (SELECT *, regexp_replace(regexp_replace(item_name, '[^\\w]+', '_', 'g'), '^_+|_+$', '', 'g') AS s0 FROM nm),
fc AS (SELECT s.merchant_id, CAST(h AS INTEGER) AS h, CAST(DATE '{CUTOFF}' + h * INTERVAL 1 DAY AS DATE) AS order_date, s.item_id, s.item_name,
              CASE WHEN s0 = '' THEN 'unknown_item' WHEN regexp_matches(s0, '^[0-9]') THEN '_' || s0 ELSE s0 END AS safe_name,
              COALESCE(wd.m, al.m) AS prediction,
              CAST(GREATEST(0, ROUND_EVEN(COALESCE(wd.m, al.m), 0)) AS INTEGER) AS predicted_quantity
       FROM safe s CROSS JOIN range(1, 31) r(h)
       JOIN al ON al.merchant_id = s.merchant_id AND al.item_id = s.item_id
       LEFT JOIN wd ON wd.merchant_id = s.merchant_id AND wd.item_id = s.item_id
            AND wd.wd = ISODOW(CAST(DATE '{CUTOFF}' + h * INTERVAL 1 DAY AS DATE)))"""

D7_SQL = """d7 AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_id,
             CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold FROM order_lines GROUP BY 1, 2, 3)"""
PAIRS_SQL = """pr AS (SELECT fc.*, d7.daily_quantity_sold FROM fc JOIN d7 ON d7.merchant_id = fc.merchant_id
             AND d7.order_date = fc.order_date AND d7.item_id = fc.item_id)"""


def _weekday(spark, sf_dir):
    return NV.weekday_mean_forecast(PQ.training_panel(_lines(spark, sf_dir), CUTOFF), CUTOFF)


def _weekday_items(spark, sf_dir):
    return NV.weekday_items(PQ.training_panel(_lines(spark, sf_dir), CUTOFF))


def _sold(spark, sf_dir):
    return A.daily_item_quantity(_lines(spark, sf_dir), by_name=False)


def _pairs(spark, sf_dir):
    return NV.with_actuals(_weekday_items(spark, sf_dir), _sold(spark, sf_dir), CUTOFF, how="inner")


@register("j16_weekday_mean_forecast", f"""
WITH {OL}, {WEEKDAY_SQL}
SELECT merchant_id, h, order_date, item_id, item_name, safe_name, predicted_quantity FROM fc
""")
def j16_weekday_mean_forecast(spark, sf_dir):
    """D6 + D8 + J16 + I21 over the weekday means."""
    return _weekday(spark, sf_dir).drop("prediction")


@register("e16_weekday_mean_records", f"""
WITH {OL}, {WEEKDAY_SQL}
SELECT merchant_id, order_date, safe_name || '_pred' AS record_key, CAST(SUM(predicted_quantity) AS BIGINT) AS quantity
FROM fc GROUP BY 1, 2, 3
""")
def e16_weekday_mean_records(spark, sf_dir):
    """E16 in long form: one row per merchant, date and record key."""
    return Q.long_records(NV.weekday_quantities(_weekday_items(spark, sf_dir), CUTOFF))


@register("e17_weekday_mean_totals_7_days", f"""
WITH {OL}, {WEEKDAY_SQL},
f AS (SELECT merchant_id, safe_name, h, order_date, SUM(predicted_quantity) AS v FROM fc WHERE h <= 7 GROUP BY 1, 2, 3, 4)
SELECT merchant_id, safe_name, h, order_date, CAST(v AS BIGINT) AS daily_value,
       CAST(SUM(v) OVER (PARTITION BY merchant_id, safe_name) AS BIGINT) AS total_value, 7 AS forecast_period_days FROM f
""")
def e17_weekday_mean_totals_7_days(spark, sf_dir):
    """E17 with its period and daily breakdown."""
    return NV.breakdown(_weekday(spark, sf_dir), "predicted_quantity", 7, ("merchant_id", "safe_name"))


@register("e13_weekday_mean_totals", f"""
WITH {OL}, {WEEKDAY_SQL}, {D7_SQL}, {PAIRS_SQL}
SELECT merchant_id, item_id, order_date, {_r2('SUM(predicted_quantity)')} AS predicted_total,
       {_r2('SUM(daily_quantity_sold)')} AS actual_total FROM pr GROUP BY 1, 2, 3
""")
def e13_weekday_mean_totals(spark, sf_dir):
    return A.forecast_actual_totals(_pairs(spark, sf_dir))


@register("j17_weekday_mean_results", f"""
WITH {OL}, {WEEKDAY_SQL}, {D7_SQL}, {PAIRS_SQL}
SELECT merchant_id, item_id, order_date AS forecast_date, {_r2('prediction')} AS forecasted_quantity,
       CAST(daily_quantity_sold AS DOUBLE) AS actual_quantity,
       {_r2(_pct('daily_quantity_sold - prediction', 'prediction'))} AS deviation_pct,
       {_label3('daily_quantity_sold', 'prediction', inclusive=True)} AS label FROM pr
""")
def j17_weekday_mean_results(spark, sf_dir):
    """J17 with I24 and I28 over the days that were forecast and sold."""
    return NV.results(_pairs(spark, sf_dir))


PIVOT_ITEMS = (11, 12, 13, 14, 15)


@register("e15_weekday_mean_pivot", f"""
WITH {OL}, {WEEKDAY_SQL}, {D7_SQL},
pr AS (SELECT fc.*, d7.daily_quantity_sold FROM fc LEFT JOIN d7 ON d7.merchant_id = fc.merchant_id
             AND d7.order_date = fc.order_date AND d7.item_id = fc.item_id)
SELECT merchant_id, order_date AS forecast_date,
       {', '.join(f"MAX(CASE WHEN item_id = {i} THEN {_r2('prediction')} END) AS item_{i}_pred, MAX(CASE WHEN item_id = {i} THEN CAST(daily_quantity_sold AS DOUBLE) END) AS item_{i}_actual" for i in PIVOT_ITEMS)}
FROM pr GROUP BY 1, 2
""")
def e15_weekday_mean_pivot(spark, sf_dir):
    """E15 + D7: predicted and actual columns of five items, for every merchant and forecast day."""
    items = _weekday_items(spark, sf_dir)
    # a merchant has a row per forecast day whatever it sells; only the five items have columns
    days = Q.fan_out(items.select("merchant_id").distinct(), CUTOFF, 30).select("merchant_id", F.col("order_date").alias("forecast_date"))
    pairs = NV.with_actuals(items.where(F.col("item_id").isin(*PIVOT_ITEMS)), _sold(spark, sf_dir), CUTOFF)
    return Q.pivot_pred_actual(NV.results(pairs), list(PIVOT_ITEMS), days)


# ------------------------------------------------------------------ revenue forecasts by the last season

CALENDAR_SQL = f"""s AS (SELECT merchant_id, order_date, total_revenue AS y,
             ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY order_date) AS t,
             COUNT(*) OVER (PARTITION BY merchant_id) AS n FROM daily),
last AS (SELECT merchant_id, MAX(order_date) AS last_date, MAX(n) AS n FROM s WHERE t <= n - {HOLDOUT} GROUP BY merchant_id),
g AS (SELECT l.merchant_id, CAST(h AS INTEGER) AS h, CAST(l.last_date + h * INTERVAL 1 DAY AS DATE) AS forecast_date,
             (l.n - {HOLDOUT}) - 7 + ((h - 1) % 7) + 1 AS src FROM last l, range(1, 31) r(h)),
cal AS (SELECT g.merchant_id, g.h, g.forecast_date, {_r2('s.y')} AS f, d.total_revenue AS a
        FROM g JOIN s ON s.merchant_id = g.merchant_id AND s.t = g.src
        LEFT JOIN daily d ON d.merchant_id = g.merchant_id AND d.order_date = g.forecast_date)"""


def _calendar(spark, sf_dir):
    daily = _daily(spark, sf_dir).select("merchant_id", "order_date", "total_revenue")
    rows = PF.naive_calendar_forecast(daily).select("merchant_id", F.lit("seasonal_naive").alias("model"), "h",
                                                    "forecast_date", "forecasted_revenue")
    return daily, rows


@register("d4_naive_forecast_on_sold_days", f"""
WITH {OL}, {DAILY_SQL}, {CALENDAR_SQL}
SELECT merchant_id, 'seasonal_naive' AS model, h, forecast_date, f AS forecasted_revenue, {_r2('a')} AS total_revenue,
       {_r2(_pct('a - f', 'f'))} AS deviation_pct, {_label3('a', 'f')} AS label
FROM cal WHERE a IS NOT NULL
""")
def d4_naive_forecast_on_sold_days(spark, sf_dir):
    """The inner form of the forecast-actual merge."""
    daily, rows = _calendar(spark, sf_dir)
    return PF.forecast_vs_actual(rows, daily, "inner")


@register("e18_naive_total_7_days", f"""
WITH {OL}, {DAILY_SQL}, {CALENDAR_SQL}
SELECT merchant_id, h, forecast_date AS order_date, f AS daily_value, 7 AS forecast_period_days,
       {_r2('SUM(f) OVER (PARTITION BY merchant_id)')} AS total_value
FROM cal WHERE h <= 7
""")
def e18_naive_total_7_days(spark, sf_dir):
    """E18 with its daily breakdown."""
    from stallboard.functions import numeric as N
    _, rows = _calendar(spark, sf_dir)
    out = NV.breakdown(rows.withColumnRenamed("forecast_date", "order_date"), "forecasted_revenue", 7)
    return out.withColumn("total_value", N.round2("total_value"))


@register("k7_bundle_long", f"""
WITH {OL}, {DAILY_SQL}, {CALENDAR_SQL}, {K2_SQL}, {K3_SQL}
SELECT merchant_id, 'month' AS section, month AS entry, ROUND(total_sales, 2) AS value FROM k3
UNION ALL SELECT merchant_id, 'item', CAST(item_id AS VARCHAR), ROUND(total_sales, 2) FROM k2
UNION ALL SELECT merchant_id, 'recent sales', NULL, ROUND(CAST(SUM(CAST(total_sales AS DECIMAL(20,2))) AS DOUBLE), 2) FROM k2 GROUP BY merchant_id
UNION ALL SELECT merchant_id, 'revenue forecast', strftime(forecast_date, '%Y-%m-%d'), ROUND(f, 2) FROM cal
""")
def k7_bundle_long(spark, sf_dir):
    """K7 as rows: history and forecast of every merchant, whatever the size of its catalogue."""
    _, rows = _calendar(spark, sf_dir)
    return R.bundle_long(_k3(spark, sf_dir), _k2(spark, sf_dir), rows)


@register("k7_bundle_with_quantities", f"""
WITH {OL}, {DAILY_SQL}, {CALENDAR_SQL}, {K2_SQL}, {K3_SQL}, {WEEKDAY_SQL}
SELECT merchant_id, 'month' AS section, month AS entry, ROUND(total_sales, 2) AS value FROM k3
UNION ALL SELECT merchant_id, 'item', CAST(item_id AS VARCHAR), ROUND(total_sales, 2) FROM k2
UNION ALL SELECT merchant_id, 'recent sales', NULL, ROUND(CAST(SUM(CAST(total_sales AS DECIMAL(20,2))) AS DOUBLE), 2) FROM k2 GROUP BY merchant_id
UNION ALL SELECT merchant_id, 'target passed', NULL, CASE WHEN SUM(CAST(total_sales AS DECIMAL(20,2))) > 60000 THEN 1.0 ELSE 0.0 END FROM k2 GROUP BY merchant_id
UNION ALL SELECT merchant_id, 'revenue forecast', strftime(forecast_date, '%Y-%m-%d'), ROUND(f, 2) FROM cal
UNION ALL SELECT merchant_id, 'item forecast', safe_name, CAST(SUM(predicted_quantity) AS DOUBLE) FROM fc WHERE h <= 7 GROUP BY merchant_id, safe_name
""")
def k7_bundle_with_quantities(spark, sf_dir):
    """K7 as rows with the items' forecast totals (weekday means) and the target flag."""
    _, rows = _calendar(spark, sf_dir)
    return R.bundle_long(_k3(spark, sf_dir), _k2(spark, sf_dir), rows, _weekday(spark, sf_dir), 60000.0, 7)


# ------------------------------------------------------------------ the panel keyed by item name

NAME_PANEL_SQL = f"""nd AS (SELECT order_merchant_id AS merchant_id, CAST(order_time AS DATE) AS order_date, item_name AS item_id,
             CAST(SUM(quantity) AS BIGINT) AS daily_quantity_sold FROM order_lines GROUP BY 1, 2, 3),
pn AS (SELECT *, LAG(daily_quantity_sold, 1) OVER w AS lag_1, LAG(daily_quantity_sold, 7) OVER w AS lag_7,
         CASE WHEN COUNT(daily_quantity_sold) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
              THEN ROUND(AVG(CAST(daily_quantity_sold AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) END AS rolling_mean_3,
         CASE WHEN COUNT(daily_quantity_sold) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
              THEN ROUND(AVG(CAST(daily_quantity_sold AS DOUBLE)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 9) END AS rolling_mean_7
       FROM nd WINDOW w AS (PARTITION BY merchant_id, item_id ORDER BY order_date)),
pk AS (SELECT * FROM pn WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND rolling_mean_3 IS NOT NULL AND rolling_mean_7 IS NOT NULL),
sd AS (SELECT merchant_id, CAST(MAX(order_date) - INTERVAL 30 DAY AS DATE) AS split_date FROM pk GROUP BY 1),
ps AS (SELECT pk.*, sd.split_date, CASE WHEN pk.order_date < sd.split_date THEN 'train' ELSE 'test' END AS split
       FROM pk JOIN sd ON sd.merchant_id = pk.merchant_id)"""


@register("j14_feature_panel_by_name", f"""
WITH {OL}, {NAME_PANEL_SQL}
SELECT merchant_id, item_id, order_date, daily_quantity_sold, lag_1, lag_7, rolling_mean_3, rolling_mean_7, split_date, split FROM ps
""")
def j14_feature_panel_by_name(spark, sf_dir):
    """F2, F3, B11 and F8 over the series of each (merchant, item name)."""
    p = PQ.notebook_panel(_lines(spark, sf_dir), "rolling", "item_name")
    return p.select("merchant_id", "item_id", "order_date", "daily_quantity_sold", "lag_1", "lag_7",
                    F.round("rolling_mean_3", 9).alias("rolling_mean_3"), F.round("rolling_mean_7", 9).alias("rolling_mean_7"),
                    "split_date", "split")


@register("j15_name_encoding", f"""
WITH {OL}, {NAME_PANEL_SQL}
SELECT item_id, CAST(DENSE_RANK() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_id_encoded
FROM (SELECT DISTINCT item_id FROM ps WHERE split = 'train')
""")
def j15_name_encoding(spark, sf_dir):
    panel = PQ.notebook_panel(_lines(spark, sf_dir), "encoded", "item_name")
    return Q.dense_codes(panel.where("split = 'train'"), "item_id")


@register("j13_quantity_lags_by_name")
def j13_quantity_lags_by_name(spark, sf_dir):
    return PQ.notebook_model(_lines(spark, sf_dir), "lags", item_key="item_name")


@register("j14_quantity_rolling_by_name")
def j14_quantity_rolling_by_name(spark, sf_dir):
    return PQ.notebook_model(_lines(spark, sf_dir), "rolling", item_key="item_name")


@register("j15_quantity_encoded_by_name")
def j15_quantity_encoded_by_name(spark, sf_dir):
    return PQ.notebook_model(_lines(spark, sf_dir), "encoded", unseen="keep", item_key="item_name")


# ------------------------------------------------------------------ J10, J11 with SQL

PACF_LAGS = 10


@register("j10_pacf_10_lags", f"""
WITH RECURSIVE {OL}, {DAILY_SUB_SQL}, {_acf_sql(PACF_LAGS).replace('SELECT merchant_id, 0 AS lag, s0 AS sk', 'SELECT merchant_id, 0 AS lag, s_0 AS sk')},
rr AS (SELECT merchant_id, list(COALESCE(sk, 0) / s0 ORDER BY lag) AS r FROM a WHERE s0 > 0 GROUP BY merchant_id),
dl AS (
  SELECT merchant_id, 0 AS lag, r, CAST([] AS DOUBLE[]) AS phi, CAST(1.0 AS DOUBLE) AS v, CAST(1.0 AS DOUBLE) AS pacf FROM rr
  UNION ALL
  SELECT merchant_id, lag + 1, r,
         list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - k * phi[lag + 1 - j]), k), v * (1 - k * k), k
  FROM (SELECT *, (r[lag + 2] - COALESCE(list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[lag + 2 - j])), 0)) / v AS k
        FROM dl WHERE lag < {PACF_LAGS}))
SELECT merchant_id, CAST(lag AS INTEGER) AS lag, ROUND(pacf, 8) AS pacf FROM dl
""")
def j10_pacf_10_lags(spark, sf_dir):
    d = ST.difference(_daily(spark, sf_dir, "subtotal"), "total_revenue")
    return ST.pacf(ST.acf(d, "diff", PACF_LAGS)).withColumn("pacf", F.round("pacf", 8))


@register("j11_dickey_fuller_lag_0", f"""
WITH {OL}, {DAILY_SUB_SQL},
x AS (SELECT merchant_id, LAG(total_revenue) OVER w AS l, total_revenue - LAG(total_revenue) OVER w AS d
      FROM daily WINDOW w AS (PARTITION BY merchant_id ORDER BY order_date)),
s AS (SELECT merchant_id, COUNT(l) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy
      FROM x WHERE l IS NOT NULL GROUP BY merchant_id)
SELECT merchant_id, n AS nobs, ROUND(b / SQRT((syy - b * sxy) / (n - 2) / sxx), 6) AS adf_stat FROM s
""")
def j11_dickey_fuller_lag_0(spark, sf_dir):
    """J11 with no augmenting lag: all sums are Spark aggregates."""
    d = _daily(spark, sf_dir, "subtotal").select("merchant_id", "order_date", "total_revenue")
    return ST.dickey_fuller(d, "total_revenue").withColumn("adf_stat", F.round("adf_stat", 6))


# ------------------------------------------------------------------ cleaning family

@register("b1_keep_first_line", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem) WHERE rn = 1
""")
def b1_keep_first_line(spark, sf_dir):
    """B1 on the repeated line keys: the first by ship date, then by the other columns."""
    line = tables.read_table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    kept = B.keep_first(line, ["l_orderkey", "l_linenumber"], F.struct(*order))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@register("b4_b5_b6_join_date", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS join_date FROM orders
""")
def b4_b5_b6_join_date(spark, sf_dir):
    """B4 + B5 + B6 (I14): day-month-year text that lost its leading zero, back to a date in place."""
    text = F.regexp_replace(F.date_format("o_orderdate", "ddMMyyyy"), "^0", "")
    raw = tables.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", text.alias("join_date"))
    return B.clean_join_date(raw)


@register("b3_b7_b14_column_names", """
SELECT c_custkey AS cust_key, c_name AS name_of_customer, c_nationkey AS nation_key, c_mktsegment AS nation_key_1 FROM customer
""")
def b3_b7_b14_column_names(spark, sf_dir):
    """B14 (first of equal names), B3 (drop) and B7 (snake case, repeats numbered)."""
    raw = tables.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Name of Customer"), F.col("c_nationkey").alias("nationKey"),
        F.col("c_acctbal").alias("CustKey"), F.col("c_mktsegment").alias("Nation-Key"), F.col("c_acctbal").alias("dropped"))
    return B.snake_case_columns(B.drop_columns(B.dedupe_column_names(raw), "dropped"))


@register("b11_drop_null_props", """
SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND (value < 10 OR value > 20)
""")
def b11_drop_null_props(spark, sf_dir):
    """Rows without a user or a value go; values from 10 to 20 are made null first."""
    e = tables.read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when((F.col("value") < 10) | (F.col("value") > 20), F.col("value")).alias("value"))
    return B.drop_null_rows(e, ["user_id", "value"])


@register("b12_coerced_props", """
SELECT event_id, TRY_CAST(props AS DOUBLE) AS whole, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS digits FROM events
""")
def b12_coerced_props(spark, sf_dir):
    """Text to numbers; text that is none becomes null."""
    e = tables.read_table(spark, sf_dir, "events")
    return e.select("event_id", B.coerce_numeric("props").alias("whole"),
                    B.coerce_numeric(F.regexp_extract("props", "[0-9]+", 0)).alias("digits"))


def _dtype_sql() -> str:
    """Types as DuckDB tells them of the stored columns, in Spark's names."""
    names = "CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {names.format(c=f'ANY_VALUE({c})')} AS data_type, COUNT(*) - COUNT({c}) AS null_count FROM orders"
                              for c in ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"))


@register("b13_dtype_null_audit", _dtype_sql())
def b13_dtype_null_audit(spark, sf_dir):
    return B.dtype_null_audit(tables.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"))


@register("a1_a11_positional_csv", """
SELECT p_partkey AS item_id, p_type AS cuisine_tag, p_name AS item_name, CAST(p_retailprice AS DECIMAL(10,2)) AS item_price,
       CAST(p_size AS VARCHAR) AS merchant_id FROM part
""")
def a1_a11_positional_csv(spark, sf_dir):
    """CSV lines bound to the declared item columns by position."""
    from stallboard.sources import schemas as S
    p = tables.read_table(spark, sf_dir, "part")
    line = F.to_csv(F.struct("p_partkey", "p_type", "p_name", F.col("p_retailprice").cast("decimal(10,2)"), "p_size"), {"quoteAll": "true"})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RAW_SCHEMAS["items"].fields)
    row = p.select(F.from_csv(line, schema, {"mode": "FAILFAST"}).alias("r"))
    return row.select(F.col("r.item_id").cast("long").alias("item_id"), "r.cuisine_tag", "r.item_name", "r.item_price", "r.merchant_id")


@register("k10_audit_of_driver_tables", """
SELECT 'lines without an order' AS "check", COUNT(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lines without an item', COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'repeated line keys', CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
UNION ALL SELECT 'repeated lines left by the clean step', CAST(0 AS BIGINT)
""")
def k10_audit_of_driver_tables(spark, sf_dir):
    """K10's checks on the given tables, before and after B1."""
    line, orders, part = (tables.read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    keys = ["l_orderkey", "l_linenumber"]

    def check(name, df, column):
        return df.select(F.lit(name).alias("check"), F.col(column).cast("long").alias("violations"))
    return (check("lines without an order", B.foreign_key_audit(line, "l_orderkey", orders, "o_orderkey"), "orphan_rows")
            .unionByName(check("lines without an item", B.foreign_key_audit(line, "l_partkey", part, "p_partkey"), "orphan_rows"))
            .unionByName(check("repeated line keys", B.unique_audit(line, keys), "surplus_rows"))
            .unionByName(check("repeated lines left by the clean step", B.unique_audit(b1_keep_first_line(spark, sf_dir), keys), "surplus_rows")))


# ------------------------------------------------------------------ sorted and single-merchant forms

@register("g1_customers_newest_first", f"""
WITH {K1_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY merchant_id, last_order_date DESC, customer_id) AS output_row FROM k1
""")
def g1_customers_newest_first(spark, sf_dir):
    return G.numbered(_k1(spark, sf_dir), ["merchant_id", F.desc("last_order_date"), "customer_id"])


@register("g2_items_by_quantity", f"""
WITH {OL}, {K2_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY merchant_id, total_quantity DESC, item_id) AS output_row FROM k2
""")
def g2_items_by_quantity(spark, sf_dir):
    return G.numbered(_k2(spark, sf_dir), ["merchant_id", F.desc("total_quantity"), "item_id"])


@register("g3_months_ascending", f"""
WITH {OL}, {K3_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY merchant_id, month) AS output_row FROM k3
""")
def g3_months_ascending(spark, sf_dir):
    return G.numbered(_k3(spark, sf_dir), ["merchant_id", "month"])


@register("g4_days_ascending", f"""
WITH {OL}, {DAILY_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY merchant_id, order_date) AS output_row FROM daily
""")
def g4_days_ascending(spark, sf_dir):
    return G.numbered(_daily(spark, sf_dir), ["merchant_id", "order_date"])


@register("g5_head_of_days", f"""
WITH {OL}, {DAILY_SQL}
SELECT * FROM daily ORDER BY total_revenue DESC, merchant_id, order_date LIMIT 5
""")
def g5_head_of_days(spark, sf_dir):
    """The first five rows of a total order (a top-k report)."""
    return G.head(_daily(spark, sf_dir), 5, [F.desc("total_revenue"), "merchant_id", "order_date"])


@register("g9_best_month", f"""
WITH {OL}, {K3_SQL}
SELECT merchant_id, month, total_sales FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY total_sales DESC, month) AS rn FROM k3) WHERE rn = 1
""")
def g9_best_month(spark, sf_dir):
    """The best row of each group."""
    return G.best_per_group(_k3(spark, sf_dir), ["merchant_id"], [F.desc("total_sales"), "month"])


@register("c1_one_merchant_items", f"""
WITH {OL}
SELECT order_merchant_id AS merchant_id, item_id, item_name, CAST(SUM(quantity) AS INTEGER) AS total_quantity,
       CAST(SUM(item_price * quantity) AS DOUBLE) AS total_sales,
       ROW_NUMBER() OVER (ORDER BY SUM(quantity) DESC, item_id) AS output_row
FROM order_lines WHERE order_merchant_id = {MERCHANT} AND {_lookback_sql(ITEM_DAYS)}
GROUP BY 1, 2, 3 HAVING SUM(quantity) > 0
""")
def c1_one_merchant_items(spark, sf_dir):
    """K2 as the reference runs it: one merchant, items by quantity."""
    one = PS.item_sales_over_days(_lines(spark, sf_dir), ITEM_DAYS, AS_OF, merchant_id=MERCHANT)
    return G.numbered(one, [F.desc("total_quantity"), "item_id"])


@register("c1_one_merchant_customers", f"""
WITH {K1_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY last_order_date DESC, customer_id) AS output_row FROM k1 WHERE merchant_id = {MERCHANT}
""")
def c1_one_merchant_customers(spark, sf_dir):
    return G.numbered(PC.customer_list(V.driver_customer_lines(spark, sf_dir), MERCHANT), [F.desc("last_order_date"), "customer_id"])


@register("c1_one_merchant_months", f"""
WITH {OL}, {K3_SQL}
SELECT *, ROW_NUMBER() OVER (ORDER BY month) AS output_row FROM k3 WHERE merchant_id = {MERCHANT}
""")
def c1_one_merchant_months(spark, sf_dir):
    return G.numbered(PS.monthly_sales(_lines(spark, sf_dir), MERCHANT), ["month"])


@register("c8_merchant_lookup", f"""
SELECT s_suppkey AS merchant_id, s_name AS merchant_name, s_nationkey AS city_id FROM supplier WHERE s_suppkey = {MERCHANT}
""")
def c8_merchant_lookup(spark, sf_dir):
    return C.first_by_key(tables.merchants(spark, sf_dir), "merchant_id", MERCHANT, "merchant_name")


@register("k2_from_stored_lines", f"""
WITH {OL}, {K2_SQL}
SELECT * FROM k2
""")
def k2_from_stored_lines(spark, sf_dir):
    """K2 over the order-line view stored by month: the range prunes whole month folders."""
    import uuid

    from stallboard.functions.dates import lookback_bounds
    from stallboard.plans import etl
    from stallboard.session import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/order-lines-{uuid.uuid4().hex}"
    etl.materialize_order_lines(_lines(spark, sf_dir), path)
    stored = etl.month_range_filter(etl.read_order_lines(spark, path), *lookback_bounds(AS_OF, ITEM_DAYS))
    return PS.item_sales_over_days(stored, ITEM_DAYS, AS_OF)


# ------------------------------------------------------------------ reports

@register("i31_item_report_lines", f"""
WITH {OL}, {K2_SQL}
SELECT merchant_id, printf('* %s: %d units (Sales: $%.2f)', item_name, total_quantity, total_sales) AS line,
       ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY printf('* %s: %d units (Sales: $%.2f)', item_name, total_quantity, total_sales)) AS line_number
FROM k2
""")
def i31_item_report_lines(spark, sf_dir):
    """I31 in long form: numbered lines, so a catalogue is never one value."""
    return R.item_report_lines(_k2(spark, sf_dir))


@register("k8_item_payload", f"""
WITH {OL}, {K2_SQL}
SELECT merchant_id, item_id, CAST(to_json({{'item_name': item_name, 'total_quantity': total_quantity,
       'total_sales': CAST(total_sales AS DECIMAL(18,2))}}) AS VARCHAR) AS payload FROM k2
""")
def k8_item_payload(spark, sf_dir):
    """K8's item rows as JSON objects, one per row."""
    return R.item_payload(_k2(spark, sf_dir))


@register("k9_chat_parts", r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role,
                  regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, turn, CAST(to_json({'role': role, 'parts': [{'text': text}]}) AS VARCHAR) AS message FROM c WHERE length(text) > 0
""")
def k9_chat_parts(spark, sf_dir):
    """K9 with parts as objects, one message a row."""
    return R.chat_parts(tables.conversations(spark, sf_dir))


def _histograms_sql():
    parts = []
    for m in METRICS:
        parts.append(f"""SELECT d.merchant_id, '{m}' AS feature,
  CAST(CASE WHEN r.mx_{m} = r.mn_{m} THEN 1 ELSE LEAST(FLOOR((d.{m} - r.mn_{m}) / (r.mx_{m} - r.mn_{m}) * r.bins) + 1, r.bins) END AS INTEGER) AS bin,
  COUNT(*) AS count FROM daily d JOIN r ON r.merchant_id = d.merchant_id GROUP BY 1, 2, 3""")
    ranges = ", ".join(f"CAST(MIN({m}) AS DOUBLE) AS mn_{m}, CAST(MAX({m}) AS DOUBLE) AS mx_{m}" for m in METRICS)
    return f"r AS (SELECT merchant_id, {ranges}, CAST(CEIL(LOG2(COUNT(*)) + 1) AS INTEGER) AS bins FROM daily GROUP BY 1)\n" + "\nUNION ALL ".join(parts)


@register("e23_histograms_automatic_bins", f"""
WITH {OL}, {DAILY_SQL}, {_histograms_sql()}
""")
def e23_histograms_automatic_bins(spark, sf_dir):
    """E23 of every metric with Sturges' number of bins."""
    out = None
    for m in METRICS:
        h = ST.histogram(_daily(spark, sf_dir), m, None).select("merchant_id", F.lit(m).alias("feature"), "bin", "count")
        out = h if out is None else out.unionByName(h)
    return out


@register("j9_residual_acf_30")
def j9_residual_acf_30(spark, sf_dir):
    """J9 on the residuals of the revenue model, 30 lags."""
    fits, _, _ = PF.revenue_forecast(PF.daily_revenue(_lines(spark, sf_dir)), residuals=True)
    return ST.acf(PF.residual_series(fits), "resid", 30, keys=("merchant_id", "model"), order="t")
