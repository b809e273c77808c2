"""Queries over stored tables that are built load by load: inserts, versions, daily state, indexes.

Each query writes its stored form of the whole given tables under the shared folder and answers from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.functions.dates import lookback_bounds
from stallboard.operators import aggregates as A
from stallboard.operators import audits, selection
from stallboard.operators import quantity as Q
from stallboard.operators import views as V
from stallboard.plans import customers as PC
from stallboard.plans import etl, sql_gate
from stallboard.plans import naive as NV
from stallboard.plans import reports as R
from stallboard.registry import AS_OF, CUTOFF, ITEM_DAYS, K1_SQL, OL, ORACLE, _r2, register
from stallboard.registry_forms import D7_SQL, WEEKDAY_SQL, _lines, _sold, _weekday_items
from stallboard.session import checkpoint_dir
from stallboard.sources import tables
from stallboard.stores import folders, keyed, page_index
from stallboard.stores.co_located import StoredOrders
from stallboard.stores.daily_state import LINE_COLUMNS, DailyState
from stallboard.stores.postings import Postings
from stallboard.stores.versions import Published


def fresh_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ B1 / K10 load after load

@register("b1_insert_if_absent", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, load FROM (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS load, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                  l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1
""")
def b1_insert_if_absent(spark, sf_dir):
    """B1 against stored rows: returned lines are one load, all others the next, and that one comes twice; a stored line stays."""
    line = tables.read_table(spark, sf_dir, "lineitem").withColumn("load", F.when(F.col("l_returnflag") == "R", 1).otherwise(2))
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    store = Published(spark, fresh_root(spark, "lines"))
    for batch in (line.where("load = 1"), line.where("load = 2 OR load IS NULL"), line.where("load = 2 OR load IS NULL")):
        load = store.begin()
        keyed.insert_if_absent(load, "lines", batch, ["l_orderkey", "l_linenumber"], order, buckets=8)
        load.publish()
    return store.read("lines").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "load")


def _raw_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The given tables in the schema of the cleaned load."""
    lines = tables.order_items(spark, sf_dir)
    return {
        "merchants": tables.merchants(spark, sf_dir),
        "items": tables.items(spark, sf_dir),
        "transaction_data": tables.orders(spark, sf_dir).withColumn("id", F.col("order_id")),
        "new_transaction_items": lines.select("order_id", "merchant_id", "item_id", "quantity"),
    }


@register("k10_published_order_lines", f"""
WITH {OL}
SELECT DISTINCT order_id, order_merchant_id, item_id, item_name, quantity, CAST(subtotal AS DOUBLE) AS subtotal, merchant_name, order_time, eater_id FROM order_lines
""")
def k10_published_order_lines(spark, sf_dir):
    """K10 in two loads (orders up to 1995, then all), published as versions; a third load that dies unpublished is not seen."""
    raw = _raw_model(spark, sf_dir)
    early = raw["transaction_data"].where(F.year("order_time") <= 1995)
    first = raw | {"transaction_data": early, "new_transaction_items": raw["new_transaction_items"].join(early.select("order_id"), "order_id", "left_semi")}
    store = Published(spark, fresh_root(spark, "k10"))
    for load in (first, raw):
        etl.add_load(store, load, strict=False, buckets=8)
    broken = store.begin()
    broken.replace("transaction_data", early)
    view = etl.published_view(store)
    return view.select("order_id", "order_merchant_id", "item_id", "item_name", "quantity", F.col("subtotal").cast("double").alias("subtotal"),
                       "merchant_name", "order_time", "eater_id")


# ------------------------------------------------------------------ K2, K3, E5 from the daily state

_STATES: dict[tuple[str, str], DailyState] = {}


def _state(spark: SparkSession, sf_dir: str) -> DailyState:
    """The state after four loads, built once per application and tables: the lines in three parts that cut orders
    across, the last part twice."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        flag = F.pmod(F.xxhash64("item_id", "quantity"), F.lit(3))
        # a load reads its lines twice: the joins behind them are made once, for all loads
        staged = fresh_root(spark, "daily-state-lines")
        V.order_lines(spark, sf_dir).select(*LINE_COLUMNS, flag.alias("part")).write.partitionBy("part").parquet(staged)
        lines = spark.read.parquet(staged)
        state = DailyState(spark, fresh_root(spark, "daily-state"), buckets=8)
        for k in (0, 1, 2, 2):
            state.add(lines.where(F.col("part") == k).drop("part"), f"load {k}")
        folders.remove(spark, staged)
        _STATES[key] = state
    return _STATES[key]


@register("k2_from_daily_state", ORACLE["k2_item_sales"])
def k2_from_daily_state(spark, sf_dir):
    """K2 from the merged state: reads the item days of two months."""
    lo, hi = lookback_bounds(AS_OF, ITEM_DAYS)
    return _state(spark, sf_dir).item_sales(lo.date(), hi.date()).where("total_quantity > 0")


@register("k3_from_daily_state", ORACLE["k3_monthly_sales"])
def k3_from_daily_state(spark, sf_dir):
    """K3 from the merged and compacted state: each order's value once, also when its lines came in several loads."""
    state = _state(spark, sf_dir)
    state.compact()
    return state.monthly_sales()


@register("e5_from_daily_state", ORACLE["e5_daily_summary"])
def e5_from_daily_state(spark, sf_dir):
    """E5 from the merged state."""
    return _state(spark, sf_dir).daily_summary()


# ------------------------------------------------------------------ D1 from buckets

@register("d1_from_stored_buckets", ORACLE["d1_order_lines"])
def d1_from_stored_buckets(spark, sf_dir):
    """D1 over lines and orders stored in the same buckets: neither is shuffled to meet the other."""
    stored = StoredOrders(spark, fresh_root(spark, "co-located")).write(tables.order_items(spark, sf_dir), tables.orders(spark, sf_dir), buckets=8)
    return stored.order_lines(tables.items(spark, sf_dir), tables.merchants(spark, sf_dir))


# ------------------------------------------------------------------ G7 from the page index, C7 from postings

@register("g7_page_from_index", f"""
WITH {K1_SQL},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY last_order_date DESC, customer_id) AS row_number,
             COUNT(*) OVER (PARTITION BY merchant_id) AS row_count FROM k1)
SELECT merchant_id, customer_id, last_order_date, favorite_food, row_number, row_count,
       2 AS page_index, CAST(GREATEST(1, CEIL(row_count / 5)) AS INTEGER) AS page_count
FROM r WHERE row_number BETWEEN 11 AND 15
""")
def g7_page_from_index(spark, sf_dir):
    """The third page of every merchant's customers from the stored index."""
    path = fresh_root(spark, "page-index")
    page_index.write_index(PC.customer_list(V.driver_customer_lines(spark, sf_dir)), path, [F.desc("last_order_date"), "customer_id"])
    got = page_index.pages(spark, path, 2, 5)
    return got.select("merchant_id", "customer_id", "last_order_date", "favorite_food", F.col("row_number").cast("long").alias("row_number"),
                      "row_count", "page_index", "page_count")


#: Queries of 1 to 8 characters, in both cases and with odd characters.
SEARCHES = ("9", "rE", "199", "Gold", "3 blu", "-05-0", "almond", "PLATE 1", "1995-01-", "%_\\", "zzz")


@register("c7_search_from_postings", f"""
WITH {K1_SQL}, q AS (SELECT unnest([{', '.join("'" + q.replace("'", "''") + "'" for q in SEARCHES)}]) AS query)
SELECT query, merchant_id, customer_id, last_order_date, favorite_food FROM k1 JOIN q
  ON contains(lower(CAST(customer_id AS VARCHAR)), lower(query)) OR contains(lower(CAST(last_order_date AS VARCHAR)), lower(query))
     OR contains(lower(favorite_food), lower(query))
""")
def c7_search_from_postings(spark, sf_dir):
    """C7 over the customer list by posting lists, for eleven queries."""
    stored = Postings(spark, fresh_root(spark, "postings"), ["merchant_id", "customer_id"], ["customer_id", "last_order_date", "favorite_food"])
    stored.write(PC.customer_list(V.driver_customer_lines(spark, sf_dir)))
    out = None
    for q in SEARCHES:
        found = stored.search(q).select(F.lit(q).alias("query"), "merchant_id", "customer_id", "last_order_date", "favorite_food")
        out = found if out is None else out.unionByName(found)
    return out


# ------------------------------------------------------------------ B15 over all columns

#: Column kinds of the two profiled tables: number, text or time.
PROFILED = {
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "t"},
    "part": {"p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n", "p_retailprice": "n"},
}


def _profile_all_sql() -> str:
    parts = []
    for table, columns in PROFILED.items():
        for c, kind in columns.items():
            x, none = f"CAST({c} AS DOUBLE)", "CAST(NULL AS {})"
            numbers = ([f"ROUND(AVG({x}), 6)", f"ROUND(STDDEV_SAMP({x}), 4)", *(f"ROUND(quantile_cont({x}, {q}), 6)" for q in selection.QUANTILES.values())]
                       if kind == "n" else [none.format("DOUBLE")] * 7)
            lengths = [f"CAST({f}(length({c})) AS INTEGER)" if kind == "t" else none.format("INTEGER") for f in ("MIN", "MAX")]
            ends = [none.format("VARCHAR") if kind == "n" else f"CAST({f}({c}) AS VARCHAR)" for f in ("MIN", "MAX")]
            top = (f"(SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
                   if kind != "n" else none.format("VARCHAR"))
            top_count = f"(SELECT COUNT(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1)"
            names = ["mean", "sd", *selection.QUANTILES, "shortest", "longest", "least", "greatest", "top", "top_count"]
            values = [*numbers, *lengths, *ends, top, top_count]
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS kind, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS null_count, "
                         f"COUNT(DISTINCT {c}) AS distinct_count, " + ", ".join(f"{v} AS {n}" for v, n in zip(values, names)) + f" FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("b15_profile_all_columns", _profile_all_sql())
def b15_profile_all_columns(spark, sf_dir):
    """B15 with all column types of two tables; quantiles by narrowing histograms."""
    out = None
    for table, columns in PROFILED.items():
        p = selection.profile_all(tables.read_table(spark, sf_dir, table).select(*columns))
        kind = F.when(F.col("type") == "string", "t").when(F.col("type").isin("timestamp_ntz", "timestamp", "date"), "d").otherwise("n")
        p = p.select(F.lit(table).alias("table_name"), "column_name", kind.alias("kind"), "rows", "null_count", "distinct_count",
                     F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), *(F.round(q, 6).alias(q) for q in selection.QUANTILES),
                     "shortest", "longest", "least", "greatest", F.when(kind != "n", F.col("top")).alias("top"), "top_count")
        out = p if out is None else out.unionByName(p)
    return out


# ------------------------------------------------------------------ E15 / D7 with all items

@register("e15_pivot_all_items", f"""
WITH {OL}, {WEEKDAY_SQL}, {D7_SQL},
pr AS (SELECT fc.merchant_id, fc.item_id, fc.order_date AS forecast_date, {_r2('prediction')} AS p, CAST(d7.daily_quantity_sold AS DOUBLE) AS a
       FROM fc LEFT JOIN d7 ON d7.merchant_id = fc.merchant_id AND d7.order_date = fc.order_date AND d7.item_id = fc.item_id),
di AS (SELECT merchant_id, item_id, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY item_id) - 1 AS pos FROM (SELECT DISTINCT merchant_id, item_id FROM pr)),
days AS (SELECT DISTINCT merchant_id, forecast_date FROM pr)
SELECT merchant_id, forecast_date, CAST(pos // {Q.PIVOT_WIDTH} AS INTEGER) AS chunk, CAST(to_json(list(item_id ORDER BY pos)) AS VARCHAR) AS items,
       CAST(to_json(list(p ORDER BY pos)) AS VARCHAR) AS predicted, CAST(to_json(list(a ORDER BY pos)) AS VARCHAR) AS actual
FROM days JOIN di USING (merchant_id) LEFT JOIN pr USING (merchant_id, forecast_date, item_id) GROUP BY 1, 2, 3
""")
def e15_pivot_all_items(spark, sf_dir):
    """E15 + D7 over every item of every merchant, columns found in the data; lists as JSON text."""
    got = NV.pivot_all_items(_weekday_items(spark, sf_dir), _sold(spark, sf_dir), CUTOFF)
    return got.select("merchant_id", "forecast_date", "chunk", *(F.to_json(c).alias(c) for c in ("items", "predicted", "actual")))


# ------------------------------------------------------------------ I33 / K8 in pieces

@register("k8_payload_pieces", f"""
WITH {OL},
k AS (SELECT order_merchant_id AS merchant_id, item_id, item_name, CAST(SUM(quantity) AS INTEGER) AS total_quantity,
             CAST(SUM(item_price * quantity) AS DECIMAL(18,2)) AS total_sales FROM order_lines GROUP BY 1, 2, 3),
o AS (SELECT merchant_id, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "item_name": ' || CAST(to_json(item_name) AS VARCHAR) || ',' || chr(10)
        || '    "total_quantity": ' || total_quantity || ',' || chr(10) || '    "total_sales": ' || total_sales || chr(10) || '  }}',
        ',' || chr(10) ORDER BY item_id) || chr(10) || ']' AS payload FROM k GROUP BY merchant_id),
p AS (SELECT merchant_id, payload, unnest(range(1, CAST(CEIL(length(payload) / 4000) AS BIGINT) + 1)) AS piece FROM o)
SELECT merchant_id, CAST(piece AS INTEGER) AS piece, substring(payload, 4000 * (piece - 1) + 1, 4000) AS text, length(payload) AS payload_chars,
       CASE WHEN piece = 1 THEN substring(payload, 1, 4000) || CASE WHEN length(payload) > 4000 THEN chr(10) || '... (data truncated)' ELSE '' END END AS prompt_text
FROM p
""")
def k8_payload_pieces(spark, sf_dir):
    """The all-time item list of every merchant as indented JSON in pieces of 4000 characters."""
    sales = A.item_sales(_lines(spark, sf_dir)).withColumn("total_sales", F.col("total_sales").cast("decimal(18,2)"))
    return R.payload_pieces(sales, ["item_name", "total_quantity", "total_sales"], ["item_id"])


# ------------------------------------------------------------------ B9 / B10 by key domain

def _audited(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], list[audits.Domain]]:
    names = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
    declared = [
        audits.Domain("orders", "o_orderkey", True, [("lineitem", "l_orderkey")]),
        audits.Domain("part", "p_partkey", True, [("lineitem", "l_partkey")]),
        audits.Domain("supplier", "s_suppkey", True, [("lineitem", "l_suppkey")]),
        audits.Domain("customer", "c_custkey", True, [("orders", "o_custkey")]),
        audits.Domain("nation", "n_nationkey", True, [("customer", "c_nationkey"), ("supplier", "s_nationkey")]),
        audits.Domain("lineitem", "l_orderkey,l_linenumber", True),
    ]
    return {t: tables.read_table(spark, sf_dir, t) for t in names}, declared


def _domain_sql() -> str:
    declared = [("orders", ["o_orderkey"], [("lineitem", "l_orderkey")]), ("part", ["p_partkey"], [("lineitem", "l_partkey")]),
                       ("supplier", ["s_suppkey"], [("lineitem", "l_suppkey")]), ("customer", ["c_custkey"], [("orders", "o_custkey")]),
                       ("nation", ["n_nationkey"], [("customer", "c_nationkey"), ("supplier", "s_nationkey")]), ("lineitem", ["l_orderkey", "l_linenumber"], [])]
    parts = []
    for table, keys, children in declared:
        k = ", ".join(keys)
        known = " AND ".join(f"{c} IS NOT NULL" for c in keys)
        parts.append(f"SELECT 'unique {table}:{','.join(keys)}' AS \"check\", COUNT(*) FILTER (WHERE n > 1) AS duplicated_keys, "
                     f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations FROM (SELECT COUNT(*) AS n FROM {table} WHERE {known} GROUP BY {k})")
        parts += [f"SELECT 'fk {t}.{c}->{table}.{k}', CAST(NULL AS BIGINT), COUNT(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {table} WHERE {known})"
                  for t, c in children]
    return "\nUNION ALL\n".join(parts)


@register("b9_b10_audit_by_key_domain", _domain_sql())
def b9_b10_audit_by_key_domain(spark, sf_dir):
    """All unique and foreign-key checks of six tables, one exchange per key domain."""
    found, declared = _audited(spark, sf_dir)
    return audits.audit_keys(found, declared=declared)


# ------------------------------------------------------------------ A7

@register("a7_checked_sql_text", f"""
WITH {OL}
SELECT CAST(to_json({{'item_name': item_name, 'merchants': COUNT(DISTINCT order_merchant_id), 'quantity': CAST(SUM(quantity) AS BIGINT)}}) AS VARCHAR) AS row_json
FROM order_lines WHERE quantity >= 10 AND order_merchant_id IN (SELECT s_suppkey FROM supplier WHERE s_name > 'Supplier#0') GROUP BY item_name HAVING SUM(quantity) > 20
""")
def a7_checked_sql_text(spark, sf_dir):
    """SQL text over two registered views, let through by its plan, with parameters."""
    V.register_order_lines(spark, sf_dir)
    tables.merchants(spark, sf_dir).createOrReplaceTempView("merchants_view")
    text = """
        WITH large AS (SELECT item_name, order_merchant_id, quantity FROM combined_order_view WHERE quantity >= :least)
        SELECT item_name, COUNT(DISTINCT order_merchant_id) AS merchants, SUM(quantity) AS quantity FROM large
        WHERE order_merchant_id IN (SELECT merchant_id FROM merchants_view WHERE merchant_name > :after)
        GROUP BY item_name HAVING SUM(quantity) > 20
    """
    return sql_gate.rows_json(spark, text, ["combined_order_view", "merchants_view"], {"least": 10, "after": "Supplier#0"})
