"""Report payloads: item report lines (I31), chart JSON (K8, A9, I33), dashboard bundle
(K7) and the conversation-history normaliser (K9). Everything is built per merchant or per
conversation by grouped aggregates; nothing is assembled on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallboard.functions import text as T
from stallboard.operators import aggregates as A
from stallboard.operators import ordering as G


def item_report_lines(item_sales: DataFrame, with_sales: bool = True) -> DataFrame:
    """I31 in long form: (merchant_id, line, line_number) in the report's order."""
    line = T.item_line("item_name", "total_quantity", "total_sales" if with_sales else None)
    lines = item_sales.select("merchant_id", line.alias("line"))
    numbered = G.numbered(lines, ["merchant_id", "line"], "_row")
    first = numbered.groupBy("merchant_id").agg(F.min("_row").alias("_first"))
    return numbered.join(first, "merchant_id").select("merchant_id", "line", (F.col("_row") - F.col("_first") + 1).alias("line_number"))


def item_payload(item_sales: DataFrame) -> DataFrame:
    """K8's item rows as JSON objects, one per row (money as exact decimals)."""
    return item_sales.select("merchant_id", "item_id", F.to_json(F.struct(
        "item_name", "total_quantity", F.col("total_sales").cast("decimal(18,2)").alias("total_sales"))).alias("payload"))


def chat_parts(conv: DataFrame) -> DataFrame:
    """K9 as the model client receives it, one message a row: {role, parts: [{text}]}."""
    flat = chat_messages(conv)
    return flat.select("conv_id", "turn", F.to_json(F.struct("role", F.array(F.struct("text")).alias("parts"))).alias("message"))


def bundle_long(monthly: DataFrame, recent_items: DataFrame, revenue_forecast: DataFrame,
                quantity_forecast: DataFrame | None = None, target: float = 60000.0, days: int = 7) -> DataFrame:
    """K7 as rows (merchant_id, section, entry, value): months, items of the last days, their total
    and the forecast; with ``quantity_forecast`` also the items' forecast totals of ``days`` days and whether the
    target is passed (1 or 0). The form for catalogues of any size; ``dashboard_bundle`` nests it."""
    def rows(df, section, entry, value):
        return df.select("merchant_id", F.lit(section).alias("section"), entry.cast("string").alias("entry"), F.round(value, 2).alias("value"))
    kpi = A.sales_kpi(recent_items, target)
    total = kpi.select("merchant_id", "total_sales")
    more = monthly.sparkSession.createDataFrame([], rows(monthly, "", F.lit(""), F.lit(0.0)).schema)
    if quantity_forecast is not None:
        quantities = A.horizon_item_totals(quantity_forecast, days)
        more = (rows(quantities, "item forecast", F.col("safe_name"), F.col("total_quantity").cast("double"))
                .unionByName(rows(kpi, "target passed", F.lit(None), F.col("above_target").cast("int").cast("double"))))
    return (rows(monthly, "month", F.col("month"), F.col("total_sales"))
            .unionByName(rows(recent_items, "item", F.col("item_id"), F.col("total_sales")))
            .unionByName(rows(total, "recent sales", F.lit(None), F.col("total_sales")))
            .unionByName(rows(revenue_forecast, "revenue forecast", F.col("forecast_date"), F.col("forecasted_revenue")))
            .unionByName(more))


def item_report(item_sales: DataFrame, with_sales: bool = True) -> DataFrame:
    """Per merchant the lines '* name: N units (Sales: $x.xx)' sorted and joined by newline."""
    line = T.item_line("item_name", "total_quantity", "total_sales" if with_sales else None)
    return (item_sales.select("merchant_id", line.alias("line"))
            .groupBy("merchant_id")
            .agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("report"),
                 F.count(F.lit(1)).alias("n_items")))


def chart_payload(monthly: DataFrame, limit: int = 4000) -> DataFrame:
    """The merchant's month rows as JSON text (money as exact decimals), its
    full length, and the text cut at ``limit`` characters with a marker, as sent to the
    insight prompt."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("month"),
                                                F.col("total_sales").cast("decimal(18,2)").alias("total_sales"))))
    j = monthly.groupBy("merchant_id").agg(F.to_json(rows).alias("payload"))
    return j.select("merchant_id", F.length("payload").alias("payload_chars"),
                    T.cut_text("payload", limit).alias("payload_cut"))


def payload_pieces(rows: DataFrame, fields: list[str], order: list[str], limit: int = 4000, key: str = "merchant_id") -> DataFrame:
    """The merchant's rows as JSON text indented by two spaces, in numbered pieces of ``limit`` characters:
    (merchant_id, piece, text, payload_chars, prompt_text). The pieces joined are the whole text; ``prompt_text``, on piece 1,
    is what the prompt holds: the text, cut at ``limit`` with the marker if there is more.

    The text is never one value: each row is formatted alone, a running total of the lengths says where it
    lies in the whole, and it is cut at the piece borders; a piece is put together from the few parts in it."""
    values = [F.concat(F.lit(f'    "{f}": '), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")))
              for f in fields]
    # a null is left out of Spark's JSON object, and null in the list
    values = [F.when(F.col(f).isNull(), F.lit(f'    "{f}": null')).otherwise(v) for f, v in zip(fields, values)]
    one = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *values), F.lit("\n  }"))
    sized = rows.select(key, *order, one.alias("object")).withColumn("chars", (F.length("object") + 2).cast("long"))
    placed = G.running_total(sized, [key], order, "chars", "before")
    whole = sized.groupBy(key).agg((F.sum("chars") + 2).alias("payload_chars"))
    # "[" and a line break stand before the first object, a comma and a line break before the others; the end closes the list
    first, last = F.col("before") == 0, F.col("before") + F.col("chars") + 2 == F.col("payload_chars")
    text = F.concat(F.when(first, "[\n").otherwise(",\n"), F.col("object"), F.when(last, "\n]").otherwise(""))
    parts = placed.join(whole, key).select(key, "before", "payload_chars", text.alias("text"))
    start, end = F.col("before"), F.col("before") + F.length("text")
    cut = parts.withColumn("piece", F.explode(F.sequence(F.floor(start / limit), F.floor((end - 1) / limit))))
    low = F.greatest(start, F.col("piece") * limit)
    high = F.least(end, (F.col("piece") + 1) * limit)
    cut = cut.select(key, "payload_chars", (F.col("piece") + 1).cast("int").alias("piece"), low.alias("at"),
                     F.substr("text", (low - start + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    pieces = cut.groupBy(key, "payload_chars", "piece").agg(joined.alias("text"))
    more = F.when(F.col("payload_chars") > limit, F.lit(T.TRUNCATION_MARKER)).otherwise("")
    return pieces.select(key, "piece", "text", "payload_chars", F.when(F.col("piece") == 1, F.concat("text", more)).alias("prompt_text"))


def dashboard_summary(monthly: DataFrame, recent_items: DataFrame, target: float = 60000.0) -> DataFrame:
    """K7 (history part): months with sales, all-time sales, last-N-day item sales and KPI."""
    m = monthly.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("months_with_sales"),
        F.sum(F.col("total_sales").cast("decimal(20,2)")).cast("double").alias("all_time_sales"))
    kpi = A.sales_kpi(recent_items, target).select(
        "merchant_id", F.col("total_sales").alias("recent_sales"), "above_target")
    return m.join(kpi, "merchant_id", "left")


def chat_messages(conv: DataFrame) -> DataFrame:
    """K9's messages: roles mapped (user -> user, anything else -> model), text stripped, blank
    messages dropped."""
    return (conv.select("conv_id", "turn",
                        F.when(F.col("role") == "user", "user").otherwise("model").alias("role"),
                        T.clean_text("text").alias("text"))
            .where(F.col("text").isNotNull()))


def chat_history(conv: DataFrame) -> DataFrame:
    """K9 in flat form: ``chat_messages`` with position = order within the conversation by turn."""
    kept = chat_messages(conv)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return kept.withColumn("position", F.row_number().over(w).cast("long"))


def chat_history_nested(conv: DataFrame) -> DataFrame:
    """K9 as the model client receives it: one ordered list of {role, parts: [{text}]} per conversation."""
    flat = chat_history(conv)
    msgs = F.array_sort(F.collect_list(F.struct("turn", "role", F.array(F.struct("text")).alias("parts"))))
    return flat.groupBy("conv_id").agg(
        F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), m["parts"].alias("parts"))).alias("history"))


def sql_rows_json(spark, text: str, args: dict | None = None):
    """Run SQL text with named parameters (never string interpolation) and return
    each row as a JSON object text, serialised by the executors."""
    df = spark.sql(text, args=args or {})
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("row_json"))


def dashboard_bundle(monthly: DataFrame, recent_items: DataFrame, revenue_forecast: DataFrame,
                     quantity_forecast: DataFrame, target: float = 60000.0, days: int = 30) -> DataFrame:
    """K7 in full: one row per merchant with the month series, the last-N-day item list, the
    KPI, the revenue forecast and the per-item forecast totals. Each list is bounded by the
    calendar or the merchant's catalogue and is assembled by grouped aggregates."""
    months = monthly.groupBy("merchant_id").agg(F.array_sort(F.collect_list(
        F.struct("month", "total_sales"))).alias("monthly_sales"))
    items = recent_items.groupBy("merchant_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("item_id"), F.col("item_name"), F.col("total_quantity"), F.col("total_sales")))).alias("items"))
    kpi = A.sales_kpi(recent_items, target).select("merchant_id", F.col("total_sales").alias("recent_sales"),
                                                   "above_target")
    rev = A.horizon_revenue_total(revenue_forecast, days).select(
        "merchant_id", F.col("total_forecasted_sales").alias("forecast_revenue_total"),
        F.col("daily_breakdown").alias("revenue_forecast"))
    qty = (A.horizon_item_totals(quantity_forecast, days).groupBy("merchant_id")
           .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("safe_name", "total_quantity"))))
                .alias("forecast_quantities")))
    return (months.join(items, "merchant_id", "left").join(kpi, "merchant_id", "left")
            .join(rev, "merchant_id", "left").join(qty, "merchant_id", "left"))
