"""Load and clean the raw tables (bootstrap ETL), as one Spark job per table.

A1 read -> B1 keep-first orders -> B3 drop merchant_id from unit lines -> B2 distinct
quantity lines -> B4/B5/B6 join_date -> B8-B10 audits -> A3 parquet -> A8 view.
Constraint violations abort the load (``strict=True``), as the relational load does. ``load_and_clean`` replaces
everything; ``add_load`` adds to published versions (``stores.versions``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.operators import cleaning as B
from stallboard.operators import views as V
from stallboard.session import checkpoint_dir
from stallboard.sources import files
from stallboard.stores.keyed import BUCKET, BUCKETS, insert_if_absent
from stallboard.stores.versions import Published


def clean_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "merchants": B.clean_join_date(raw["merchants"]),
        "items": raw["items"],
        "keywords": raw["keywords"],
        "transaction_data": B.keep_first(raw["transaction_data"], "order_id", "id"),
        "transaction_items": B.drop_columns(raw["transaction_items"], "merchant_id"),
        "new_transaction_items": B.distinct_rows(raw["new_transaction_items"]),
    }


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """B8 + B9 + B10 over the cleaned tables, one row per check."""
    from stallboard.sources import schemas as S
    checks = []
    for t in ("merchants", "items", "keywords", "transaction_data", "transaction_items"):
        a = B.null_length_audit(tables[t], t)
        checks.append(a.select(F.concat_ws(".", "table_name", "column_name").alias("check"),
                               (F.col("null_count") + F.col("too_long_count")).alias("violations")))
    for name, keys in S.UNIQUE_KEYS.items():
        t = name.split("#")[0]
        u = B.unique_audit(tables[t], keys)
        checks.append(u.select(F.lit(f"unique {name}:{','.join(keys)}").alias("check"),
                               F.col("surplus_rows").alias("violations")))
    for child, cc, parent, pc in S.FOREIGN_KEYS:
        fk = B.foreign_key_audit(tables[child], cc, tables[parent], pc)
        checks.append(fk.select(F.lit(f"fk {child}.{cc}->{parent}.{pc}").alias("check"),
                                F.col("orphan_rows").alias("violations")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def load_and_clean(spark: SparkSession, raw_folder: str, out_folder: str, strict: bool = True) -> DataFrame:
    """Run the whole bootstrap; returns the registered order-line view.

    The raw files are parsed and cleaned once, into a staging copy under the checkpoint folder; the
    audits and the published tables read that copy."""
    staging = f"{checkpoint_dir(spark)}/staging-{uuid.uuid4().hex}"
    tables = {}
    for name, df in clean_tables(files.read_raw_tables(spark, raw_folder)).items():
        files.write_table(df, f"{staging}/{name}")
        tables[name] = spark.read.parquet(f"{staging}/{name}")
    report = audit(tables)
    if strict:
        B.require_clean(report.groupBy().agg(F.sum("violations").alias("violations")), "violations")
    for name, df in tables.items():
        files.write_table(df, f"{out_folder.rstrip('/')}/{name}")
    stored = {n: spark.read.parquet(f"{out_folder.rstrip('/')}/{n}") for n in tables}
    lines = stored["new_transaction_items"]
    view = V.build_order_lines(lines, stored["transaction_data"], stored["items"], stored["merchants"])
    view.createOrReplaceTempView("combined_order_view")
    return view


#: Key and order within a batch of the tables whose rows are inserted if absent; every column of
#: new_transaction_items is its key (the statement inserts distinct rows and the table has none).
INSERT_KEYS = {
    "merchants": (["merchant_id"], "merchant_id"),
    "items": (["item_id"], "item_id"),
    "keywords": (["id"], "id"),
    "transaction_data": (["order_id"], "id"),
    "transaction_items": (["id"], "id"),
    "new_transaction_items": (["order_id", "merchant_id", "item_id", "quantity"], "order_id"),
}


def add_load(store: Published, tables: dict[str, DataFrame], strict: bool = True, buckets: int = BUCKETS) -> int:
    """K10 as an increment: cleaned tables are inserted where their key is absent, audited as a whole, and
    published all at once; returns the version. Rows that are stored already stay, so a repeated load changes
    nothing but the version; ``buckets`` stays what it was in the first load. A violation (``strict``) or a lost driver leaves the version before in place."""
    load = store.begin()
    for name, df in tables.items():
        keys, order = INSERT_KEYS[name]
        insert_if_absent(load, name, df, keys, order, buckets)
    if strict:
        report = audit({name: load.read(name).drop(BUCKET) for name in tables})
        B.require_clean(report.groupBy().agg(F.sum("violations").alias("violations")), "violations")
    return load.publish()


def published_view(store: Published) -> DataFrame:
    """The order-line view over one version of all published tables."""
    tables = {name: df.drop(BUCKET) for name, df in store.snapshot().items()}
    return V.build_order_lines(tables["new_transaction_items"], tables["transaction_data"], tables["items"], tables["merchants"])


def materialize_order_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the order-line view once, partitioned by order month: time-range jobs (K2's
    look-back, the training cutoff) then prune whole month folders at planning time
    (``PartitionFilters``) instead of filtering every file."""
    out = lines.withColumn("order_month", F.date_format("order_time", "yyyy-MM"))
    files.write_table(out, path, partition_by=["order_month"], mode=mode)


def read_order_lines(spark: SparkSession, path: str) -> DataFrame:
    """The materialised view; filters on ``order_month`` prune partitions."""
    return spark.read.parquet(path)


def month_range_filter(df: DataFrame, lo, hi) -> DataFrame:
    """Add the month-partition predicate implied by a time range, so pruning happens even
    though the range itself is on ``order_time``."""
    return df.where((F.col("order_month") >= F.lit(lo.strftime("%Y-%m"))) &
                    (F.col("order_month") <= F.lit(hi.strftime("%Y-%m"))))


def bucket_by_merchant(df: DataFrame, table: str, buckets: int, key: str = "merchant_id",
                       sort_col: str | None = "order_date") -> None:
    """Save a per-merchant table (e.g. the daily series) bucketed by merchant in the
    session's warehouse: later per-merchant aggregates, windows and merchant joins read it
    already clustered and skip the shuffle."""
    w = df.write.mode("overwrite").bucketBy(buckets, key)
    if sort_col:
        w = w.sortBy(key, sort_col)
    w.saveAsTable(table)
