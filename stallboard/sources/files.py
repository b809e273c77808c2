"""Raw-file sources and sinks.

CSV columns bind by position, as the loader's explicit column lists do: the header line is
skipped and its names are ignored. Parsing is FAILFAST, mirroring a load that stops at the
first bad line. Writers are plain DataFrame writers; callers choose the shared output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.sources import schemas as S

# Raw file names of the six tables.
RAW_FILES = {
    "merchants": "merchant.csv",
    "items": "items.csv",
    "keywords": "keywords.csv",
    "transaction_data": "transaction_data.csv",
    "transaction_items": "transaction_items.csv",
    "new_transaction_items": "new2_transaction_items.csv",
}


def read_csv(spark: SparkSession, path: str, table: str, mode: str = "FAILFAST") -> DataFrame:
    """A1: one raw table with its declared schema (A2). Empty fields read as null (Q14)."""
    return (spark.read.schema(S.RAW_SCHEMAS[table])
            .option("header", "true").option("enforceSchema", "true")
            .option("mode", mode).option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
            .csv(path))


def read_raw_tables(spark: SparkSession, folder: str, mode: str = "FAILFAST") -> dict[str, DataFrame]:
    """A1 + A11: all six raw tables of a folder (keywords is read and kept, never queried)."""
    folder = folder.rstrip("/")
    return {t: read_csv(spark, f"{folder}/{f}", t, mode) for t, f in RAW_FILES.items()}


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """A4 alternate source: a database table read in parallel slices of ``partition_column``.
    Needs the JDBC driver on the classpath; nothing here opens a server."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A3: persist a cleaned table as parquet, optionally partitioned (e.g. by year-month of
    the order time, so time-range queries prune whole folders)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records, one object per row (the API's record lists), written by the executors."""
    df.write.mode(mode).json(path)


def json_records_per_merchant(df: DataFrame, key: str = "merchant_id", order: list[str] | None = None) -> DataFrame:
    """A9 nested form: one JSON array per merchant, rows sorted by ``order``."""
    cols = [c for c in df.columns if c != key]
    order = order or cols[:1]
    rec = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols if c not in order])
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("records"))
