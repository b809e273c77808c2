"""G7 / K6 from a stored page index: a ranked list is sorted once, and a page reads only the files that hold it.

The list is range-partitioned by (keys, order), sorted inside its partitions and written as one folder per
partition, each row with its number within its keys (from 1). A small table beside it says which
numbers of which keys lie in which partition: one row per partition and key combination in it. A
page, given by its keys, looks its partitions up there (one or two, unless the keys are tiny groups
packed together) and reads those folders with a filter on the row number. A key with a third of all rows is
spread over many partitions by its order.

Nulls in the order columns sort as in any Spark order. Rows of an empty list: every page is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallboard.operators.ordering import PAGE_SIZES

FOLDER = "page_part"


def write_index(df: DataFrame, path: str, order: list, keys=("merchant_id",), parts: int | None = None) -> None:
    """Ranks ``df`` within ``keys`` by ``order`` (a total order) and writes the index under ``path``."""
    spark, keys = df.sparkSession, list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn(FOLDER, F.spark_partition_id())
    inside = Window.partitionBy(*keys, FOLDER).orderBy(*order)
    staged = f"{path}/staged"
    (ranged.withColumn("place", F.row_number().over(inside)).sortWithinPartitions(FOLDER, *keys, "place")
     .write.partitionBy(FOLDER).parquet(staged))
    rows = spark.read.parquet(staged)
    before = Window.partitionBy(*keys).orderBy(FOLDER).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, FOLDER).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*keys)
    (counts.select(*keys, FOLDER, "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("before"),
                   F.sum("rows").over(whole).cast("long").alias("row_count"))
     .repartitionByRange(max(1, n // 8), *keys).sortWithinPartitions(*keys).write.parquet(f"{path}/directory"))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(keys, page_part, rows, before, row_count): where the rows of each key lie."""
    return spark.read.parquet(f"{path}/directory")


def _numbered(rows: DataFrame, places: DataFrame, keys: list[str], lo: int, size: int, page_index: int) -> DataFrame:
    joined = rows.join(places, [*keys, FOLDER]).withColumn("row_number", (F.col("before") + F.col("place")).cast("int"))
    return (joined.where((F.col("row_number") > lo) & (F.col("row_number") <= lo + size))
            .drop(FOLDER, "place", "before", "rows").withColumn("page_index", F.lit(page_index))
            .withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("row_count") / size)).cast("int")))


def _check(page_size: int) -> None:
    if page_size not in PAGE_SIZES:
        raise ValueError(f"page_size must be one of {PAGE_SIZES}")


def page(spark: SparkSession, path: str, page_index: int, page_size: int, **key) -> DataFrame:
    """One page of one key combination (``merchant_id=17``): rows with ``row_number``, ``row_count``, ``page_count``."""
    _check(page_size)
    lo, own = page_index * page_size, list(key)
    condition: Column = F.lit(True)
    for c, value in key.items():
        condition = condition & F.col(c).eqNullSafe(F.lit(value))
    held = (directory(spark, path).where(condition)
            .where((F.col("before") < lo + page_size) & (F.col("before") + F.col("rows") > lo)).collect())  # a page's partitions
    rows = spark.read.parquet(f"{path}/staged").where(F.col(FOLDER).isin([r[FOLDER] for r in held])).where(condition)
    # numbers inside the folders, so that the scan can skip row groups
    first = min((lo - r["before"] for r in held), default=0)
    last = max((lo + page_size - r["before"] for r in held), default=0)
    rows = rows.where((F.col("place") > first) & (F.col("place") <= last))
    places = spark.createDataFrame([(r[FOLDER], r["before"], r["row_count"]) for r in held], f"{FOLDER} int, before long, row_count long")
    joined = rows.join(F.broadcast(places), FOLDER).withColumn("row_number", (F.col("before") + F.col("place")).cast("int"))
    return (joined.where((F.col("row_number") > lo) & (F.col("row_number") <= lo + page_size))
            .select(*own, *(c for c in rows.columns if c not in (*own, FOLDER, "place")), "row_number", "row_count",
                    F.lit(page_index).alias("page_index"), F.greatest(F.lit(1), F.ceil(F.col("row_count") / page_size)).cast("int").alias("page_count")))


def pages(spark: SparkSession, path: str, page_index: int, page_size: int, keys=("merchant_id",)) -> DataFrame:
    """The same page of every key combination, from the stored numbers: no sort and no count."""
    _check(page_size)
    lo, keys = page_index * page_size, list(keys)
    held = directory(spark, path).where((F.col("before") < lo + page_size) & (F.col("before") + F.col("rows") > lo))
    return _numbered(spark.read.parquet(f"{path}/staged"), held, keys, lo, page_size, page_index)
