"""Sorts, limits, pages (G1-G9). Sorting happens only at output; every order gets a tie-break
so results are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.session import cut_lineage

PAGE_SIZES = (5, 10, 20, 50, 100)


def sort_by(df: DataFrame, column: str, descending: bool = False, tie_break: str | None = None,
            leading=("merchant_id",)) -> DataFrame:
    """G8 (and G1-G4): sort by a chosen column and direction within each merchant."""
    c = F.col(column)
    keys = [k for k in leading if k in df.columns and k != column]
    order = [*keys, c.desc() if descending else c.asc()]
    if tie_break and tie_break != column:
        order.append(F.col(tie_break).asc())
    return df.orderBy(*order)


def head(df: DataFrame, n: int, order=None) -> DataFrame:
    """First n rows after a total order."""
    return (df.orderBy(*order) if order else df).limit(n)


def page(df: DataFrame, page_index: int, page_size: int, order, keys=("merchant_id",)) -> DataFrame:
    """Page ``page_index`` (0-based) of a sorted result, per merchant, with the page count.

    Rows are range-partitioned by (merchant, order), so a huge merchant is sorted by many tasks
    at any page depth; rows are numbered inside a partition and each partition adds the
    counts of the same merchant in the partitions before it (one row per partition and merchant
    that lies in it). The input is written once to the checkpoint folder and read from there by
    the numbering and the counts. ``page_count`` = ceil(rows / page_size), at least 1.
    """
    if page_size not in PAGE_SIZES:
        raise ValueError(f"page_size must be one of {PAGE_SIZES}")
    from pyspark.sql import Window
    keys = list(keys)
    lo = page_index * page_size
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                      F.sum("_n").over(Window.partitionBy(*keys)).alias("row_count")))
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return (numbered.join(counts, [*keys, "_part"])
            .withColumn("row_number", (F.col("_before") + F.col("_rn")).cast("int"))
            .where((F.col("row_number") > lo) & (F.col("row_number") <= lo + page_size))
            .drop("_part", "_rn", "_before")
            .withColumn("page_index", F.lit(page_index))
            .withColumn("page_count", F.greatest(F.lit(1), F.ceil(F.col("row_count") / page_size)).cast("int")))


def numbered(df: DataFrame, order, name: str = "output_row") -> DataFrame:
    """G1-G4 with the output order as a column: a gapless number from 1 over the whole result.

    Rows are range-partitioned by the order and numbered inside their partition; the counts of
    the partitions before (one row per partition) are added, so no task holds the whole result."""
    from pyspark.sql import Window
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_rn", own).join(F.broadcast(counts), "_part")
            .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_part", "_rn", "_before"))


def best_per_group(df: DataFrame, keys, order) -> DataFrame:
    """The first row per group under ``order`` (planned as a WindowGroupLimit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def running_total(df: DataFrame, keys, order, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same keys in ``order`` (0 for the first).

    Rows are range-partitioned by (keys, order) and summed inside their partition; the sums of the same keys in the
    partitions before are added (one row per partition and key in it), so no task holds all rows of a key."""
    import uuid

    from pyspark.sql import Window
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    part, inside, before = (f"{c}_{uuid.uuid4().hex}" for c in ("part", "inside", "before"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()))
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = (ranged.groupBy(*keys, part).agg(F.sum(value).alias(before))
            .select(*keys, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before)))
    return (ranged.withColumn(inside, F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, [*keys, part])
            .withColumn(name, F.col(inside) + F.col(before)).drop(part, inside, before))
