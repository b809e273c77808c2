"""Insert-if-absent into a stored table, load after load.

A row whose key is stored already is left out and the stored row stays; of several new rows with
one key the first by ``order`` counts. The stored table lies in ``buckets`` folders by a
hash of the key, and a load reads the key column of those folders only that its own keys fall into
(``bucket`` is a partition column, so the filter prunes folders before any file is opened).

The keys of a load are combined before they are shuffled (``min_by`` has a map-side part), so a key that
stands in a third of a load's rows is one row per task; both sides of the joins then hold a key at most once.
Stored keys are first cut down to those of the load: a semi join whose side, the load's keys, Spark
broadcasts if it is small, and shuffles if not.

Null keys: a row with a null in its key meets no other (as a unique constraint has it) and is always
inserted. An empty load adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallboard.operators import cleaning as B
from stallboard.stores.versions import Load

BUCKETS = 64
BUCKET = "key_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def fresh_rows(new: DataFrame, stored: DataFrame | None, keys: list[str], order: str | Column, buckets: int = BUCKETS,
               unique: bool = False) -> DataFrame:
    """Rows of ``new`` to insert beside ``stored`` (with its ``key_bucket``; None: nothing is stored), with their bucket.

    ``unique``: ``new`` holds no key twice, as an aggregate by the key does not, and is not combined again."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    first = (new.where(known) if unique else B.keep_first(new.where(known), keys, order)).withColumn(BUCKET, bucket_of(keys, buckets))
    without = new.where(~known).withColumn(BUCKET, F.lit(0))
    if stored is None:
        return first.unionByName(without)
    # at most ``buckets`` numbers; the buckets of all rows are those of the first rows, which need not be found for it
    touched = [r[0] for r in new.where(known).select(bucket_of(keys, buckets).alias(BUCKET)).distinct().collect()]
    present = stored.where(F.col(BUCKET).isin(touched)).select(*keys).join(first.select(*keys), keys, "left_semi").distinct()
    return first.join(present, keys, "left_anti").select(*first.columns).unionByName(without)


def insert_if_absent(load: Load, table: str, new: DataFrame, keys: list[str], order: str | Column, buckets: int = BUCKETS,
                     unique: bool = False) -> DataFrame:
    """Adds to ``table``, as part of ``load``, the rows of ``new`` whose key is not stored; returns the added rows.

    ``buckets`` must stay what it was in the table's first load."""
    rows = fresh_rows(new, load.read(table), keys, order, buckets, unique)
    return load.append(table, rows, [BUCKET]).drop(BUCKET)
