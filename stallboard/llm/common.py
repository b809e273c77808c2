"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallboard.session import checkpoint_dir, cut_lineage, ship_package

__all__ = ["read", "utf8", "byte_slices", "word_table", "packed_words", "checkpointed", "scratch_path", "written", "remove_path", "parallelism",
           "group_ranks", "hash_bound", "connected_components", "ship_package"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also ships the package to the Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    base = int(offsets[0])
    return offsets - base, raw[base:int(offsets[-1])]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_table(excluded: str) -> np.ndarray:
    """256 numbers: the byte itself (A-Z lower-cased) where it belongs to a word, else 0.

    ``excluded`` are the ASCII characters that part words (NUL always does); other bytes are
    letters of longer UTF-8 characters and belong to words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[0, *map(ord, excluded)]] = 0
    return table


def packed_words(offsets: np.ndarray, data: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, as one binary array, and the row of each; no word spans two rows."""
    data = table[data]
    inside = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - begin)))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])])
    return words, np.searchsorted(offsets, begin, "right") - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later plans start from the written copy."""
    return cut_lineage(df)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: unlike a checkpoint it has a known size, by which
    Spark chooses between broadcasting and shuffling it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a written table of ``scratch_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    """Configured number of shuffle partitions: the unit all explicit counts derive from."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_bound(rows: int, wanted: int) -> int:
    """A bound on 64-bit hashes under which about four times ``wanted`` of ``rows`` hashes lie (all of
    them if there are no more): sorting only those keeps what tasks send to the driver bounded."""
    share = min(1.0, 4 * wanted / max(rows, 1))
    return min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))


def group_ranks(df: DataFrame, keys: list[str], order: list[Column], spread: Column, rank: str,
                parts: int, piece: Column | None = None) -> DataFrame:
    """Adds ``rank``: a gapless number from 0 within each group of (non-null) ``keys``.

    A group is cut into ``parts`` pieces by ``spread`` (an expression of the row); rows are
    numbered inside a piece and each piece adds the counts of the pieces before it, so a group
    with a third of all rows is numbered by many tasks. The order is (piece, ``order``); a given
    ``piece`` (a number of the row) replaces the hash piece."""
    piece = F.pmod(F.xxhash64(spread), F.lit(parts)) if piece is None else piece
    # names that no column has
    piece_, local_, n_, before_ = (f"{c}_{uuid.uuid4().hex}" for c in ("piece", "local", "n", "before"))
    cut = df.withColumn(piece_, piece.cast("int"))
    group = [*keys, piece_]
    local = cut.withColumn(local_, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy(piece_).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*group).agg(F.count(F.lit(1)).alias(n_))
    offsets = counts.withColumn(before_, F.coalesce(F.sum(n_).over(before), F.lit(0))).drop(n_)
    return (local.join(offsets, group)
            .withColumn(rank, (F.col(before_) + F.col(local_)).cast("long"))
            .drop(piece_, local_, before_))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable over the links ``a``-``b``, for every linked node.

    Alternating large-star and small-star rounds; each round is an aggregate and a join over the
    link table, written to the checkpoint folder, until a round changes nothing. Nothing but
    two sums of the links comes to the driver."""
    now = checkpointed(edges.where(F.col(a) != F.col(b))
                       .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = checkpointed(small)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
