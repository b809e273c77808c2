"""C7 / K6: "contains" from stored posting lists of three-character grams.

Whether a row is found depends on the texts of its columns alone, and many rows share them (names, days, customers), so the
distinct lower-cased texts are indexed, not the rows. Every text is cut into all runs of three characters; a posting is a
(gram, text) pair, stored in folders by a hash of the gram and sorted by gram inside, beside the gram's number of texts. A
query of three characters or more starts at its rarest gram and keeps the texts that hold all of its
grams; the text itself then decides, so the answer is exactly that of a scan. The found texts are written, so that Spark
knows their size, and the rows that have one of them in a column are the answer: the rows are read once and, where the
found texts are few, not shuffled. A shorter query scans the rows.

A text goes by a 64-bit number in the postings; two texts of one number only add a candidate. A gram that stands in a
third of all texts is a long run of rows, never one value, and it is read only if all grams of a query are that common.

Nulls: a null text holds nothing. Rows with a null in their key are found by queries without a gram only. An empty query matches every row, as in the scan.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
FOLDERS = 32
#: Grams of a query that are intersected, the rarest first; the text decides the rest.
MOST_GRAMS = 4
FOLDER = "gram_folder"


def grams_of(text: Column) -> Column:
    """Distinct grams of one lower-cased text, empty for shorter ones and null."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    found = F.array_distinct(F.transform(starts, lambda k: F.substr(text, k, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, found).otherwise(F.array().cast("array<string>"))


def query_grams(query: str) -> list[str]:
    low = query.lower()
    return list(dict.fromkeys(low[k:k + GRAM] for k in range(len(low) - GRAM + 1)))


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def searched(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.lower(F.col(c).cast("string")) for c in columns]


class Postings:
    """Posting lists over the ``columns`` of a table whose rows are told apart by ``key``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], columns: list[str]):
        self.spark, self.root, self.key, self.columns = spark, root.rstrip("/"), key, columns

    def write(self, df: DataFrame) -> "Postings":
        df.write.parquet(f"{self.root}/rows")
        rows = self.spark.read.parquet(f"{self.root}/rows")
        # combined in each task before they are shuffled
        texts = (rows.select(F.explode(F.array_distinct(F.array(*searched(rows, self.columns)))).alias("text")).where(F.col("text").isNotNull()).distinct())
        texts.select(F.xxhash64("text").alias("text_id"), "text").write.parquet(f"{self.root}/texts")
        pairs = self.texts().select("text_id", F.explode(grams_of(F.col("text"))).alias("gram"))
        # a large folder (a common gram) is split over tasks by Spark, small ones share a task
        (pairs.withColumn(FOLDER, folder_of(F.col("gram"))).hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "gram")
         .write.partitionBy(FOLDER).parquet(f"{self.root}/postings"))
        counts = self._table("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        (counts.withColumn(FOLDER, folder_of(F.col("gram"))).hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "gram")
         .write.partitionBy(FOLDER).parquet(f"{self.root}/grams"))
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def texts(self) -> DataFrame:
        """(text_id, text): the distinct lower-cased texts of the searched columns."""
        return self.spark.read.schema("text_id long, text string").parquet(f"{self.root}/texts")

    def _table(self, name: str) -> DataFrame:
        """A stored table with its schema given, as an empty one has no file to tell it."""
        fields = ([T.StructField("text_id", T.LongType())] if name == "postings" else []) + [T.StructField("gram", T.StringType())]
        fields += [T.StructField("n", T.LongType())] if name == "grams" else []
        return self.spark.read.schema(T.StructType([*fields, T.StructField(FOLDER, T.IntegerType())])).parquet(f"{self.root}/{name}")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """Rows of some grams: their folders alone are listed, and row groups are skipped by the sorted gram."""
        numbers = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(folder_of(F.col("g"))).collect()]
        return self._table(table).where(F.col(FOLDER).isin(numbers) & F.col("gram").isin(grams))

    def candidates(self, query: str) -> DataFrame | None:
        """Numbers of the texts that hold the query's rarest grams; None if the query is too short for a gram."""
        grams = query_grams(query)
        if not grams:
            return None
        counts = {r.gram: r.n for r in self._of("grams", grams).collect()}  # the query's grams
        if len(counts) < len(grams):  # a gram that no text holds
            return self.texts().select("text_id").limit(0)
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:MOST_GRAMS]
        lists = [self._of("postings", [g]).select("text_id") for g in rarest]
        return reduce(lambda a, b: a.join(b, "text_id", "left_semi"), lists)

    def search(self, query: str) -> DataFrame:
        """Rows one of whose columns contains the query, cases ignored."""
        if not query:
            return self.rows()
        found, low = self.candidates(query), F.lit(query.lower())
        rows = self.rows()
        if found is None:
            return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(c, low), F.lit(False)) for c in searched(rows, self.columns))))
        place = f"{self.root}/found/{uuid.uuid4().hex}"
        self.texts().join(found, "text_id", "left_semi").where(F.contains(F.col("text"), low)).select("text").write.parquet(place)
        hits = self.spark.read.schema("text string").parquet(place)
        out = rows.dropna(subset=self.key)
        for k, c in enumerate(searched(rows, self.columns)):  # a text is there once, so no row is doubled
            out = out.join(hits.select(F.col("text").alias(f"_hit_{k}")), c == F.col(f"_hit_{k}"), "left")
        return out.where(reduce(lambda a, b: a | b, (F.col(f"_hit_{k}").isNotNull() for k in range(len(self.columns))))).select(*rows.columns)
