"""Several tables published at once, as numbered versions with one pointer written last.

    root/data/<load>/<table>/...   Parquet folders, written once and never changed
    root/published/<number>        a small JSON manifest: table -> its schema and the folders that make it up

A load writes its folders first. Publishing is one rename that puts the next manifest in place, so
a reader, which follows the highest manifest, sees all tables of one version or all of the next.
A load that dies before the rename leaves folders that no manifest names; the next writer removes
them (``recover``). A load may add folders to a table, so unchanged data are not copied; ``expire``
removes manifests and folders that only older versions name.

One writer at a time: a second one that publishes the same number gets an error and changes nothing.
Readers need no lock and change nothing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stallboard.stores import folders


class Published:
    """The tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.root}/published") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """``schema`` and ``folders`` of every table in a version (the latest by default); empty before the first."""
        if version is None:
            have = self.versions()
            if not have:
                return {}
            version = have[-1]
        return json.loads(folders.read_text(self.spark, f"{self.root}/published/{version:012d}"))

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of one version; None if the version has no such table."""
        return self.snapshot(version).get(table)

    def snapshot(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version: the manifest is read once, so they belong together."""
        return {t: self.frame(entry) for t, entry in self.manifest(version).items()}

    def frame(self, entry: dict) -> DataFrame:
        """The rows of some folders of one table; a folder may be empty."""
        schema = T.StructType.fromJson(entry["schema"])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/data/{p}") for p in entry["folders"]]
        return reduce(DataFrame.unionByName, parts)

    def begin(self) -> "Load":
        """A new load; what a broken one left behind goes first."""
        self.recover()
        return Load(self)

    def recover(self) -> list[str]:
        """Removes the loads that no manifest names; returns them."""
        named = {p.split("/")[0] for v in self.versions() for entry in self.manifest(v).values() for p in entry["folders"]}
        lost = [n for n in folders.names(self.spark, f"{self.root}/data") if n not in named]
        for name in lost:
            folders.remove(self.spark, f"{self.root}/data/{name}")
        for name in folders.names(self.spark, f"{self.root}/published"):
            if not name.isdigit():
                folders.remove(self.spark, f"{self.root}/published/{name}")
        return lost

    def expire(self, keep: int = 2) -> None:
        """Keeps the latest ``keep`` versions and what they name."""
        for version in self.versions()[:-keep]:
            folders.remove(self.spark, f"{self.root}/published/{version:012d}")
        self.recover()


class Load:
    """One load: tables are staged under its own folder and become visible together with ``publish``."""

    def __init__(self, store: Published):
        self.store, self.spark = store, store.spark
        have = store.versions()
        self.number = have[-1] + 1 if have else 1
        self.name = f"{self.number:012d}-{uuid.uuid4().hex}"
        self.tables = store.manifest()

    def _write(self, table: str, rows: DataFrame, partition_by: list[str], laid: bool = False) -> dict:
        path = f"{self.name}/{table}-{uuid.uuid4().hex[:8]}"
        # folders' columns come last when a partitioned table is read back
        rows = rows.select(*(c for c in rows.columns if c not in partition_by), *partition_by)
        if partition_by:  # few files a folder; Spark splits large folders and joins small ones
            (rows if laid else rows.hint("rebalance", *partition_by)).write.partitionBy(*partition_by).parquet(f"{self.store.root}/data/{path}")
        else:
            rows.write.parquet(f"{self.store.root}/data/{path}")
        return {"schema": rows.schema.jsonValue(), "folders": [path]}

    def replace(self, table: str, rows: DataFrame, partition_by: list[str] | None = None, laid: bool = False) -> DataFrame:
        """The whole table anew; returns it read back. ``laid`` rows come in partitions by folder and are not shuffled."""
        self.tables[table] = self._write(table, rows, partition_by or [], laid)
        return self.read(table)

    def append(self, table: str, rows: DataFrame, partition_by: list[str] | None = None, laid: bool = False) -> DataFrame:
        """More rows of a table, which keeps its folders; returns the rows that were added, read back."""
        new = self._write(table, rows, partition_by or [], laid)
        have = self.tables.get(table, {"folders": []})
        self.tables[table] = {"schema": new["schema"], "folders": [*have["folders"], *new["folders"]]}
        return self.store.frame(new)

    def read(self, table: str) -> DataFrame | None:
        """A table as this load leaves it."""
        return self.store.frame(self.tables[table]) if table in self.tables else None

    def publish(self) -> int:
        """Makes the load's tables the current version; returns its number."""
        place = f"{self.store.root}/published"
        folders.write_text_once(self.spark, f"{place}/{self.number:012d}", json.dumps(self.tables),
                                f"{place}/writing-{uuid.uuid4().hex}")
        return self.number
