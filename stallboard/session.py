"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (a sort-merge join
# becomes a broadcast only when the shuffled side really is small), coalesces tiny
# shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # planner-side size check for broadcast joins: only sides estimated below this are
    # broadcast, everything else stays a shuffle join
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # a checkpoint's files go with the last reference to it
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "stallboard",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is only given for local runs; on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("STALLBOARD_DRIVER_MEM", "16g"))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for ``checkpoint()`` and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A fresh scratch folder is invented only
    for a local master (tests); elsewhere a machine-local folder would be lost to the other
    executors, so an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001 - not a session setting on this deployment
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="stallboard-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df, eager: bool = True):
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where one intermediate result feeds several passes: a lost executor then re-reads
    the checkpoint instead of recomputing the joins behind it. Makes sure the folder is set
    on whatever session runs the job (the cluster's ``spark.checkpoint.dir`` if given).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: With it, the files of a query's shuffles go when the query ends, not when the driver's garbage is next collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table_of(df):
    """Write ``df`` to a parquet table of its own in the shared folder and continue from it: like ``cut_lineage``, in a
    fraction of the bytes, for large results. The shuffles that made it are dropped once it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df) -> Iterator:
    """``table_of``, dropped at the end: for what nothing reads any more then."""
    from stallboard.stores import folders
    table = table_of(df)
    try:
        yield table
    finally:
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            folders.remove(df.sparkSession, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``stallboard`` importable in the Python workers that run grouped Arrow functions.

    A cluster deployment passes the package with ``--py-files``; when it is not there (a
    driver started elsewhere), the package is zipped once per application on the driver and
    added with ``addPyFile``, which Spark distributes to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="stallboard-pyfiles-"), "stallboard.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def spread_by(df, keys, factor: int = 3):
    """Hash-repartition ``df`` by ``keys`` into ``factor`` x the configured shuffle partitions, for
    grouped Python stages whose input is small in bytes but heavy in CPU. (The number of cores
    is not known before executors register, so it is not used.)

    AQE coalesces small shuffles into a few partitions (one Python worker would then fit
    every merchant), but it never coalesces a repartition with an explicit count. Spark
    drops such a repartition when the child is already hash-partitioned the same way with
    the same count, so the count is kept different from ``spark.sql.shuffle.partitions`` (one more where ``factor`` is 1).
    """
    n = factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) + (factor == 1)
    return df.repartition(n, *keys)
