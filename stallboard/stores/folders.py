"""Small file-system steps of the stored tables, through Hadoop's file systems (any store that Spark writes)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of ``path``, and its path constructor."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none if it is not there."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at(folder)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at(folder)))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at(path), True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str, aside: str) -> None:
    """Writes a file under a name that must not be there yet: first aside, then by one rename."""
    fs, at = file_system(spark, path)
    stream = fs.create(at(aside), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at(path)) or not fs.rename(at(aside), at(path)):
        fs.delete(at(aside), False)
        raise FileExistsError(f"{path} was written by another load")
