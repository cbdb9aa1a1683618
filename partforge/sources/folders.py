"""Folders of tables in whatever file system Spark reads them from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    files, at = _of(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has written the folder to its end."""
    files, at = _of(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _of(spark, path)
    files.delete(at, True)
