"""Source datasets: reading, row ids, concatenation, and the prepared-data sink."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.session import shared_folder

log = logging.getLogger(__name__)


class NoDatasetError(ValueError):
    """None of the given sources could be loaded."""


def read_dataset(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Rows of a dataset. Without a schema, parquet files are taken as they describe themselves."""
    if fmt != "parquet" and schema is None:
        raise ValueError(f"{fmt} files need a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def exact_path(path: str) -> str:
    """A path as a reader takes it literally, whatever characters of patterns it has."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


_FILE = "_file"


def file_index(df: DataFrame) -> DataFrame:
    """`(_file, _rows)` of the files of a parquet dataset just read: a job over their footers, no data."""
    return df.groupBy(F.col("_metadata.file_path").alias(_FILE)).agg(F.count("*").alias("_rows"))


def placed_files(index: DataFrame, order: list[str]) -> DataFrame:
    """The files with `_start`, the rows of all files before them: one row a file, ordered in one task."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def with_row_id(df: DataFrame, name: str = "row_id", index: DataFrame | None = None) -> DataFrame:
    """Add the 0-based position of each row of a parquet dataset, in file and row order.

    A row's place in its file comes from the scan and the rows per file from the
    footers, so no row is moved or sorted and every replay gives the same ids. The footers are
    those in `index`, the `file_index` of the dataset as it was read; without one, files are
    listed and read again, as `df` may be filtered, and positions are not.
    """
    if index is None:
        files = [exact_path(unquote(f)) for f in df.inputFiles()]
        if not files:
            return df.select("*", F.col("_metadata.row_index").alias(name))
        index = file_index(df.sparkSession.read.parquet(*files))
    return _numbered(df, placed_files(index, [_FILE]), name)


def _numbered(df: DataFrame, files: DataFrame, name: str) -> DataFrame:
    file, at = F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias("_index")
    placed = df.select("*", file, at).join(files.select(_FILE, "_start"), _FILE)
    return placed.withColumn(name, F.col("_start") + F.col("_index")).drop(_FILE, "_index", "_start")


def with_default(df: DataFrame, column: str, value: str = "") -> DataFrame:
    """Add a missing column with a default; NULLs of a present one stay."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all datasets, duplicates included; a single one passes through."""
    return reduce(DataFrame.unionByName, dfs)


#: Spark's conditions of a source that is not there or does not describe itself, by the stage at which they arise.
LISTING, SCHEMA, FOOTERS = "listing", "schema", "footers"
CONDITIONS = {"PATH_NOT_FOUND": LISTING, "UNABLE_TO_INFER_SCHEMA": SCHEMA, "CANNOT_MERGE_SCHEMA": SCHEMA}
#: Words of the cause of a file whose footer cannot be read.
CORRUPT = ("is not a Parquet file", "FileMetaData", "footer index is not within the file")


def failed_stage(error: Exception) -> str | None:
    """The stage at which a source itself is at fault; none if it is the job that read it."""
    if isinstance(error, PySparkException):
        return CONDITIONS.get((error.getCondition() or "").split(".")[0])
    cause = error.java_exception
    while cause is not None:
        said = str(cause.getMessage())
        if any(x in said for x in CORRUPT):
            return FOOTERS
        for condition, stage in CONDITIONS.items():
            if f"[{condition}" in said:
                return stage
        cause = cause.getCause()
    return None


@dataclass(frozen=True)
class Sources:
    """The rows of the sources that load, and `(source, path, stage, reason)` of the others."""

    rows: DataFrame
    rejects: DataFrame


def read_sources(
    spark: SparkSession,
    paths: dict[str, str],
    schema: T.StructType | None = None,
    columns: list[Column | str] | None = None,
) -> Sources:
    """Concatenate the named sources that load; fail if none does.

    A source is read, and the footers of its files are counted, once, into a table of files in
    the shared folder. A source that is missing, without a schema, or with a corrupt footer at that is
    rejected; any other error, then and later, is raised, as it would drop the rows of a sound source.
    Adds `source`, and `row_id` counting on from source to source in the given order.
    """
    loaded, rejects, files = [], [], shared_folder(spark, "files")
    for number, (source, path) in enumerate(paths.items()):
        try:
            df = read_dataset(spark, path, schema)
            counted = file_index(df).select(F.lit(number).alias("_number"), _FILE, "_rows")
            counted.coalesce(1).write.mode("append").parquet(files)
        except (PySparkException, Py4JJavaError) as error:
            stage = failed_stage(error)
            if not stage:
                raise
            log.warning("skipping source %s: %s", source, error)
            rejects.append((source, path, stage, str(error).split("\n")[0]))
            continue
        loaded.append((number, source, df))
    if not loaded:
        raise NoDatasetError("no source could be loaded: " + ", ".join(paths))
    index = spark.read.schema(f"_number INT, {_FILE} STRING, _rows BIGINT").parquet(files)
    starts = placed_files(index, ["_number", _FILE])
    rows = []
    for number, source, df in loaded:
        placed = _numbered(df, starts.where(F.col("_number") == number), "row_id")
        rows.append(placed.select("row_id", F.lit(source).alias("source"), *(columns or df.columns)))
    schema = "source STRING, path STRING, stage STRING, reason STRING"
    return Sources(union_all(rows), spark.createDataFrame(rejects, schema))


def read_many(
    spark: SparkSession,
    paths: dict[str, str],
    schema: T.StructType | None = None,
    columns: list[Column | str] | None = None,
) -> DataFrame:
    """The rows of `read_sources`."""
    return read_sources(spark, paths, schema, columns).rows


def write_prepared(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Prepared rows for a trainer, replacing those of an earlier run."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
