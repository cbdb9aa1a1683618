"""The log of an updating stream: versions of rows by key, merged into snapshots while the stream runs.

A micro-batch has a folder of its own, which a repeated batch replaces. A snapshot holds the newest
version of each key up to a batch; it counts from the moment its folder is complete, so readers see
either the one before and the batches since, or the new one. What a snapshot replaces is removed
only with the next one, when a reader that began earlier is done with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.sources.folders import is_complete, names_in, remove

BATCH = "batch_id"


def last_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key, with its batch."""
    rest = [c for c in versions.columns if c not in (*keys, BATCH)]
    last = F.max(F.struct(BATCH, *rest)).alias("_last")
    return versions.groupBy(*keys).agg(last).select(*keys, f"_last.{BATCH}", *[f"_last.{c}" for c in rest])


class VersionLog:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str],
        merge: Callable[[DataFrame, list[str]], DataFrame] = last_versions,
    ):
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), keys, merge
        self.snapshots = f"{self.path}-snapshots"

    def save(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")

    def complete(self) -> list[int]:
        """The last batches of the snapshots that count, in order."""
        found = [n.split("=")[1] for n in names_in(self.spark, self.snapshots) if n.startswith("upto=")]
        return sorted(int(n) for n in found if is_complete(self.spark, f"{self.snapshots}/upto={n}"))

    def versions(self, upto: int | None = None) -> DataFrame:
        """The last snapshot and the batches after it; all versions of a key that matter."""
        done = self.complete()
        after = done[-1] if done else -1
        parts = [self.spark.read.parquet(f"{self.snapshots}/upto={after}")] if done else []
        try:
            batches = self.spark.read.parquet(self.path).withColumn(BATCH, F.col(BATCH).cast("bigint"))
            batches = batches.where(F.col(BATCH) > after)
            parts.append(batches if upto is None else batches.where(F.col(BATCH) <= upto))
        except AnalysisException as missing:
            if not parts or missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def newest(self) -> DataFrame:
        return self.merge(self.versions(), self.keys).drop(BATCH)

    def compact(self, upto: int) -> None:
        """A snapshot of all batches up to one; then the files that the snapshot before this one replaced go."""
        before = self.complete()
        if before and before[-1] >= upto:
            return
        merged = self.merge(self.versions(upto), self.keys)
        if BATCH not in merged.columns:
            merged = merged.withColumn(BATCH, F.lit(upto).cast("bigint"))
        merged.write.mode("overwrite").parquet(f"{self.snapshots}/upto={upto}")
        replaced = before[-1] if before else -1
        for name in names_in(self.spark, self.path):
            if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= replaced:
                remove(self.spark, f"{self.path}/{name}")
        for old in before[:-1]:
            remove(self.spark, f"{self.snapshots}/upto={old}")


def newest(
    spark: SparkSession, out: str, keys: list[str], schema: T.StructType | None = None
) -> DataFrame:
    """The newest version of each key in the log of an updating stream.

    With the `schema` of the rows, a log that no batch has written to yet is empty;
    without, that is an error.
    """
    try:
        return VersionLog(spark, out, keys).newest()
    except AnalysisException as missing:
        if schema is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
