"""The ledger of a generation session: its items, and its attempts in steps that are committed one by one.

A step is one attempt for each item that is still open of a wave, which is one or more slices; a slice is a range of
row ids. Steps are folders with names of their own. A row of the table `steps`, written after the folder,
commits a step; what is not committed does not count and is replaced when the step is made again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.sources.folders import is_complete

#: The first slice of the step's wave, and the last one: NULL, if it is of that slice alone.
STEP = "slice BIGINT, attempt INT, open BIGINT, started_at TIMESTAMP, until BIGINT"
#: The step that commits the items.
ITEMS = -1


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def steps(self) -> list[Row]:
        """The committed steps, one row each."""
        try:
            return self.spark.read.schema(STEP).parquet(f"{self.path}/steps").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def commit(
        self, number: int, attempt: int, still_open: int, started_at: datetime, until: int | None = None
    ) -> None:
        values = zip((number, attempt, still_open, started_at, until), T.StructType.fromDDL(STEP), strict=True)
        made = self.spark.range(0, 1, 1, 1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in values])
        made.write.mode("append").parquet(f"{self.path}/steps")

    def begin(self, items: DataFrame, slice_rows: int, source: DataFrame | None = None) -> None:
        """Store the items `(row_id, name)` of the session, if it is new; later they are what they were.

        With a `source`, also the code `(row_id, code)` they are generated anew for, slice by slice.
        """
        if any(s.slice == ITEMS for s in self.steps()):
            return
        at = datetime.now()
        number = F.expr(f"row_id div {slice_rows}").alias("slice")
        self._cut(items.select("row_id", "name", number), "items")
        if source is not None:
            asked = self.items().select("row_id").hint("merge")
            self._cut(source.select("row_id", "code", number).join(asked, "row_id", "left_semi"), "originals")
        self.commit(ITEMS, 0, 0, at)

    def _cut(self, rows: DataFrame, name: str) -> None:
        rows.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/{name}")

    def _slices_of(self, name: str, schema: str, numbers: list[int] | None) -> DataFrame:
        """Rows of all slices, or of some, of which only the folders are listed."""
        read, path = self.spark.read, f"{self.path}/{name}"
        if numbers is None:
            return read.schema(f"{schema}, slice BIGINT").parquet(path).drop("slice")
        return read.schema(schema).parquet(*[f"{path}/slice={n}" for n in numbers])

    def items(self, *numbers: int) -> DataFrame:
        """The items of the session, or of some slices."""
        return self._slices_of("items", "row_id BIGINT, name STRING", list(numbers) or None)

    def originals(self, *numbers: int) -> DataFrame | None:
        """The code that the items of the session, or of some slices, had; None, if the session did not store it."""
        if not is_complete(self.spark, f"{self.path}/originals"):
            return None
        return self._slices_of("originals", "row_id BIGINT, code STRING", list(numbers) or None)

    def slices(self) -> list[int]:
        """The slices that have items: their folders' names, not their rows."""
        rows = self.spark.read.schema("slice BIGINT, row_id BIGINT").parquet(f"{self.path}/items")
        return sorted(r.slice for r in rows.select("slice").distinct().collect())

    def waves(self, most: int) -> Iterator[tuple[list[int], Row | None]]:
        """The session's slices in waves, each with its last committed step, if it has one.

        A wave that has begun stays what it is. A new one has at most as many slices as come
        before it, and at most `most`, so that many small slices take few steps, while a step that is
        lost is never more than a slice, or than what came before.
        """
        last: dict[int, Row] = {}
        for step in sorted(self.steps(), key=lambda s: s.attempt):
            if step.slice != ITEMS:
                last[step.slice] = step
        numbers, at = self.slices(), 0
        while at < len(numbers):
            begun = last.get(numbers[at])
            if begun:
                until = begun.slice if begun.until is None else begun.until
                size = bisect_right(numbers, until) - at
            else:
                ahead = numbers[at : at + max(1, min(most, at))]
                size = next((i for i, n in enumerate(ahead) if n in last), len(ahead))
            yield numbers[at : at + size], begun
            at += size

    def folder(self, number: int, attempt: int) -> str:
        return f"{self.path}/attempts/slice_{number}/attempt_{attempt}"

    def write(
        self, made: DataFrame, number: int, attempt: int, until: int | None = None
    ) -> tuple[DataFrame, int]:
        """Make a step and commit it; gives its attempts, and how many of their items stay open."""
        at = datetime.now()
        made.write.mode("overwrite").parquet(self.folder(number, attempt))
        stored = self.read([(number, attempt)], made.schema)
        still_open = stored.where(~F.col("valid")).count()
        self.commit(number, attempt, still_open, at, until)
        return stored, still_open

    def read(self, steps: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        """The attempts of some steps."""
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.folder(*s) for s in steps])

    def attempts(self, schema: T.StructType) -> DataFrame:
        """All committed attempts."""
        return self.read([(s.slice, s.attempt) for s in self.steps() if s.slice != ITEMS], schema)
