"""Generation outcomes as streams: check attempts as they arrive, resolve items, keep counts.

Sinks are folders with one sub-folder per micro-batch that a repeated batch
overwrites, so a restart neither loses nor doubles rows. A state that may still
change is written as a log of versions, which is merged while the stream runs; readers take
the newest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from partforge.operators.attempts import MAX_RETRIES, attempt_numbers, decided
from partforge.operators.checks import check_response
from partforge.operators.stats import session_stats
from partforge.streaming.versions import VersionLog, last_versions, newest

__all__ = ["newest", "read_attempts", "resolved_items", "stream_outcomes", "stream_resolve", "stream_stats"]

#: Micro-batches after which a log is merged.
COMPACT_EVERY = 50


def read_attempts(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*", per_batch: int = 1000
) -> DataFrame:
    """Parquet files of attempts as a stream, at most `per_batch` files at a time."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(path)
    )


def write_batches(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    mode: str,
    every: str | None,
    keys: list[str] | None = None,
    compact_every: int | None = None,
    merge: Callable[[DataFrame, list[str]], DataFrame] = last_versions,
) -> StreamingQuery:
    """A folder per micro-batch; with `keys`, a log of versions that is merged every so many batches."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def save(batch: DataFrame, batch_id: int) -> None:
        log = VersionLog(batch.sparkSession, out, keys or [], merge)
        log.save(batch, batch_id)
        if keys and compact_every and batch_id % compact_every == compact_every - 1:
            log.compact(batch_id)

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(save)
        .start()
    )


def stream_outcomes(
    attempts: DataFrame,
    out: str,
    checkpoint: str,
    check: Callable[[DataFrame], DataFrame] = check_response,
    every: str | None = None,
) -> StreamingQuery:
    """Check each attempt and append it, once.

    Here and below, a query with `every` (like "1 minute") runs on; without, it ends when it
    has taken what is there.
    """
    return write_batches(check(attempts), out, checkpoint, "append", every)


def stream_resolve(
    checked: DataFrame,
    out: str,
    checkpoint: str,
    max_retries: int = MAX_RETRIES,
    keys: list[str] | None = None,
    every: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Keep what decides every item up to date while its attempts come in: numbers only, in state and log."""
    keys = keys or ["row_id", "name"]
    numbers = attempt_numbers(checked, max_retries, keys)
    return write_batches(numbers, out, checkpoint, "update", every, keys, compact_every)


def resolved_items(
    spark: SparkSession,
    out: str,
    checked: DataFrame,
    max_retries: int = MAX_RETRIES,
    keys: list[str] | None = None,
) -> DataFrame:
    """The outcomes that the log of `stream_resolve` holds, with the winners' code from the stored attempts."""
    keys = keys or ["row_id", "name"]
    return decided(newest(spark, out, keys), checked, max_retries, keys, "pending")


def stream_stats(
    outcomes: DataFrame,
    out: str,
    checkpoint: str,
    by: list[str],
    every: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Keep the counts of every session up to date while its items finish.

    The counts stay in state for good; `windows.stream_window_stats` lets go of those that are past.
    """
    return write_batches(session_stats(outcomes, by), out, checkpoint, "update", every, by, compact_every)
