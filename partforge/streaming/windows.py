"""Statistics of event-time windows as a stream: windows that are past leave the state, late rows have a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partforge.functions.numbers import percent
from partforge.streaming.outcomes import COMPACT_EVERY
from partforge.streaming.versions import VersionLog

COUNTS = ["total", "success", "failed", "retries"]
TOLD, COME = "told", "come"


def summed(versions: DataFrame, keys: list[str]) -> DataFrame:
    return versions.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def log_of(spark: SparkSession, out: str, by: list[str], what: str) -> VersionLog:
    return VersionLog(spark, f"{out}/{what}", ["window_start", "window_end", *by], summed)


def stream_window_stats(
    outcomes: DataFrame,
    out: str,
    checkpoint: str,
    by: list[str],
    time: str,
    length: str,
    delay: str,
    every: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Counts of windows of `length` by event time, told once, when the watermark has passed a window's end.

    The watermark is `delay` behind the greatest event time of earlier micro-batches; the state holds the
    counts of windows that are not past. Next to what is told, each micro-batch stores the counts of all
    rows that came: what these have more than what was told of a window came too late. Rows without
    an event time are in neither.
    """
    one = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    rows = outcomes.withWatermark(time, delay).select(
        *by,
        time,
        F.lit(1).cast("bigint").alias("total"),
        one(F.col("status") == "success").alias("success"),
        one(F.col("status") == "failed").alias("failed"),
        one(F.col("needed_retry")).alias("retries"),
    )
    window = F.window(time, length)
    told = rows.groupBy(window.alias("window"), *by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    came = rows.withColumn("window", window).where("window is not null")
    columns = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *COUNTS]
    both = told.select(*columns, F.lit(TOLD).alias("what")).unionByName(came.select(*columns, F.lit(COME).alias("what")))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for what in (TOLD, COME):
            log = log_of(batch.sparkSession, out, by, what)
            log.save(summed(batch.where(F.col("what") == what), log.keys), batch_id)
            if batch_id % compact_every == compact_every - 1:
                log.compact(batch_id)
        batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        both.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(save)
        .start()
    )


def window_stats(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The windows told so far, a row for the rows in time and a row for those that were `late`.

    A window that was never told, although one with a later end was, had late rows only.
    """
    told, came = (log_of(spark, out, by, what).newest() for what in (TOLD, COME))
    keys = ["window_start", "window_end", *by]
    past = told.agg(F.max("window_end")).first()[0]
    minus = told.select(*keys, *[(-F.col(c)).alias(c) for c in COUNTS])
    late = summed(came.unionByName(minus), keys).where("total > 0")
    late = late.where(F.col("window_end") <= F.lit(past).cast("timestamp"))
    rows = told.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return rows.withColumns(
        {
            "success_pct": percent(F.col("success"), F.col("total")),
            "failed_pct": percent(F.col("failed"), F.col("total")),
        }
    )
