"""Attempts of items as a stream whose state lets go: of an item once it is decided, or after a time without attempts.

Items are dealt into a fixed number of groups by a hash of their keys. A group has one state, the open items in
it, and Python is called once a group and micro-batch, not once an item.

What decides an item are minima and maxima, so a decision is never wrong for good: an attempt that
comes after its item's state was dropped starts a new state, and readers merge what both said.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partforge.operators.attempts import MAX_RETRIES, decided, merged_numbers, winning_number
from partforge.streaming.outcomes import COMPACT_EVERY, write_batches
from partforge.streaming.versions import VersionLog

NUMBERS = ["won", "last", "lacks"]
#: In place of NULL, as pandas would make a column with one of floats.
NOT_WON = (1 << 63) - 1
EXPIRED = "expired"
GROUPS = 1024
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def as_text(key: Column, kind: T.DataType) -> Column:
    """A key as text that `from_text` turns back, NULL as NULL: pandas would make integers with NULLs floats."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.when(key.isNotNull(), F.to_json(F.struct(key.alias("k")), JSON))
    return F.base64(key) if isinstance(kind, T.BinaryType) else key.cast("string")


def from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.from_json(text, T.StructType([T.StructField("k", kind)]), JSON).getField("k")
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def stream_resolve_expiring(
    checked: DataFrame,
    out: str,
    checkpoint: str,
    seconds: int,
    delay: str,
    time: str = "ts",
    max_retries: int = MAX_RETRIES,
    keys: list[str] | None = None,
    every: str | None = None,
    compact_every: int = COMPACT_EVERY,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Tell each item's numbers once it has a valid attempt or its last one, or no attempt for `seconds`.

    `time` is the event time; the watermark is `delay` behind its maximum, and `seconds` count from an
    item's last attempt to the watermark. The state of an item is its keys and four integers, kept only while
    it is undecided and not that old; items of one of the `groups` are kept together, so take more groups for
    very many open items. Attempts from before the watermark are dropped, so `delay` must
    cover how late attempts come. Use `expiring_items` to read the log.
    """
    keys = keys or ["row_id", "name"]
    lacks = F.when(F.col("code").isNull(), 0).when(F.col("code") == "", 1).otherwise(2)
    named = checked.withWatermark(time, delay).filter(F.col("attempt").between(1, max_retries))
    kinds = [named.schema[k].dataType for k in keys]
    names = [f"key_{i}" for i in range(len(keys))]
    rows = named.select(
        *[as_text(F.col(k), kind).alias(n) for k, kind, n in zip(keys, kinds, names, strict=True)],
        F.coalesce(winning_number(), F.lit(NOT_WON)).alias("won"),
        F.col("attempt").cast("bigint").alias("last"),
        (F.col("attempt") * 10 + lacks).cast("bigint").alias("lacks"),
        F.coalesce(F.unix_millis(time), F.lit(0)).alias("at"),
        time,
    ).withColumn("group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    output = T.StructType(
        [*[T.StructField(n, T.StringType()) for n in names], *[T.StructField(n, T.LongType()) for n in NUMBERS]]
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        # the open items: their keys, and their numbers with the watermark after which they expire
        held = {tuple(item): numbers for item, numbers in json.loads(state.get[0])} if state.exists else {}
        come: dict[tuple, tuple] = {}
        if not state.hasTimedOut:
            for rows in frames:
                columns = [rows[c].tolist() for c in (*NUMBERS, "at")]
                for item, *new in zip(zip(*[rows[n].tolist() for n in names], strict=True), *columns, strict=True):
                    won, last, lacks, at = come.get(item) or (*held.get(item, (NOT_WON, 0, 0))[:3], 0)
                    come[item] = min(won, new[0]), max(last, new[1]), max(lacks, new[2]), max(at, new[3])
        told = []
        for item, (won, last, lacks, at) in come.items():
            held[item] = won, last, lacks, max(at + seconds * 1000, mark + 1)
            if won != NOT_WON or last >= max_retries:
                told.append((*item, *held.pop(item)[:3]))
        for item in [x for x, numbers in held.items() if numbers[3] < mark]:
            told.append((*item, *held.pop(item)[:3]))
        if held:
            state.update((json.dumps(list(held.items())),))
            state.setTimeoutTimestamp(min(numbers[3] for numbers in held.values()))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=output.names)

    numbers = rows.groupBy("group").applyInPandasWithState(
        follow, output, "items string", "append", GroupStateTimeout.EventTimeTimeout
    )
    numbers = numbers.select(
        *[from_text(F.col(n), kind).alias(k) for k, kind, n in zip(keys, kinds, names, strict=True)], *NUMBERS
    )
    numbers = numbers.withColumn("won", F.nullif("won", F.lit(NOT_WON)))
    return write_batches(numbers, out, checkpoint, "append", every, keys, compact_every, merged_numbers)


def expiring_items(
    spark: SparkSession,
    out: str,
    checked: DataFrame,
    max_retries: int = MAX_RETRIES,
    keys: list[str] | None = None,
) -> DataFrame:
    """The outcomes told so far, `expired` for items that had no more attempts in time; others are still open."""
    keys = keys or ["row_id", "name"]
    numbers = VersionLog(spark, out, keys, merged_numbers).newest()
    return decided(numbers, checked, max_retries, keys, EXPIRED)
