"""The progress log of a generation session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.operators.ordering import Split, running_totals

_SECOND = 1_000_000
# Hours with more completions are cut into seconds and instants, and an instant into ranges of 2 ** PART_BITS row ids.
FULL_HOUR = 1 << 20
PART_BITS = 20


def _micros_cell(micros: Column, seconds: int) -> Column:
    return F.floor(micros / (seconds * _SECOND))


def progress(completions: DataFrame, full_hour: int = FULL_HOUR) -> DataFrame:
    """Add to each completion its number, elapsed time, mean, remaining items, ETA and counts so far.

    Reads `session, row_id, started_at, finished_at, total, status, needed_retry`.
    Cells are hours, which suit completions that are far apart. An hour that is full is cut into
    seconds and instants: a second holds at most a million instants, and an instant is cut by row
    id, whatever the session's size.
    """
    micros = F.unix_micros("finished_at")

    def one_if(condition: Column) -> Column:
        return F.coalesce(condition.cast("bigint"), F.lit(0))

    numbered = running_totals(
        completions,
        ["session"],
        [_micros_cell(micros, 3600)],
        [micros, F.col("row_id")],
        {
            "completed": F.lit(1).cast("bigint"),
            "success": one_if(F.col("status") == "success"),
            "failed": one_if(F.col("status") == "failed"),
            "retries": one_if(F.col("needed_retry")),
        },
        Split(
            full_hour,
            [
                _micros_cell(micros, 1),
                F.struct(micros.alias("at"), F.shiftright("row_id", PART_BITS).alias("part")),
            ],
        ),
    )
    spent = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / _SECOND
    mean = spent / F.col("completed")
    left = F.col("total") - F.col("completed")
    return numbered.withColumns(
        {
            "elapsed_seconds": F.floor(spent),
            "mean_seconds": mean,
            "remaining": left,
            "eta_seconds": F.floor(mean * left),
        }
    )
