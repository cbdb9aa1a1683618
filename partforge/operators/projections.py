"""Row selection and the shapes of instruction data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partforge.functions.prompts import ASSISTANT, instruction
from partforge.operators.ordering import id_cells, running_totals

# Turns of one conversation that are looked at together.
TURN_BITS = 10


def head_n(df: DataFrame, n: int | None, row_id: str = "row_id") -> DataFrame:
    """The first n rows by row id, or all of them if n is None or 0; no task gathers them."""
    if not n:
        return df
    place = {"_place": F.lit(1).cast("bigint")}
    placed = running_totals(df, [], id_cells(row_id), [F.col(row_id)], place)
    return placed.filter(F.col("_place") <= n).drop("_place")


def row_at(df: DataFrame, i: int, row_id: str = "row_id") -> DataFrame:
    """The row at position i of a dataset whose row ids are positions."""
    return df.filter(F.col(row_id) == i)


def to_pairs(df: DataFrame, verb: str = "create", assistant: str = ASSISTANT) -> DataFrame:
    """Instruction pairs of source examples; other columns stay."""
    rest = [c for c in df.columns if c not in ("name", "code")]
    return df.select(
        *rest,
        instruction(F.col("name"), verb, assistant).alias("input"),
        F.col("code").alias("output"),
    )


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Instruction pairs `(conv_id, turn, input, output)` of a table of turns.

    A pair is a user turn and an assistant turn right after it. Turns are
    compared in stretches of 2 ** TURN_BITS, and the first turn of a stretch is
    also seen by the one before, so a conversation of any length is spread.
    """
    stretch = F.shiftright("turn", TURN_BITS)
    first = F.pmod("turn", F.lit(1 << TURN_BITS)) == 0
    seen_by = F.when(first, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    seen = turns.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", "text", F.explode(seen_by).alias("_stretch")
    )
    following = Window.partitionBy("conv_id", "_stretch").orderBy("turn")
    nxt = F.lead(F.struct("turn", "role", "text")).over(following)
    return (
        seen.withColumn("_next", nxt)
        .filter(
            (F.col("role") == "user")
            & (F.col("_next.role") == "assistant")
            & (F.col("_next.turn") == F.col("turn") + 1)
        )
        .select("conv_id", "turn", F.col("text").alias("input"), F.col("_next.text").alias("output"))
    )
