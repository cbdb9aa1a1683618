"""From attempts to one outcome per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 5

# The reason of a failed item, by what its last attempt lacked.
REASONS = [
    "Failed to generate code after {n} attempts",
    "Failed to extract code after {n} attempts",
    "Failed validation after {n} attempts",
]


#: Bits of `won` below the attempt's number: they settle replays of one attempt.
REPLAY_BITS = 56


def _good() -> Column:
    return F.col("valid") & (F.col("code") != "")


def winning_number() -> Column:
    """The number of a valid attempt, then digits of its text's MD5; the least one wins, whatever the order."""
    text = F.concat_ws("\n", "code", "message")
    digits = F.conv(F.left(F.md5(text), F.lit(REPLAY_BITS // 4)), 16, 10).cast("bigint")
    return F.when(_good(), F.shiftleft(F.col("attempt").cast("bigint"), REPLAY_BITS) + digits)


def _within(attempts: DataFrame, max_retries: int) -> DataFrame:
    return attempts.filter(F.col("attempt").between(1, max_retries))


def attempt_numbers(
    attempts: DataFrame, max_retries: int = MAX_RETRIES, keys: list[str] | None = None
) -> DataFrame:
    """What decides an item, in integers: `won`, its first valid attempt, `last`, its last one, and what that lacks.

    Minima and maxima need no order, so that batch and streaming jobs share them, and numbers
    of parts of an item's attempts give those of all by `merged_numbers`. No text is carried.
    """
    keys = keys or ["row_id", "name"]
    code = F.col("code")
    # No answer leaves the code NULL, and an answer without code leaves it empty.
    lacks = F.when(code.isNull(), 0).when(code == "", 1).otherwise(2)
    return (
        _within(attempts, max_retries)
        .groupBy(*keys)
        .agg(
            F.min(winning_number()).alias("won"),
            F.max("attempt").alias("last"),
            F.max(F.col("attempt") * 10 + lacks).alias("lacks"),
        )
    )


def merged_numbers(numbers: DataFrame, keys: list[str]) -> DataFrame:
    return numbers.groupBy(*keys).agg(F.min("won").alias("won"), *[F.max(c).alias(c) for c in ("last", "lacks")])


def decided(numbers: DataFrame, attempts: DataFrame, max_retries: int, keys: list[str], open_: str) -> DataFrame:
    """Outcomes by their numbers, and the code of the winners among `attempts`.

    Only valid attempts carry their text: one of each number leaves a task, and meets its
    item by key and number. An item that is neither won nor lost has the status `open_`.
    """
    won = F.col("won").isNotNull()
    given_up = ~won & (F.col("last") >= max_retries)
    reason = F.get(F.array(*[F.lit(r.format(n=max_retries)) for r in REASONS]), F.col("lacks") % 10)
    texts = (
        _within(attempts, max_retries)
        .filter(_good())
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys], winning_number().alias("_won"))
        .agg(F.array_min(F.collect_set(F.struct("code", "message"))).alias("_text"))  # a set of one
    )
    same = F.col("won") == F.col("_won")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    number = F.coalesce(F.shiftright("won", REPLAY_BITS), F.col("last"))
    columns = {
        "status": F.when(won, "success").when(given_up, "failed").otherwise(open_),
        "attempt": number.cast(attempts.schema["attempt"].dataType),
        "code": F.col("_text.code"),
        "message": F.when(won, F.col("_text.message")).when(given_up, reason),
        "needed_retry": won & (number > 1),
    }
    return numbers.join(texts, same, "left").select(*keys, *[c.alias(n) for n, c in columns.items()])


def resolve_attempts(
    attempts: DataFrame, max_retries: int = MAX_RETRIES, keys: list[str] | None = None
) -> DataFrame:
    """One outcome per item: its first valid attempt, or why it failed, or `pending`.

    Reads `attempt, code, valid, message` and the key columns. Items are decided by integers, and
    a key with very many attempts is reduced before it moves; code is looked up afterwards.
    """
    keys = keys or ["row_id", "name"]
    return decided(attempt_numbers(attempts, max_retries, keys), attempts, max_retries, keys, "pending")


def winners(attempts: DataFrame, max_retries: int = MAX_RETRIES, keys: list[str] | None = None) -> DataFrame:
    """The outcomes of `resolve_attempts` that are successes, their code carried along instead of looked up.

    Suits attempts of which few are of the same item.
    """
    keys = keys or ["row_id", "name"]
    first = F.min(F.struct(winning_number().alias("won"), "code", "message")).alias("_first")
    won = _within(attempts, max_retries).filter(_good()).groupBy(*keys).agg(first)
    return won.select(*keys, F.lit("success").alias("status"), "_first.code", "_first.message")


def to_results(outcomes: DataFrame, original: str = "original_code") -> DataFrame:
    """Successful outcomes in the shape of the result set."""
    carried = F.col(original) if original in outcomes.columns else F.lit("")
    return outcomes.filter(F.col("status") == "success").select(
        "name",
        "code",
        carried.alias("original_code"),
        F.col("message").alias("status"),
        F.lit(True).alias("valid"),
    )


def to_failures(outcomes: DataFrame) -> DataFrame:
    """Failed outcomes with their reason."""
    return outcomes.filter(F.col("status") == "failed").select(
        "name", F.col("message").alias("error")
    )
