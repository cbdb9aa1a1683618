"""Counts, rates, scores, token statistics and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.functions.numbers import percent

MAX_SCORE = 5
TOKEN_LIMIT = 4096


def session_stats(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items, successes, failures, items that needed a retry, and their shares.

    With a `seconds` column, also the mean time per item.
    """
    counts = {
        "total": F.count("*"),
        "success": F.count_if(F.col("status") == "success"),
        "failed": F.count_if(F.col("status") == "failed"),
        "retries": F.count_if("needed_retry"),
    }
    if "seconds" in outcomes.columns:
        counts["mean_seconds"] = F.avg("seconds")
    stats = outcomes.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in counts.items()])
    return stats.withColumns(
        {
            "success_pct": percent(F.col("success"), F.col("total")),
            "failed_pct": percent(F.col("failed"), F.col("total")),
        }
    )


def total_items(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total_items"))


def pass_rate(checks: DataFrame, by: str = "run") -> DataFrame:
    """Total, passed, failed, warned and pass rate per folder, and overall with a NULL folder.

    Reads `valid`, and `warned` if there is one. Folders are counted first, so
    the overall row adds up one row per folder instead of doubling the input.
    """
    warned = F.count_if("warned") if "warned" in checks.columns else F.lit(0).cast("bigint")
    per_folder = checks.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("passed"),
        warned.alias("warnings"),
    )
    sums = per_folder.rollup(by).agg(
        F.grouping(by).cast("boolean").alias("overall"),
        *[F.sum(n).alias(n) for n in ["total", "passed", "warnings"]],
    )
    return sums.withColumns(
        {
            "failed": F.col("total") - F.col("passed"),
            "pass_rate": percent(F.col("passed"), F.col("total")),
        }
    )


def render_rate(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rendered share of the outputs in percent; 0 if there are none."""
    return (
        results.groupBy(*(by or []))
        .agg(F.count("*").alias("total"), F.count_if("rendered").alias("rendered"))
        .withColumn("rate", percent(F.col("rendered"), F.col("total")))
    )


def review_scores(rated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean quality and resemblance, and the resemblance rate; unrated outputs do not count."""
    return (
        rated.groupBy(*(by or []))
        .agg(F.avg("quality").alias("quality"), F.avg("resemblance").alias("resemblance"))
        .withColumn("resemblance_rate", F.col("resemblance") / MAX_SCORE * 100)
    )


def token_stats(counted: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Examples, their tokens in all, on average and at most, and how many exceed the limit."""
    n = F.col("n_tokens")
    return counted.agg(
        F.count("*").alias("examples"),
        F.sum(n).alias("total_tokens"),
        F.avg(n).alias("mean_tokens"),
        F.max(n).alias("max_tokens"),
        F.count_if(n > limit).alias("over_limit"),
    )


def longest(counted: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The example with the most tokens, the first one on ties."""
    return counted.orderBy(F.col("n_tokens").desc(), F.col(row_id).asc()).limit(1)


def over_limit(counted: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    return counted.filter(F.col("n_tokens") > limit)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def step_loss(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted mean loss per step over the tokens of its batch; NULL if all weights are 0.

    Reads per-example arrays `logprobs` and `weights`.
    """
    weights = F.aggregate("weights", F.lit(0).cast("bigint"), lambda total, w: total + w)
    per_step = log.groupBy(*(by or ["step"])).agg(
        F.sum(_dot(F.col("logprobs"), F.col("weights"))).alias("_weighted"),
        F.sum(weights).alias("_weight"),
    )
    loss = F.try_divide(-F.col("_weighted"), F.col("_weight"))
    return per_step.withColumn("loss", loss).drop("_weighted", "_weight")


def epoch_loss(steps: DataFrame, steps_per_epoch: int | Column) -> DataFrame:
    """Mean of the step losses of each epoch; steps and epochs count from 1."""
    epoch = F.floor((F.col("step") - 1) / steps_per_epoch) + 1
    return steps.groupBy(epoch.alias("epoch")).agg(F.avg("loss").alias("mean_loss"))


def steps_per_epoch(df: DataFrame, batch_size: int) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / batch_size).alias("steps"))


def source_counts(df: DataFrame, by: str = "source") -> DataFrame:
    """Examples per source, and in total with a NULL source."""
    per_source = df.groupBy(by).agg(F.count("*").alias("examples"))
    return per_source.rollup(by).agg(
        F.grouping(by).cast("boolean").alias("overall"), F.sum("examples").alias("examples")
    )
