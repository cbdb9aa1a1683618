"""Resume, ratings and original-code joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.sources.results import NAME_KEY, name_key


def done_names(results: DataFrame) -> DataFrame:
    """Names that already have a result."""
    return results.select("name").distinct()


def not_done(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose name has no result yet; a NULL name matches a NULL name.

    The names are made distinct first, so a name with many results moves once
    per map task. Both sides then meet in a plain shuffle or broadcast join,
    which lets adaptive execution split a hot name on the left.
    """
    names = done_names(done).withColumnRenamed("name", "_done")
    return df.join(names, F.col("name").eqNullSafe(F.col("_done")), "left_anti")


def not_done_bucketed(df: DataFrame, results: DataFrame) -> DataFrame:
    """As `not_done`, against results stored in buckets by name: only the rows of `df` move to meet them."""
    keyed = df.withColumn(NAME_KEY, name_key(F.col("name")))
    return keyed.join(results.select(NAME_KEY), NAME_KEY, "left_anti").select(*df.columns)


def with_ratings(outputs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each output with its quality and resemblance; unrated outputs stay."""
    return outputs.join(
        reviews.select("run", "ordinal", "quality", "resemblance"), ["run", "ordinal"], "left"
    )


def with_original(results: DataFrame, source: DataFrame) -> DataFrame:
    """Results next to the code they were generated anew for."""
    original = source.select("row_id", F.col("code").alias("original_code"))
    return results.join(original, "row_id", "left")
