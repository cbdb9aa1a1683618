"""Check stored artifacts and report pass rates per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.operators.checks import check_syntax, validator_status
from partforge.operators.stats import pass_rate


def validate_syntax(files: DataFrame) -> DataFrame:
    """Pass rates of artifact files `(path, content)` by the static check of the whole file."""
    whole = files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("run"), "content")
    return pass_rate(check_syntax(whole, "content"))


def validate_logs(log: DataFrame) -> DataFrame:
    """Pass rates of compile logs `(run, exit_code, output)`."""
    return pass_rate(validator_status(log).withColumn("valid", F.col("passed")))
