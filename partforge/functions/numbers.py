"""Rates as the reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of nothing is 0."""
    return part / F.greatest(whole, F.lit(1)) * 100


def one_decimal(c: Column) -> Column:
    """Text with one decimal. format_number rounds on the binary value, format_string does not."""
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))
