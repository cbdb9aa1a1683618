"""All registered queries and their SQL."""

from partforge.catalog import evaluation, generation, streams, texts, training  # noqa: F401
from partforge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
