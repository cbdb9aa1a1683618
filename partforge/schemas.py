"""Schemas of the tables the jobs exchange; files are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = T.StructType().add("name", "string").add("code", "string")

RESULT = (
    T.StructType()
    .add("name", "string")
    .add("code", "string")
    .add("original_code", "string")
    .add("status", "string")
    .add("valid", "boolean")
)

ATTEMPT = (
    T.StructType()
    .add("row_id", "long")
    .add("name", "string")
    .add("attempt", "integer")
    .add("response", "string")
    .add("error", "string")
    .add("finished_at", "timestamp")
)
