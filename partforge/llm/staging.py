"""Tables that cut a plan, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.session import shared_folder

SHORT = 4096  # bytes a row, on average, up to which more rows are worked on at once
TOGETHER = 1 << 23  # bytes
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of `df`, written to the shared folder and read back.

    What follows no longer depends on the executors that computed the rows, and
    a table that several branches read is computed once.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """`text` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that working arrays stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of more rows if these are short."""
    return slices([batch], 1024 if batch.nbytes <= SHORT * batch.num_rows else 256)


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Even slices of a batch, of about `TOGETHER` bytes, so that values which come again are met once in many rows."""
    return slices([batch], max(1, -(-batch.num_rows // -(-max(1, batch.nbytes) // TOGETHER))))


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of `df` begins with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name
