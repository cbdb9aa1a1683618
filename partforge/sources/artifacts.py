"""Evaluation outputs as files: header and code, one file per output."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partforge.functions.prompts import ARTIFACT_SUFFIX, artifact_name
from partforge.session import shared_folder

# The header of an artifact.
HEADER = ["// Generated by ", "// Prompt: ", "// Generated at: "]
STAMP = "yyyy-MM-dd HH:mm:ss"

GENERATOR = "partforge"
#: Tasks that read artifact files, at most, for each core of the session.
TASKS_PER_CORE = 16
_PARSED_HEADER = r"(?d)\A// Generated by .*\n// Prompt: (.*?)\r?\n// Generated at: (.*?)\r?\n\r?\n"


def render_artifact(df: DataFrame, generator: str = GENERATOR) -> DataFrame:
    """Add `file_name` and `content` to outputs `(run, ordinal, object, prompt, generated_at, code)`."""
    stamp = F.date_format("generated_at", STAMP)
    values = [F.lit(generator), F.col("prompt"), stamp]
    lines = [F.concat(F.lit(label), value) for label, value in zip(HEADER, values)]
    return df.withColumns(
        {
            "file_name": artifact_name(F.col("ordinal"), F.col("object")),
            "content": F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.col("code")),
        }
    )


def write_artifacts(rendered: DataFrame, path: str) -> None:
    """Rendered artifacts as a table, one folder per run."""
    rendered.select("run", "file_name", "content").write.mode("append").partitionBy("run").parquet(
        path
    )


def write_artifact_files(rendered: DataFrame, path: str) -> DataFrame:
    """Rendered artifacts as a file each, `<run>/<file_name>` below `path`; gives `(path, bytes)` of what was written.

    Tasks write their own files, through Arrow's file systems, so `path` may be local to all, or a URI that
    Arrow knows. A repeated task writes the same files again. The rows given are what the job has stored.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        folders = set()
        for batch in batches:
            paths, sizes = [], []
            for run, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run not in folders:
                    files.create_dir(f"{root}/{run}", recursive=True)
                    folders.add(run)
                data = (content or "").encode()
                with files.open_output_stream(f"{root}/{run}/{name}") as out:
                    out.write(data)
                paths.append(f"{run}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    made = rendered.select("run", "file_name", "content").mapInArrow(written, "path STRING, bytes BIGINT")
    stored = shared_folder(rendered.sparkSession, "written")
    made.write.parquet(stored)
    return rendered.sparkSession.read.schema(made.schema).parquet(stored)


def missing_files(written: DataFrame, files: DataFrame) -> DataFrame:
    """`(path, bytes, found)` of written files that are not among `files` `(path, content)`, or not with as many bytes."""
    tail = F.regexp_extract("path", r"([^/]*/[^/]*)$", 1)
    there = files.select(tail.alias("path"), F.octet_length("content").cast("bigint").alias("found"))
    both = written.join(there, "path", "left")
    return both.where(~F.col("bytes").eqNullSafe(F.col("found")))


def read_artifact_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of `write_artifacts`, with paths as `read_artifacts` gives them."""
    table = spark.read.schema("file_name STRING, content STRING, run STRING").parquet(path)
    return table.select(F.concat_ws("/", "run", "file_name").alias("path"), "content")


def read_artifacts(spark: SparkSession, *paths: str) -> DataFrame:
    """All artifact files in the given folders and below, one row each.

    Spark plans a task for some 32 small files, however many there are; here a task takes more of them.
    """
    files = (
        spark.read.option("pathGlobFilter", "*" + ARTIFACT_SUFFIX)
        .option("recursiveFileLookup", True)
        .text(list(paths), wholetext=True)
    )
    found = files.select(file_path().alias("path"), F.col("value").alias("content"))
    return found.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def store_artifacts(found: DataFrame) -> DataFrame:
    """The artifacts as a table in the shared folder, for jobs that look at them more than once: each file is read once."""
    stored = shared_folder(found.sparkSession, "found")
    found.write.parquet(stored)
    return found.sparkSession.read.schema(found.schema).parquet(stored)


def file_path() -> Column:
    """The path of the file a row is from, as it is written on disk: the scan gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def parse_artifact(df: DataFrame) -> DataFrame:
    """`(run, ordinal, object, prompt, generated_at, code)` of artifact files `(path, content)`.

    A file without the header is all code.
    """
    named = r"([^/]*)/(\d+)_([^/]*)" + ARTIFACT_SUFFIX.replace(".", r"\.") + "$"
    stamp = F.try_to_timestamp(_part(F.col("content"), _PARSED_HEADER, 2), F.lit(STAMP))
    return df.select(
        _part(F.col("path"), r"([^/]*)/[^/]*$", 1).alias("run"),
        _part(F.col("path"), named, 2).cast("int").alias("ordinal"),
        _part(F.col("path"), named, 3).alias("object"),
        _part(F.col("content"), _PARSED_HEADER, 1).alias("prompt"),
        stamp.alias("generated_at"),
        F.regexp_replace("content", _PARSED_HEADER, "").alias("code"),
    )
