"""The result set: what earlier sessions produced, and appending to it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.schemas import RESULT


_BROKEN = "_broken"
#: Results in a file that is one array.
ARRAY_ROWS = 4096


def _records(spark: SparkSession, path: str, array: bool) -> DataFrame:
    """`(path, record, broken)` of JSON files: each record with all its fields, whatever is selected later.

    Options keep the optimizer from parsing only the fields that are used, which
    would make the verdict on a record depend on the query.
    """
    schema = T.StructType([*RESULT.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    files = spark.read.text(path, wholetext=array).select(F.col("_metadata.file_path").alias("path"), "value")
    if array:
        # the elements as text, so that one bad element does not hide the others; NULL is no array at all
        parts = files.select("path", F.from_json("value", "array<string>", {"mode": "PERMISSIVE"}).alias("parts"))
        held = parts.select("path", "parts", F.size("parts").alias("n"))  # parsed once a file, not once an element
        files = held.where("n is null or n <> 0").select("path", F.explode_outer("parts").alias("value"))
    else:
        files = files.where(F.trim("value") != "")
    read = files.withColumn("record", F.from_json("value", schema, options))
    broken = F.col("value").isNull() | F.col("record").isNull() | F.col(f"record.{_BROKEN}").isNotNull()
    return read.select("path", "record", broken.alias("broken"))


def rejected_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """`(path, reason)` of the JSON files of which `read_results` takes no row."""
    bad = _records(spark, path, fmt == "json_array").where("broken").select("path").distinct()
    return bad.select("path", F.lit("a record is malformed or has a field of another type").alias("reason"))


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Earlier results; none where the path is missing, and none from a file that does not parse.

    `fmt` is `parquet`, `json` (one result per line) or `json_array` (one array
    per file, which only one task can read: many files, or another format, suit
    large sets better). A JSON file is taken as a whole or not at all, on all fields of
    the schema, so every selection sees the same rows; `rejected_results` names the others.
    """
    try:
        if fmt == "parquet":
            return spark.read.schema(RESULT).parquet(path)
        records = _records(spark, path, fmt == "json_array")
        good = records.join(records.where("broken").select("path").distinct(), "path", "left_anti")
        return good.select(*[F.col(f"record.{x}").alias(x) for x in RESULT.fieldNames()])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULT)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append results; what is already there is not read or rewritten.

    As `json_array`, each file is one array, of at most `ARRAY_ROWS` results.
    """
    rows = df.select(RESULT.fieldNames())
    if fmt != "json_array":
        rows.write.mode("append").format(fmt).save(path)
        return
    record = F.to_json(F.struct(*RESULT.fieldNames()), {"ignoreNullFields": "false"})
    # rows of a task are counted through, so a group is a stretch of them and never more
    stretch = F.floor(F.monotonically_increasing_id() / ARRAY_ROWS)
    arrays = rows.select(record.alias("record"), stretch.alias("stretch")).groupBy("stretch").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("record"), ",\n"), F.lit("\n]")).alias("value")
    )
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)


#: The bucketing column: a name as it is, or that it is NULL, so that names are compared as keys.
NAME_KEY = "name_key"


def name_key(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), name), F.lit("-"))


def open_results(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The results stored in `buckets` by name at `path`, as a table of this session; empty if nothing is there yet.

    Every session has to give the number of buckets that the first one gave.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*RESULT.fields, T.StructField(NAME_KEY, T.StringType())])
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({NAME_KEY}) SORTED BY ({NAME_KEY}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(table)


def append_bucketed(df: DataFrame, table: str) -> None:
    """Append results to an opened table: its rows are dealt out to buckets once, and what is there stays as it is.

    A frame of the table that was made before does not have them: take `spark.table(table)` anew.
    """
    columns = [*RESULT.fieldNames(), NAME_KEY]
    session = df.sparkSession
    buckets = int(session.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first().data_type)
    keyed = df.withColumn(NAME_KEY, name_key(F.col("name"))).select(columns)
    keyed.repartition(buckets, NAME_KEY).write.mode("append").insertInto(table)
    session.catalog.refreshTable(table)


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier results and those of this session."""
    return old.unionByName(new)
