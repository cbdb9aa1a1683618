"""A content-addressed web archive.

An archive is two tables. `payloads` holds the bytes of every different payload once,
under its SHA-256; `headers` holds the exact header block of every record and the
address of its payload. Records are put together again by a join on the address, and
what is read is verified: a payload whose digest is not its address stops the job.

Of records with equal payloads of at least `least_bytes`, the one with the smallest
key is a response and the others are revisits that name it; shorter payloads are
responses each time. A null payload is empty. A null key is larger than any other and
is written as `null`; of repeated rows with the same key and payload, the first by URL
is the response. URLs are percent-encoded where a line break would end the header.
An empty table makes an empty archive. Other columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_URN = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 40 bits at a time through numbers of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [
        F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), digits, BASE32)


def header(record_type: Column, key: Column, url: Column, digest: Column, refers_to: Column,
           length: Column, date: str) -> Column:
    """The header block of a record, up to and with the blank line."""
    urn = lambda k: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(k.cast("string"), F.lit("null")), F.lit(">"))
    target = F.coalesce(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    revisit = record_type == "revisit"
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), record_type),
        F.concat(F.lit("WARC-Record-ID: "), urn(key)),
        F.lit(f"WARC-Date: {date}"),
        F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), target)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(refers_to))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(length).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).cast("binary")


def write_archive(records: DataFrame, folder: str, least_bytes: int = 0,
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive (key, url, payload) under `folder`.

    Keys and digests decide everything, so the payloads move once: those of the
    owners, by (digest, key), which no group of copies makes uneven.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    rows = records.select("key", "url", payload.alias("payload"))
    # a name without nulls, so that joining and grouping by it share one shuffle
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "name": name})
    marks = rows.select("key", "name", "url", "address", F.octet_length("payload").cast("long").alias("length"),
                        base32_sha1(F.col("payload")).alias("digest"))
    owners = marks.groupBy("address").agg(F.min("key").alias("owner"))
    same = W.partitionBy("address", "name").orderBy("url")
    placed = (
        marks.withColumn("repeat", F.row_number().over(same))
        .join(owners, "address")
        .withColumn("first", (F.col("length") < least_bytes)
                    | (F.col("key").eqNullSafe(F.col("owner")) & (F.col("repeat") == 1)))
    )
    record_type = F.when(F.col("first"), "response").otherwise("revisit")
    block = header(record_type, F.col("key"), F.col("url"), F.col("digest"), F.col("owner"), F.col("length"), date)
    placed.select(block.alias("header"), "address").write.parquet(f"{folder}/headers")

    mine = owners.select("address", F.coalesce(F.col("owner").cast("string"), F.lit("null")).alias("name"))
    once = (
        rows.join(mine, ["address", "name"], "left_semi")
        .groupBy("address", "name")
        .agg(F.first("payload").alias("payload"))
    )
    once.select("address", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")


def field(block: Column, name: str) -> Column:
    """A header field's value, null where it is missing."""
    value = F.regexp_extract(block, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(block, F.lit(f"{CRLF}{name}: ")), value)


def record_key(value: Column) -> Column:
    """The key in a record's name, null for `null`."""
    key = F.regexp_extract(value, rf"<{RECORD_URN}(-?\d+|null)>", 1)
    return F.when(key != "null", key).cast("long")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: its header fields, its full payload, and `record`, its exact bytes.

    A revisit's own bytes hold no payload; `payload` is that of the record it names.
    """
    headers = spark.read.schema("header binary, address string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address")))
    sound = F.sha2("payload", 256) == F.col("address")
    payloads = payloads.select(
        "address", "payload",
        F.when(sound, F.octet_length("payload").cast("long")).otherwise(wrong.cast("long")).alias("payload_bytes"),
        F.when(sound, base32_sha1(F.col("payload"))).otherwise(wrong.cast("string")).alias("payload_digest"),
    )
    block = F.col("header").cast("string")
    lost = F.raise_error(F.concat(F.lit("payload is lost: "), F.coalesce("address", F.lit("no address"))))
    read = headers.join(payloads, "address", "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", lost.cast("long"))
    )
    record_type = field(block, "WARC-Type")
    empty = F.lit("").cast("binary")
    return read.select(
        record_key(field(block, "WARC-Record-ID")).alias("key"),
        field(block, "WARC-Target-URI").alias("url"),
        record_type.alias("record_type"),
        record_key(field(block, "WARC-Refers-To")).alias("refers_to"),
        "payload_bytes", "payload_digest", "payload", "header",
        F.concat("header", F.when(record_type == "revisit", empty).otherwise(F.col("payload")),
                 F.lit(CRLF * 2).cast("binary")).alias("record"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """The records of `read_archive` as plain .warc part files, each record ended by two line breaks."""
    whole = F.expr("substring(record, 1, octet_length(record) - 4)")
    records.select(whole.cast("string").alias("value")).write.option("lineSep", CRLF * 2).text(path)
