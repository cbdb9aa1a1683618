"""Streaming queries over the events file; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.catalog.generation import OUTCOME_COLUMNS, _checked, outcomes_sql
from partforge.catalog.registry import query, table
from partforge.session import shared_folder
from partforge.streaming import outcomes as s
from partforge.streaming.expiry import expiring_items, stream_resolve_expiring
from partforge.streaming.windows import stream_window_stats, window_stats


def _events(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return s.read_attempts(spark, sf_dir, schema, "events.parquet")


def _folders(spark, name: str) -> tuple[str, str]:
    return shared_folder(spark, name), shared_folder(spark, f"{name}-checkpoint")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
          WHEN event_type = 'view' THEN props ELSE 'cube(' || event_id || ');' END AS code,
        event_type IN ('purchase', 'signup', 'click') AS valid,
        CASE event_type WHEN 'error' THEN 'Empty code'
          WHEN 'view' THEN 'No OpenSCAD keywords found' ELSE 'Valid' END AS message FROM events"""
)
def streamed_outcomes(spark, sf_dir):
    kind = F.col("event_type")
    response = F.when(kind == "view", F.col("props")).when(
        kind != "error", F.concat(F.lit("```\ncube("), "event_id", F.lit(");\n```"))
    )
    out, checkpoint = _folders(spark, "outcomes")
    answers = _events(spark, sf_dir).withColumn("response", response)
    s.stream_outcomes(answers, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("event_id", "code", "valid", "message")


def _numbered(events: DataFrame) -> DataFrame:
    """Events as attempts of a user's day, numbered so that some come again and some before their turn."""
    return _checked(
        events.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "attempt": F.col("event_id") % 7 + 1})
    )


@query(f"WITH {outcomes_sql('1 + event_id % 7')} SELECT {OUTCOME_COLUMNS} FROM o")
def streamed_resolution(spark, sf_dir):
    out, checkpoint = _folders(spark, "resolved")
    keys = ["user_id", "day"]
    s.stream_resolve(_numbered(_events(spark, sf_dir)), out, checkpoint, keys=keys).awaitTermination()
    return s.resolved_items(spark, out, _numbered(table(spark, sf_dir, "events")), keys=keys)


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS session, count(*) AS total,
        count(*) FILTER (event_type <> 'error') AS success,
        count(*) FILTER (event_type = 'error') AS failed,
        count(*) FILTER (event_type = 'click') AS retries,
        count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE * 100 AS success_pct,
        count(*) FILTER (event_type = 'error') / count(*)::DOUBLE * 100 AS failed_pct
       FROM events GROUP BY 1"""
)
def streamed_statistics(spark, sf_dir):
    kind = F.col("event_type")
    done = _events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd").alias("session"),
        F.when(kind == "error", "failed").otherwise("success").alias("status"),
        (kind == "click").alias("needed_retry"),
    )
    out, checkpoint = _folders(spark, "statistics")
    s.stream_stats(done, out, checkpoint, ["session"]).awaitTermination()
    return s.newest(spark, out, ["session"])


# --- streams over several micro-batches -----------------------------------------------------


def _one_by_one(spark, parts: list[DataFrame], folder: str) -> DataFrame:
    """The parts as files that a stream takes one a micro-batch, in this order."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return s.read_attempts(spark, folder, parts[0].schema, "*.parquet", per_batch=1)


def _timed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ends(events: DataFrame) -> list[DataFrame]:
    """Two late events of nobody: what is open before them is told after the second."""
    one = events.limit(1).withColumns(
        {"user_id": F.lit(-1).cast(events.schema["user_id"].dataType), "event_type": F.lit("error")}
    )
    return [one.withColumn("ts", F.lit(f"2200-01-0{i} 00:00:00").cast("timestamp")) for i in (1, 2)]


# Fixed by the queries: when a row comes, by the time it is from; every tenth comes two batches late.
_COMES_SQL = "least(3, dayofmonth(ts) // 8) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END"


def _as_they_come(events: DataFrame) -> list[DataFrame]:
    late = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    comes = F.least(F.lit(3), F.floor(F.dayofmonth("ts") / 8)) + late
    return [events.where(comes == i) for i in range(6)]


@query(
    f"""WITH {outcomes_sql('1 + event_id % 7')}
        SELECT user_id, day, CASE status WHEN 'pending' THEN 'expired' ELSE status END AS status,
          attempt, code, message, needed_retry FROM o"""
)
def streamed_expiry(spark, sf_dir):
    """Items decided by a stream that forgets them; some of their attempts come after that."""
    events = _timed_events(spark, sf_dir)
    folder, (out, checkpoint) = shared_folder(spark, "parts"), _folders(spark, "expiring")
    stream = _numbered(_one_by_one(spark, [*_as_they_come(events), *_ends(events)], folder))
    keys = ["user_id", "day"]
    stream_resolve_expiring(stream, out, checkpoint, 2 * 86400, "18 days", keys=keys).awaitTermination()
    return expiring_items(spark, out, _numbered(events), keys=keys).where("user_id >= 0")


@query(f"WITH {outcomes_sql('1 + event_id % 7')} SELECT {OUTCOME_COLUMNS} FROM o")
def streamed_restart(spark, sf_dir):
    """A stream that stops and starts again, its log merged in between, with items open across the stop."""
    events = _timed_events(spark, sf_dir)
    parts = [events.where(F.col("event_id") % 6 == i) for i in range(6)]
    folder, (out, checkpoint) = shared_folder(spark, "parts"), _folders(spark, "restarted")
    keys = ["user_id", "day"]
    for some in (parts[:3], parts[3:]):
        stream = _numbered(_one_by_one(spark, some, folder))
        s.stream_resolve(stream, out, checkpoint, keys=keys, compact_every=2).awaitTermination()
    return s.resolved_items(spark, out, _numbered(events), keys=keys)


@query(
    f"""WITH e AS (SELECT *, {_COMES_SQL} AS comes, date_trunc('day', ts) AS w FROM events),
        m AS (SELECT comes, max(ts) AS most FROM e GROUP BY comes),
        b AS (SELECT a.comes, max(m.most) - INTERVAL 3 DAY AS mark FROM (SELECT DISTINCT comes FROM e) a
              LEFT JOIN m ON m.comes < a.comes - 1 GROUP BY a.comes)
        SELECT 's' || user_id % 3 AS session, w AS window_start,
          coalesce(w + INTERVAL 1 DAY <= date_trunc('milliseconds', mark), false) AS late, count(*) AS total,
          count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed,
          count(*) FILTER (event_type = 'click') AS retries,
          count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE * 100 AS success_pct,
          count(*) FILTER (event_type = 'error') / count(*)::DOUBLE * 100 AS failed_pct
        FROM e JOIN b USING (comes) GROUP BY 1, 2, 3"""
)
def streamed_late_statistics(spark, sf_dir):
    """Days of sessions, told once; rows that came when their day had been told are counted apart."""
    events = _timed_events(spark, sf_dir)
    folder, (out, checkpoint) = shared_folder(spark, "parts"), _folders(spark, "windows")
    kind = F.col("event_type")
    done = _one_by_one(spark, [*_as_they_come(events), *_ends(events)], folder).select(
        F.when(F.col("user_id") >= 0, F.concat(F.lit("s"), F.col("user_id") % 3)).alias("session"),
        "ts",
        F.when(kind == "error", "failed").otherwise("success").alias("status"),
        (kind == "click").alias("needed_retry"),
    )
    stream_window_stats(done, out, checkpoint, ["session"], "ts", "1 day", "3 days").awaitTermination()
    return window_stats(spark, out, ["session"]).where("session is not null").drop("window_end")
