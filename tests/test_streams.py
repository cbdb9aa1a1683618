"""Streams that let go of state and merge their logs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from partforge.operators.attempts import attempt_numbers, merged_numbers, resolve_attempts
from partforge.sources.folders import names_in
from partforge.streaming import outcomes as s
from partforge.streaming.expiry import expiring_items, stream_resolve_expiring
from partforge.streaming.versions import VersionLog
from partforge.streaming.windows import stream_window_stats, window_stats

CHECKED = "row_id BIGINT, name STRING, attempt INT, code STRING, valid BOOLEAN, message STRING, ts TIMESTAMP"


def batches(spark, folder, parts):
    """Parts as files that a stream takes one a micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return s.read_attempts(spark, folder, parts[0].schema, "*.parquet", per_batch=1)


def day(n):
    return F.timestamp_seconds(F.lit(n * 86400))


def attempts_of_a_day(spark, d, items=40):
    """Each item of a day gets attempts on that day; half of the items win at the second, a quarter gives up."""
    rows = []
    for i in range(items):
        for attempt in range(1, (3, 6, 3, 2)[i % 4]):
            good = i % 4 in (0, 2) and attempt == 2
            rows.append((d * 100 + i, None if i == 3 else f"n{i}", attempt, "cube(1);" if good else "", good, "Valid" if good else "ERROR"))
    made = spark.createDataFrame(rows, CHECKED.rsplit(",", 1)[0])
    return made.withColumn("ts", F.timestamp_seconds(F.lit(d * 86400 + 60) + F.col("attempt")))


def test_state_holds_only_items_that_are_open(spark, tmp_path, rows):
    parts = [attempts_of_a_day(spark, d) for d in range(6)]
    late = parts[4].where("attempt = 2 and valid").withColumn("attempt", F.lit(1))  # of items decided before
    late = late.withColumn("code", F.lit("cube(0);"))
    parts = [*parts[:5], late.unionByName(parts[5]), attempts_of_a_day(spark, 60, 1), attempts_of_a_day(spark, 61, 1)]
    stream = batches(spark, str(tmp_path / "in"), parts)
    out = str(tmp_path / "out")
    query = stream_resolve_expiring(stream, out, str(tmp_path / "c"), 86400, "1 day", compact_every=3)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 40  # of 240 items; of a day a quarter stays open, for two days
    given = parts[0]
    for part in parts[1:]:
        given = given.unionByName(part)
    got = expiring_items(spark, out, given).where("row_id < 6000")
    want = resolve_attempts(given.where("row_id < 6000"))
    want = want.withColumn("status", F.when(F.col("status") == "pending", "expired").otherwise(F.col("status")))
    assert rows(got, *want.columns) == rows(want)
    counts = Counter(r[2] for r in rows(got))
    assert counts["success"] == 120 and counts["failed"] == 60 and counts["expired"] == 60


def test_open_items_are_kept_by_groups(spark, tmp_path, rows):
    """A state and a call of Python for a group of items, whose keys stay as they are."""
    named = {"at": F.col("ts"), "raw": F.col("name").cast("binary"), "wide": F.col("row_id") + (1 << 60) + 1}
    named["wide"] = F.when(F.col("row_id") % 7 > 0, named["wide"])
    named["two"] = F.when(F.col("row_id") % 5 > 0, F.struct("name", F.lit(0.1).alias("x")))
    keys = list(named)
    whole = attempts_of_a_day(spark, 1, 90).withColumn("ts", F.timestamp_micros(F.lit(86400_000_007))).withColumns(named)
    ends = [attempts_of_a_day(spark, d, 1).withColumns(named) for d in (60, 61)]
    stream = batches(spark, str(tmp_path / "in"), [whole.where("attempt = 1"), whole.where("attempt > 1"), *ends])
    out = str(tmp_path / "out")
    query = stream_resolve_expiring(stream, out, str(tmp_path / "c"), 86400, "1 day", keys=keys, groups=3)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 3
    got = expiring_items(spark, out, whole, keys=keys).where("at < '1970-02-01'")
    want = resolve_attempts(whole, keys=keys)
    want = want.withColumn("status", F.when(F.col("status") == "pending", "expired").otherwise(F.col("status")))
    assert rows(got, *want.columns) == rows(want) and want.count() > 80
    assert {r[0] for r in want.groupBy("status").count().collect()} == {"success", "failed", "expired"}


def test_numbers_of_parts_give_those_of_all(spark, rows):
    given = attempts_of_a_day(spark, 1)
    keys = ["row_id", "name"]
    parts = [attempt_numbers(given.where(F.col("attempt") % 2 == i)) for i in (0, 1)]
    assert rows(merged_numbers(parts[0].unionByName(parts[1]), keys)) == rows(attempt_numbers(given))


def test_winners_are_decided_without_text(spark):
    given = attempts_of_a_day(spark, 1)
    plan = resolve_attempts(given)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    numbers = attempt_numbers(given)
    schema = numbers.schema.simpleString()
    assert "string" not in schema.replace("name:string", "")


def test_restart_with_a_merged_log(spark, tmp_path, rows):
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "c"))
    keys, days = ["row_id", "name"], [attempts_of_a_day(spark, d, 12) for d in range(9)]
    # attempts of a day come in two batches, so that items are open when the stream stops
    halves = [day_.where(F.col("attempt") % 2 == i) for day_ in days for i in (1, 0)]
    for some in (halves[:7], halves[7:]):
        stream = batches(spark, folder, some)
        s.stream_resolve(stream, out, ckpt, compact_every=4).awaitTermination()
    log = VersionLog(spark, out, keys)
    assert log.complete() == [11, 15]  # the ones before are gone
    kept = sorted(int(n.split("=")[1]) for n in names_in(spark, out) if n.startswith("batch_id="))
    assert kept == list(range(12, 18))  # what the last snapshot replaced goes with the next one
    given = spark.read.parquet(folder)
    want = resolve_attempts(given)
    assert rows(s.resolved_items(spark, out, given), *want.columns) == rows(want)
    log.compact(17)
    assert rows(s.resolved_items(spark, out, given), *want.columns) == rows(want)


def test_an_unfinished_snapshot_does_not_count(spark, tmp_path, rows):
    log = VersionLog(spark, str(tmp_path / "log"), ["k"])
    for i in range(3):
        log.save(spark.createDataFrame([(1, i), (i + 5, i)], "k BIGINT, v BIGINT"), i)
    want = rows(log.newest())
    assert want == [(1, 2), (5, 0), (6, 1), (7, 2)]
    log.compact(1)
    (tmp_path / "log-snapshots" / "upto=2").mkdir()
    (tmp_path / "log-snapshots" / "upto=2" / "part-0.parquet").write_bytes(b"half")
    assert log.complete() == [1] and rows(log.newest()) == want
    log.compact(2)  # made again
    assert log.complete() == [1, 2] and rows(log.newest()) == want
    log.save(spark.createDataFrame([(1, 0), (5, 0)], "k BIGINT, v BIGINT"), 0)  # a batch repeated after it was merged
    assert rows(log.newest()) == want


@pytest.mark.parametrize("compact_every", [2, 50])
def test_late_rows_are_told_apart(spark, tmp_path, rows, compact_every):
    def part(*items):
        made = [(session, d, status, status == "failed") for session, d, status in items]
        return spark.createDataFrame(made, "session STRING, d INT, status STRING, needed_retry BOOLEAN").select(
            "session", F.timestamp_seconds(F.col("d") * 86400 + 5).alias("ts"), "status", "needed_retry"
        )

    parts = [
        part(("a", 1, "success"), ("a", 1, "failed"), (None, 2, "success"), ("a", None, "success")),
        part(("a", 5, "success")),
        part(("a", 5, "failed"), ("a", 1, "success")),  # in time: the window is told with this batch
        part(("a", 1, "failed"), ("b", 1, "success"), ("a", 6, "success")),  # late
        part(("a", 40, "success")),
        part(("a", 41, "success")),
    ]
    stream = batches(spark, str(tmp_path / "in"), parts)
    out = str(tmp_path / "out")
    query = stream_window_stats(stream, out, str(tmp_path / "c"), ["session"], "ts", "1 day", "1 day", compact_every=compact_every)
    query.awaitTermination()
    got = window_stats(spark, out, ["session"]).withColumn("d", F.dayofyear("window_start") - 1).where("d < 30")
    assert rows(got, "session", "d", "late", "total", "success", "failed", "retries") == sorted(
        [("a", 1, False, 3, 2, 1, 1), (None, 2, False, 1, 1, 0, 0), ("a", 5, False, 2, 1, 1, 1), ("a", 6, False, 1, 1, 0, 0),
         ("a", 1, True, 1, 0, 1, 1), ("b", 1, True, 1, 1, 0, 0)], key=repr)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 2
