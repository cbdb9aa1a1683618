"""Attempt resolution, resume, ratings and session statistics."""

import random

import pytest
from pyspark.sql import functions as F

from partforge.operators import attempts as a
from partforge.operators import joins
from partforge.operators.projections import head_n, row_at
from partforge.operators.stats import session_stats

SCHEMA = (
    "row_id BIGINT, name STRING, attempt INT, code STRING, valid BOOLEAN, message STRING"
)


def resolve_rule(tries, limit=5):
    """Tries are (attempt, kind), in any order."""
    for attempt, kind in sorted(tries):
        if attempt <= limit and kind == "valid":
            return "success", attempt, f"code {attempt}", "Valid", attempt > 1
    last, kind = max(t for t in tries if t[0] <= limit)
    if last < limit:
        return "pending", last, None, None, False
    what = {
        "silent": "Failed to generate code after 5 attempts",
        "empty": "Failed to extract code after 5 attempts",
        "invalid": "Failed validation after 5 attempts",
    }
    return "failed", last, None, what[kind], False


def rows_of(item, tries):
    for attempt, kind in tries:
        code = {"silent": None, "empty": "", "invalid": "bad"}.get(kind, f"code {attempt}")
        message = "Valid" if kind == "valid" else "ERROR"
        yield item, f"n{item % 7}", attempt, code, kind == "valid", message


def random_items(n, seed=5):
    rng = random.Random(seed)
    for item in range(n):
        kinds = ["silent", "empty", "invalid", "invalid", "invalid", "valid"]
        tries = [(i + 1, rng.choice(kinds)) for i in range(rng.randint(1, 7))]
        rng.shuffle(tries)
        yield item, tries


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_random_items_follow_the_rule(spark, partitions):
    items = dict(random_items(1500))
    data = [r for item, tries in items.items() for r in rows_of(item, tries)]
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    got = {r.row_id: tuple(r)[2:] for r in a.resolve_attempts(df).collect()}
    assert got == {item: resolve_rule(tries) for item, tries in items.items()}


def test_replayed_attempts_of_one_hot_item(spark):
    """An item with most of the rows, and the same attempt many times, stays one outcome."""
    hot = [r for i in range(4000) for r in rows_of(1, [(1, "silent"), (2, "valid")])]
    rest = [r for i in range(2, 500) for r in rows_of(i, [(1, "valid")])]
    df = spark.createDataFrame(hot + rest, SCHEMA).repartition(8)
    outcomes = a.resolve_attempts(df)
    assert outcomes.count() == 499
    row = outcomes.filter("row_id = 1").first()
    assert (row.status, row.attempt, row.code, row.needed_retry) == ("success", 2, "code 2", True)


def test_results_and_failures(spark, rows):
    items = {1: [(1, "valid")], 2: [(i, "empty") for i in range(1, 6)], 3: [(1, "silent")]}
    data = [r for item, tries in items.items() for r in rows_of(item, tries)]
    outcomes = a.resolve_attempts(spark.createDataFrame(data, SCHEMA))
    assert rows(a.to_results(outcomes)) == [("n1", "code 1", "", "Valid", True)]
    assert rows(a.to_failures(outcomes)) == [("n2", "Failed to extract code after 5 attempts")]
    stats = session_stats(outcomes).first()
    assert (stats.total, stats.success, stats.failed, stats.retries) == (3, 1, 1, 0)
    nothing = session_stats(outcomes.filter("row_id < 0")).first()
    assert (nothing.total, nothing.success_pct, nothing.failed_pct) == (0, 0.0, 0.0)


def test_resume_matches_null_and_keeps_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b"), (5, "c")], "i INT, name STRING")
    done = spark.createDataFrame([("a",), (None,), ("a",)], "name STRING")
    assert rows(joins.not_done(df, done)) == [(2, "b"), (4, "b"), (5, "c")]
    assert joins.not_done(df, done.filter("false")).count() == 5
    assert rows(joins.done_names(done)) == [("a",), (None,)]


def test_limit_comes_before_resume(spark, rows):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "row_id BIGINT, name STRING")
    done = spark.createDataFrame([("n0",), ("n1",)], "name STRING")
    assert rows(joins.not_done(head_n(df, 3), done)) == [(2, "n2")]
    assert head_n(df, None).count() == head_n(df, 0).count() == head_n(df, 99).count() == 6
    assert row_at(df, 5).first().name == "n5"


def test_large_head_is_not_gathered(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("row_id"))
    top = head_n(df, 1234)
    assert top.count() == 1234
    assert top.agg(F.max("row_id")).first()[0] == 1233 * 3


def test_hot_name_is_split_by_adaptive_execution(spark):
    """A name with most rows must not end in one task when the join is shuffled."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        df = spark.range(0, 60_000, 1, 16).select("id", hot.alias("name"))
        done = spark.range(0, 60_000, 2).select(F.col("id").cast("string").alias("name"))
        left = joins.not_done(df, done)
        assert left.count() == 20_000 + 20_000
        left.collect()
        assert "skew=true" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ratings_and_original_code(spark, rows):
    outputs = spark.createDataFrame([("r", 1), ("r", 2)], "run STRING, ordinal INT")
    reviews = spark.createDataFrame(
        [("r", 2, 4, 5, "x"), ("s", 1, 1, 1, "y")],
        "run STRING, ordinal INT, quality INT, resemblance INT, notes STRING",
    )
    rated = joins.with_ratings(outputs, reviews)
    assert rows(rated) == [("r", 1, None, None), ("r", 2, 4, 5)]
    results = spark.createDataFrame([(1, "new"), (2, "new")], "row_id INT, code STRING")
    source = spark.createDataFrame([(1, "old")], "row_id INT, code STRING")
    assert rows(joins.with_original(results, source)) == [(1, "new", "old"), (2, "new", None)]
