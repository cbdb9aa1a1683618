"""Running totals, numbering, shuffles and progress against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partforge.operators import ordering as o
from partforge.operators.progress import progress
from partforge.operators.stats import steps_per_epoch


def brute_totals(data):
    """data: (group, id, value) -> {(group, id): running sum}"""
    sums, out = {}, {}
    for group, i, value in sorted(data, key=lambda r: (str(r[0]), r[1])):
        sums[group] = sums.get(group, 0) + value
        out[(group, i)] = sums[group]
    return out


@pytest.mark.parametrize("bits", [(), (3,), (6, 2), (8, 5, 1)])
@pytest.mark.parametrize("partitions", [1, 8])
def test_running_totals(spark, bits, partitions):
    rng = random.Random(1)
    groups = ["hot"] * 6 + ["a", None, "b"]
    ids = rng.sample(range(-2000, 4000), 1500)
    data = [(rng.choice(groups), i, rng.randint(0, 9)) for i in ids]
    df = spark.createDataFrame(data, "g STRING, i BIGINT, v BIGINT").repartition(partitions)
    got = o.running_totals(df, ["g"], o.id_cells("i", bits), [F.col("i")], {"s": F.col("v")})
    assert got.columns == ["g", "i", "v", "s"]
    assert {(r.g, r.i): r.s for r in got.collect()} == brute_totals(data)


def test_numbering_splits_a_run_that_holds_everything(spark):
    df = spark.range(300_000).select(F.lit("run").alias("run"), (F.col("id") * 7).alias("row_id"))
    numbered = o.number_outputs(df)
    assert numbered.filter(F.col("ordinal") != F.col("row_id") / 7 + 1).isEmpty()
    largest = numbered.groupBy(*o.id_cells("row_id", o.RUN_BITS)).count().agg(F.max("count"))
    assert largest.first()[0] <= 2 ** o.RUN_BITS[-1] / 7 + 1
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run" in plan and "_cell0" in plan.split("Exchange")[1]


def test_shuffle_is_a_seeded_permutation_per_epoch(spark):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    shuffled = o.assign_batches(o.shuffle_epochs(o.epochs(df, 3), 3407), 32)
    orders = {}
    for r in shuffled.orderBy("epoch", "rank").collect():
        orders.setdefault(r.epoch, []).append((r.row_id, r["rank"], r.batch))
    assert set(orders) == {1, 2, 3}
    for rows in orders.values():
        assert sorted(r[0] for r in rows) == list(range(300))
        assert [r[1] for r in rows] == list(range(1, 301))
        assert [r[2] for r in rows] == [i // 32 for i in range(300)]
    assert len({tuple(r[0] for r in rows) for rows in orders.values()}) == 3
    again = o.shuffle_epochs(o.epochs(df.repartition(7), 3), 3407)
    assert again.join(shuffled, ["row_id", "epoch", "rank"]).count() == 900
    assert steps_per_epoch(df, 32).first().steps == 10


def test_epochs_use_no_join(spark):
    plan = o.epochs(spark.range(5), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_checkpoint_steps(spark, rows):
    steps = spark.range(1, 31).withColumnRenamed("id", "step")
    assert rows(o.checkpoint_steps(steps, 10)) == [(10,), (20,), (30,)]


@pytest.mark.parametrize("full_hour", [1 << 20, 20, 1])
def test_progress(spark, full_hour):
    rng = random.Random(2)
    start = datetime(2025, 11, 10, 16, 0, 0)
    data = []
    for i in range(600):
        # Many completions share an instant.
        end = start + timedelta(seconds=rng.choice([1, 1, 1, 59, 3600, 7201.25]))
        session = "hot" if i % 3 else "b"
        status = rng.choice(["success", "failed"])
        data.append((session, i, start, end, 1000, status, rng.random() < 0.5))
    df = spark.createDataFrame(
        data,
        "session STRING, row_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, "
        "total BIGINT, status STRING, needed_retry BOOLEAN",
    )
    want, counts = {}, {}
    for session, i, _, end, total, status, retry in sorted(data, key=lambda r: (r[3], r[1])):
        n, good, bad, again = counts.get(session, (0, 0, 0, 0))
        n, good, bad = n + 1, good + (status == "success"), bad + (status == "failed")
        again += retry
        counts[session] = (n, good, bad, again)
        spent = (end - start).total_seconds()
        eta = int(spent / n * (total - n))
        want[i] = (n, good, bad, again, int(spent), spent / n, total - n, eta)
    names = ["completed", "success", "failed", "retries", "elapsed_seconds", "mean_seconds"]
    names += ["remaining", "eta_seconds"]
    got = {r.row_id: tuple(r[n] for n in names) for r in progress(df, full_hour).collect()}
    assert got == want


def test_progress_moves_rows_once_and_cuts_a_full_instant(spark):
    """A session all of whose completions are of one instant; the plan of one without a full hour."""
    at = F.lit("2024-01-01 10:00:00").cast("timestamp")
    df = spark.range(3000).select(
        F.lit("s").alias("session"), (F.col("id") * 4096).alias("row_id"), at.alias("started_at"), at.alias("finished_at"),
        F.lit(3000).alias("total"), F.lit("success").alias("status"), F.lit(False).alias("needed_retry"),
    )
    for full_hour in (1 << 20, 100):
        done = progress(df, full_hour)
        assert [r.completed for r in done.orderBy("row_id").select("completed").collect()] == list(range(1, 3001))
    assert progress(df).select("completed").distinct().count() == 3000
    few = progress(df)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ShuffleQueryStage") <= 6
