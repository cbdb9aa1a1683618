"""Concurrent calls, the ledger of a session, and sessions that stop and go on."""

import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from partforge.operators.attempts import resolve_attempts
from partforge.operators.calls import CallPolicy, answers
from partforge.operators.checks import check_response
from partforge.operators.generation import call_key, generate_with
from partforge.plans import generate as g
from partforge.schemas import ATTEMPT
from partforge.sources.ledger import Ledger
from partforge.sources.results import read_results


def test_calls_overlap_and_answers_come_as_they_finish():
    gate, most, now = threading.Lock(), [0], [0]

    def call(seconds):
        with gate:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(seconds)
        with gate:
            now[0] -= 1
        return seconds

    start = time.monotonic()
    got = [a.response for a in answers([0.6, 0.05, 0.05, 0.05, 0.05, 0.05], call, CallPolicy(in_flight=3))]
    assert most[0] == 3 and got[-1] == 0.6 and sorted(got) == sorted([0.6] + [0.05] * 5)
    assert time.monotonic() - start < 0.85


def test_rows_are_read_only_when_there_is_room():
    read = []

    def rows():
        for i in range(10):
            read.append(i)
            yield i

    made = answers(rows(), lambda x: x, CallPolicy(in_flight=2))
    next(made)
    assert len(read) <= 3
    assert len(list(made)) == 9


def test_a_call_out_of_time_becomes_an_answer_and_is_not_waited_for():
    start = time.monotonic()
    policy = CallPolicy(in_flight=2, seconds=0.2)
    got = list(answers(["slow", "a", "b"], lambda x: time.sleep(3) if x == "slow" else x, policy))
    assert time.monotonic() - start < 1.5
    assert Counter((a.row, a.error is None) for a in got) == {("slow", False): 1, ("a", True): 1, ("b", True): 1}
    assert "0.2 seconds" in next(a.error for a in got if a.error)


@pytest.mark.parametrize("policy", [CallPolicy(1, None, 3, 0.05), CallPolicy(4, None, 3, 0.05), CallPolicy(4, 5, 3, 0.05)])
def test_failed_calls_are_tried_again_after_a_while(policy):
    asked, times = Counter(), {}

    def call(row):
        asked[row] += 1
        times.setdefault(row, []).append(time.monotonic())
        if row == "never" or (row == "third" and asked[row] < 3):
            raise OSError(f"no {row}")
        return row.upper()

    got = {a.row: a for a in answers(["first", "third", "never"], call, policy)}
    assert (got["first"].response, got["first"].tries) == ("FIRST", 1)
    assert (got["third"].response, got["third"].tries, got["third"].error) == ("THIRD", 3, None)
    assert (got["never"].response, got["never"].tries, got["never"].error) == (None, 3, "no never")
    first, second, third = times["never"]
    assert second - first >= 0.05 and third - second >= 0.1


def connect_keyed(folder):
    """A service that computes an answer once a key, and counts in files, as tasks may move."""

    def connect():
        import os

        def call(prompt, key):
            with open(os.path.join(folder, f"{key}.asked"), "a") as f:
                f.write("x")
            path = os.path.join(folder, f"{key}.made")
            if not os.path.exists(path):
                with open(path, "w") as f:
                    f.write("cube(1);")
            return open(path).read() if key >= "8" else None

        return call

    return connect


def test_a_repeated_task_repeats_no_finished_call(spark, tmp_path, rows):
    prompts = spark.createDataFrame([(i, f"n{i}", f"p{i}") for i in range(40)], "row_id BIGINT, name STRING, prompt STRING")
    made = generate_with(prompts, connect_keyed(str(tmp_path)), 2, 3, CallPolicy(in_flight=5, keyed=True))
    first = rows(made, "row_id", "attempt", "response")
    assert rows(made, "row_id", "attempt", "response") == first  # every task runs again
    assert {f.stem for f in tmp_path.glob("*.made")} == {call_key(i, 2, f"p{i}") for i in range(40)}
    assert all(f.read_text() == "xx" for f in tmp_path.glob("*.asked"))  # asked twice, made once
    assert made.where("finished_at is null").count() == 0


def sources(spark, n=30):
    data = [(i, f"thing {i % 25}", f"old {i}") for i in range(n)] + [(n, None, "old none")]
    return spark.createDataFrame(data, "row_id BIGINT, name STRING, code STRING")


def connect_counting(folder):
    """Answers a name's second attempt on, by the ledger's own order of attempts; counts calls in files."""

    def connect():
        import hashlib
        import os

        def call(prompt, key):
            with open(os.path.join(folder, key), "a") as f:
                f.write("x")
            last = int(hashlib.md5(prompt.encode()).hexdigest(), 16) % 4
            return "cube(1);" if last and key >= "6" else None

        return call

    return connect


class Stopped(Exception):
    pass


def run(spark, folder, calls, **more):
    policy = CallPolicy(in_flight=3, keyed=True)
    return g.generate_job(
        spark, sources(spark), f"{folder}/results", connect_counting(calls), work=f"{folder}/work",
        policy=policy, slice_rows=20, max_retries=3, **more,
    )


def saved(spark, folder):
    return Counter(tuple(r) for r in read_results(spark, f"{folder}/results").collect())


COLUMNS = ["row_id", "name", "status", "attempt", "code", "message", "needed_retry"]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A session that ran through."""
    folder = tmp_path_factory.mktemp("whole")
    (folder / "calls").mkdir()
    done = run(spark, folder, str(folder / "calls"))
    return sorted((tuple(r) for r in done.select(COLUMNS).collect()), key=repr), saved(spark, folder)


@pytest.mark.parametrize("where", ["between steps", "before a commit", "before results", "amid results"])
def test_a_stopped_session_goes_on_where_it_was(spark, tmp_path, rows, monkeypatch, whole, where):
    calls = tmp_path / "calls"
    calls.mkdir()
    count = [0]
    if where == "between steps":
        run(spark, tmp_path, str(calls), most_steps=4)
    else:
        owner, name = {"before a commit": (Ledger, "commit")}.get(where, (g, "write_results"))
        real = getattr(owner, name)

        def stop(*args):
            count[0] += 1
            if count[0] == 4:
                if where == "amid results":  # some of the rows were saved
                    real(args[0].limit(1), *args[1:])
                raise Stopped
            return real(*args)

        monkeypatch.setattr(owner, name, stop)
        with pytest.raises(Stopped):
            run(spark, tmp_path, str(calls))
        monkeypatch.setattr(owner, name, real)
    asked = {f.name: len(f.read_text()) for f in calls.iterdir()}
    done = run(spark, tmp_path, str(calls))
    assert rows(done, *COLUMNS) == whole[0]
    assert saved(spark, tmp_path) == whole[1]
    made = {f.name: len(f.read_text()) for f in calls.iterdir()}
    twice = [k for k, n in made.items() if n > 1]
    if where == "before a commit":  # only the step that was not committed is made again
        assert 0 < len(twice) <= 20 and all(asked[k] == 1 for k in twice)
    else:
        assert not twice
    again = run(spark, tmp_path, str(calls))  # nothing is left to do
    assert rows(again, *COLUMNS) == whole[0] and saved(spark, tmp_path) == whole[1]
    assert {f.name: len(f.read_text()) for f in calls.iterdir()} == made


def test_report_of_a_session(spark, tmp_path, rows, whole):
    calls = tmp_path / "calls"
    calls.mkdir()
    run(spark, tmp_path, str(calls))
    report = g.session_report(spark, f"{tmp_path}/work", f"{tmp_path}/results", max_retries=3)
    outcomes, results = whole
    good = [o for o in outcomes if o[2] == "success"]
    assert tuple(report.statistics.first())[:4] == (31, len(good), 31 - len(good), sum(o[6] for o in good))
    assert report.total.first().total_items == sum(results.values())
    lines = report.progress.orderBy("completed").collect()
    assert [x.completed for x in lines] == list(range(1, 32)) and lines[-1].remaining == 0
    assert all(x.elapsed_seconds >= 0 for x in lines) and lines[-1].success == len(good)
    assert len({x.finished_at for x in lines}) > 1


def test_report_of_a_session_that_has_not_begun(spark, tmp_path):
    nothing = g.generate_job(
        spark, sources(spark).limit(0), str(tmp_path / "r"), connect_counting(""), work=str(tmp_path / "w")
    )
    assert nothing.count() == 0
    report = g.session_report(spark, str(tmp_path / "w"), str(tmp_path / "r"))
    assert report.statistics.first().total == 0 and report.total.first().total_items == 0
    assert report.progress.count() == 0


def test_ledger_does_not_count_what_is_not_committed(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.steps() == []
    items = spark.range(10).select(F.col("id").alias("row_id"), F.lit("x").alias("name"))
    ledger.begin(items, 4)
    ledger.begin(items.limit(1), 4)  # a session's items do not change
    assert ledger.slices() == [0, 1, 2] and ledger.items(1).count() == 4 and ledger.items().count() == 10
    made = check_response(spark.createDataFrame([(4, "x", 1, "cube(1);", None, None)], ATTEMPT))
    made.write.parquet(ledger.folder(1, 1))
    assert ledger.attempts(made.schema).count() == 0
    stored, still_open = ledger.write(made, 1, 1)
    assert (stored.count(), still_open) == (1, 0) and ledger.attempts(made.schema).count() == 1


def test_small_slices_take_few_steps_and_go_on_where_they_were(spark, tmp_path, rows):
    source = sources(spark, 200)
    policy = CallPolicy(keyed=True)
    calls = tmp_path / "calls"
    calls.mkdir()

    def job(**more):
        return g.generate_job(
            spark, source, f"{tmp_path}/results", connect_counting(str(calls)), work=f"{tmp_path}/work",
            policy=policy, slice_rows=10, max_retries=2, **more,
        )

    job(most_steps=5)  # amid the third wave
    ledger, schema = Ledger(spark, f"{tmp_path}/work"), check_response(spark.createDataFrame([], ATTEMPT)).schema
    assert [len(wave) for wave, _ in ledger.waves(8)] == [1, 1, 2, 4, 8, 5]
    assert ledger.attempts(schema).select("row_id").distinct().count() == 40
    done = job()
    steps = [s for s in ledger.steps() if s.slice >= 0]
    assert len(steps) == 2 * 6 and max(s.until - s.slice + 1 for s in steps) == 8  # 42 steps for a slice each
    assert {len(f.read_text()) for f in calls.iterdir()} == {1}
    made = ledger.attempts(schema)
    assert made.where("attempt = 1").count() == 201
    assert rows(done, *COLUMNS) == rows(resolve_attempts(made, 2), *COLUMNS)
    good = [(r.name, r.code, f"old {r.row_id}", r.message, True) for r in done.where("status = 'success'").collect()]
    assert good and saved(spark, tmp_path) == Counter(good)
