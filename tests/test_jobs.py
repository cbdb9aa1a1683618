"""Whole jobs, batch and streaming."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from partforge.functions.tokens import WordTokenizer
from partforge.operators.attempts import resolve_attempts
from partforge.operators.checks import check_response
from partforge.operators.stats import session_stats
from partforge.plans.evaluate import evaluate_job, scored
from partforge.plans.generate import generate_job
from partforge.plans.prepare import MASKED, SHIFTED, batched_epochs, packed_blocks, prepare_job
from partforge.sources.results import read_results
from partforge.streaming import outcomes as s


def connect_good():
    return lambda prompt: "cube(1);" if "a cat" not in prompt else "nothing here"


def connect_flaky(folder):
    """Fails each prompt until it was asked twice; remembers in files, as tasks may move."""

    def connect():
        import hashlib
        import os

        def call(prompt):
            key = os.path.join(folder, hashlib.md5(prompt.encode()).hexdigest())
            asked = os.path.exists(key)
            with open(key, "a") as f:
                f.write("x")
            if not asked:
                raise TimeoutError("slow")
            return "```openscad\n// c\ncube(2);\n```"

        return call

    return connect


def test_generate_and_resume(spark, tmp_path, rows):
    source = spark.createDataFrame(
        [(0, "a dog"), (1, "a cat"), (2, "a dog"), (3, None), (4, "late")],
        "row_id BIGINT, name STRING",
    )
    results = str(tmp_path / "results")
    done = generate_job(spark, source, results, connect_good, samples=3, max_retries=2)
    assert rows(done, "row_id", "status", "message") == [
        (0, "success", "Valid"),
        (1, "failed", "Failed validation after 2 attempts"),
        (2, "success", "Valid"),
    ]
    saved = read_results(spark, results)
    assert rows(saved) == [("a dog", "cube(1);", "", "Valid", True)] * 2

    calls = tmp_path / "calls"
    calls.mkdir()
    again = generate_job(spark, source.filter("name is not null"), results, connect_flaky(str(calls)))
    assert rows(again, "row_id", "status", "attempt", "needed_retry", "code") == [
        (1, "success", 2, True, "// c\ncube(2);"),
        (4, "success", 2, True, "// c\ncube(2);"),
    ]
    assert sorted(len(f.read_text()) for f in calls.iterdir()) == [2, 2]
    assert read_results(spark, results).count() == 4
    assert tuple(session_stats(again).first())[:4] == (2, 2, 0, 2)
    last = generate_job(spark, source.filter("name is not null"), results, connect_good)
    assert last.count() == 0


def test_prepare(spark, tmp_path):
    data = [(i, f"part {i}", "cube ( 1 ) ; " * (i % 5)) for i in range(50)]
    source = spark.createDataFrame(data, "row_id BIGINT, name STRING, code STRING")
    tokens = WordTokenizer(F.length)
    made = prepare_job(spark, source, str(tmp_path), tokens, token_limit=20)
    stored = spark.read.parquet(made.examples)
    assert {"text", "input_tokens", "target_tokens", "weights", "input_ids", "labels"} <= set(
        stored.columns
    )
    stats = made.stats.first()
    assert stats.examples == 50 and stats.max_tokens == made.longest.first().n_tokens
    assert made.longest.first().row_id == 4
    blocks = packed_blocks(spark, made, 64)
    total = stored.agg(F.sum(F.size("input_ids"))).first()[0]
    assert blocks.agg(F.sum(F.size("input_ids"))).first()[0] == total
    assert blocks.filter(F.size("labels") != F.size("input_ids")).isEmpty()
    batches = batched_epochs(spark, made, 2, 8, 1)
    assert batches.count() == 100
    assert batches.groupBy("epoch", "batch").count().filter("count > 8").isEmpty()
    assert batches.filter(F.size("weights") != F.size("target_tokens")).isEmpty()
    only = prepare_job(spark, source, str(tmp_path / "m"), tokens, shapes=(MASKED,))
    assert "weights" not in spark.read.parquet(only.examples).columns
    only = prepare_job(spark, source, str(tmp_path / "s"), tokens, shapes=(SHIFTED,))
    assert "labels" not in spark.read.parquet(only.examples).columns


def test_evaluate(spark, rows):
    at = datetime(2025, 11, 10, 16, 47, 21)
    header = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    responses = spark.createDataFrame(
        [("r", 10, "hey assistant, create me a red cat", f"x{header}cube(1);<|eot_id|>", at),
         ("r", 11, "hey assistant, create me a car", "assistant\ncube(2);", at)],
        "run STRING, row_id BIGINT, prompt STRING, response STRING, generated_at TIMESTAMP",
    )
    log = spark.createDataFrame(
        [("r", 10, 0, True, "", "01_red_cat.png")],
        "run STRING, row_id BIGINT, exit_code INT, image_exists BOOLEAN, stderr STRING, image STRING",
    )
    done = evaluate_job(responses, log, F.lit(at))
    assert rows(done.artifacts, "ordinal", "file_name", "code") == [
        (1, "01_red_cat.scad", "cube(1);"),
        (2, "02_car.scad", "cube(2);"),
    ]
    assert rows(done.rendered, "ordinal", "rendered", "error") == [
        (1, True, None),
        (2, False, "Unknown error"),
    ]
    assert rows(done.rates) == [("r", 2, 1, 50.0)]
    assert [x[0] for x in rows(done.report, "section")] == [0, 1, 2, (1 << 63) - 1]
    reviews = spark.createDataFrame(
        [("r", 1, 4, 5), ("r", 2, 2, 2)], "run STRING, ordinal INT, quality INT, resemblance INT"
    )
    assert rows(scored(done.artifacts, reviews)) == [("r", 3.0, 3.5, 70.0)]


ATTEMPT_SCHEMA = "row_id BIGINT, name STRING, attempt INT, response STRING"


def attempt_rows(seed, n):
    texts = [None, "", "prose", "cube(1);", "cube(1;", "```\nsphere(2);\n```"]
    return [(i % 40, f"n{i % 40}", i // 40 + 1, texts[(i * 7 + seed) % len(texts)]) for i in range(n)]


def run_streams(spark, folder, schema):
    attempts = s.read_attempts(spark, str(folder / "in"), schema, "*.parquet", per_batch=1)
    out, ckpt = str(folder / "checked"), str(folder / "c1")
    s.stream_outcomes(attempts, out, ckpt).awaitTermination()
    checked = check_response(
        s.read_attempts(spark, str(folder / "in"), schema, "*.parquet", per_batch=1)
    )
    resolved, ckpt = str(folder / "resolved"), str(folder / "c2")
    s.stream_resolve(checked, resolved, ckpt).awaitTermination()
    stored = spark.read.parquet(out)
    return stored, s.resolved_items(spark, resolved, stored)


def test_streams_equal_batch_and_restart_adds_nothing(spark, tmp_path, rows):
    data = attempt_rows(3, 240)
    folder = str(tmp_path / "in")
    for i in range(0, 160, 40):
        part = spark.createDataFrame(data[i : i + 40], ATTEMPT_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
    schema = part.schema
    for upto in (160, 160, 240):
        if upto > 160:
            late = spark.createDataFrame(data[160:], ATTEMPT_SCHEMA)
            late.repartition(2).write.mode("append").parquet(folder)
        checked, resolved = run_streams(spark, tmp_path, schema)
        batch = check_response(spark.createDataFrame(data[:upto], ATTEMPT_SCHEMA))
        names = ["row_id", "attempt", "code", "valid", "message"]
        assert rows(checked, *names) == rows(batch, *names)
        want = resolve_attempts(batch)
        assert rows(resolved, *want.columns) == rows(want)


def test_a_log_without_batches_is_empty(spark, tmp_path):
    with pytest.raises(AnalysisException):
        s.newest(spark, str(tmp_path / "none"), ["session"])
    schema = spark.range(0).withColumnRenamed("id", "session").schema
    none = s.newest(spark, str(tmp_path / "none"), ["session"], schema)
    assert none.count() == 0 and none.columns == ["session"]


def test_a_stream_that_runs_on(spark, tmp_path, rows):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = spark.createDataFrame(attempt_rows(3, 40), ATTEMPT_SCHEMA)
    part.write.mode("append").parquet(folder)
    attempts = s.read_attempts(spark, folder, part.schema, "*.parquet")
    running = s.stream_outcomes(attempts, out, str(tmp_path / "c"), every="1 second")
    try:
        running.processAllAvailable()
        late = spark.createDataFrame(attempt_rows(3, 60)[40:], ATTEMPT_SCHEMA)
        late.write.mode("append").parquet(folder)
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert spark.read.parquet(out).count() == 60


def test_streamed_statistics(spark, tmp_path, rows):
    schema = "session STRING, status STRING, needed_retry BOOLEAN"
    folder = str(tmp_path / "in")
    for part in ([("a", "success", True), ("b", "failed", False)], [("a", "failed", None)]):
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = s.read_attempts(spark, folder, df.schema, "*.parquet", per_batch=1)
    out = str(tmp_path / "out")
    s.stream_stats(stream, out, str(tmp_path / "ckpt"), ["session"]).awaitTermination()
    newest = s.newest(spark, out, ["session"])
    assert rows(newest, "session", "total", "success", "failed", "retries") == [
        ("a", 2, 1, 1, 1),
        ("b", 1, 0, 1, 0),
    ]


def test_a_tokenizer_in_python_sees_a_row_once(spark, tmp_path, rows):
    from partforge.functions.chat import LLAMA
    from partforge.functions.tokens import SuppliedTokenizer
    from partforge.operators.tokenized import encode_at_once

    def load():
        return lambda text: [len(word) for word in text.split()]

    data = [(0, "a", "cube ( 1 ) ;"), (1, None, None), (2, "", ""), (3, "b", " \n x ")]
    source = spark.createDataFrame(data, "row_id BIGINT, name STRING, code STRING")
    once = prepare_job(spark, source, str(tmp_path / "once"), SuppliedTokenizer(load))
    native = prepare_job(spark, source, str(tmp_path / "native"), WordTokenizer(F.length))
    columns = spark.read.parquet(native.examples).columns
    assert rows(spark.read.parquet(once.examples), *columns) == rows(spark.read.parquet(native.examples), *columns)
    pairs = source.selectExpr("row_id", "name AS input", "code AS output")
    plan = encode_at_once(pairs, SuppliedTokenizer(load), LLAMA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sources_are_prepared_together(spark, tmp_path):
    from partforge.plans.prepare import prepare_sources

    for i, n in enumerate((4, 3)):
        spark.range(n).selectExpr(f"'thing {i}' AS name", "repeat('x ', id) AS code").write.parquet(str(tmp_path / f"s{i}"))
    paths = {"s0": str(tmp_path / "s0"), "gone": str(tmp_path / "gone"), "s1": str(tmp_path / "s1")}
    made, found = prepare_sources(spark, paths, str(tmp_path / "out"), ["name", "code"], tokenizer=WordTokenizer())
    stored = spark.read.parquet(made.examples)
    assert sorted(r.row_id for r in stored.collect()) == list(range(7))
    assert [r.source for r in found.rejects.collect()] == ["gone"]
