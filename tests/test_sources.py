"""Files: datasets, results, artifacts and reviews."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from partforge.functions import prompts as p
from partforge.operators.checks import check_syntax
from partforge.operators.joins import done_names
from partforge.operators.stats import pass_rate, render_rate, review_scores, source_counts
from partforge.plans.validate import validate_logs, validate_syntax
from partforge.sources import artifacts as a
from partforge.sources import datasets as d
from partforge.sources import results as r
from partforge.sources import reviews as v


def test_row_ids_follow_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(0, 1000, 1, 5).withColumnRenamed("id", "n").write.parquet(path)
    ids = d.with_row_id(spark.read.parquet(path)).repartition(3)
    assert ids.filter(F.col("row_id") != F.col("n")).isEmpty()
    assert ids.count() == 1000


def test_read_many(spark, tmp_path, rows):
    for name, n in (("a", 3), ("b", 2)):
        spark.range(n).select(F.concat(F.lit(name), "id").alias("code")).coalesce(1).write.parquet(
            str(tmp_path / name)
        )
    paths = {n: str(tmp_path / n) for n in ("b", "missing", "a")}
    df = d.read_many(spark, paths)
    assert rows(df) == [
        (0, "b", "b0"), (1, "b", "b1"), (2, "a", "a0"), (3, "a", "a1"), (4, "a", "a2")
    ]
    counts = {(x.source, x.overall): x.examples for x in source_counts(df).collect()}
    assert counts == {("a", False): 3, ("b", False): 2, (None, True): 5}
    with pytest.raises(d.NoDatasetError):
        d.read_many(spark, {"missing": str(tmp_path / "missing")})


def test_read_many_skips_only_what_cannot_be_read(spark, tmp_path, monkeypatch):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "sound"))
    spark.range(2).withColumnRenamed("id", "other").coalesce(1).write.parquet(str(tmp_path / "other"))
    (tmp_path / "cut").mkdir()
    whole = next((tmp_path / "sound").glob("*.parquet")).read_bytes()
    (tmp_path / "cut" / "a.parquet").write_bytes(whole[:-60] + b"\xff" * 52 + whole[-8:])
    (tmp_path / "empty").mkdir()
    paths = {n: str(tmp_path / n) for n in ("cut", "empty", "missing", "sound")}
    assert d.read_many(spark, paths).count() == 3
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        d.read_many(spark, {n: str(tmp_path / n) for n in ("sound", "other")}, columns=["id"])
    read = d.read_dataset

    def lost(spark, path, schema):
        df = read(spark, path, schema)
        return df.where(F.expr("raise_error('executor lost') is null")) if path.endswith("other") else df

    monkeypatch.setattr(d, "read_dataset", lost)
    with pytest.raises(Exception, match="executor lost"):
        d.read_many(spark, {n: str(tmp_path / n) for n in ("sound", "other")})


def test_read_dataset(spark, tmp_path, rows):
    path = tmp_path / "x.json"
    path.write_text('{"name": "cat", "code": "cube(1);", "more": 1}\n{"name": "dog"}\n')
    df = d.read_dataset(spark, str(path), d.T.StructType().add("name", "string"), "json")
    assert rows(df) == [("cat",), ("dog",)]
    with pytest.raises(ValueError):
        d.read_dataset(spark, str(path), fmt="json")
    assert d.with_default(df, "code").first().code == ""
    kept = d.with_default(spark.createDataFrame([(None,)], "code STRING"), "code")
    assert kept.first().code is None
    assert d.union_all([df, df]).count() == 4 and d.union_all([df]) is df


def test_results(spark, tmp_path, rows):
    folder = tmp_path / "results"
    folder.mkdir()
    one = {"name": "a", "code": "x", "original_code": "", "status": "Valid", "valid": True}
    (folder / "old.json").write_text(json.dumps([one, {"name": None, "code": "y"}], indent=2))
    (folder / "broken.json").write_text('[{"name": "lost", "code": "z"}, {"name"')
    df = r.read_results(spark, str(folder), "json_array")
    assert rows(df, "name", "code") == [("a", "x"), (None, "y")]
    assert rows(done_names(df)) == [("a",), (None,)]
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        assert r.read_results(spark, path, fmt).isEmpty()
        r.write_results(df, path, fmt)
        r.write_results(df.filter("name = 'a'"), path, fmt)
        assert rows(r.read_results(spark, path, fmt), "name") == [("a",), ("a",), (None,)]
    assert r.append_results(df, df).count() == df.count() * 2 == 4
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps(one) + '\n{"name": "cut off", \n')
    # a damaged file gives no row, and every selection says the same
    (tmp_path / "some").mkdir()
    (tmp_path / "some/good.json").write_text(json.dumps(one) + "\n\n" + json.dumps(one | {"name": "b"}))
    (tmp_path / "some/type.json").write_text(json.dumps(one | {"name": "c", "valid": "yes"}))
    lines.rename(tmp_path / "some/cut.json")
    df = r.read_results(spark, str(tmp_path / "some"), "json")
    assert df.count() == len(df.collect()) == 2 and rows(df, "name") == [("a",), ("b",)]
    rejected = r.rejected_results(spark, str(tmp_path / "some")).collect()
    assert sorted(x.path.rsplit("/", 1)[1] for x in rejected) == ["cut.json", "type.json"]


def test_row_ids_of_filtered_files(spark, tmp_path):
    for i in range(4):
        spark.range(10 * i, 10 * i + 10, numPartitions=1).write.mode("append").parquet(str(tmp_path / "a b"))
    df = spark.read.parquet(str(tmp_path / "a b"))
    ids = d.with_row_id(df.filter("id % 10 >= 5")).collect()
    assert len({x.row_id for x in ids}) == 20 and {x.row_id % 10 for x in ids} == {5, 6, 7, 8, 9}


def test_a_corrupt_source_is_skipped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all")
    paths = {"bad": str(tmp_path / "bad.parquet"), "good": str(tmp_path / "good")}
    assert d.read_many(spark, paths, spark.range(1).schema).count() == 3


def artifact(prompt, code):
    return f"// Generated by X\n// Prompt: {prompt}\n// Generated at: 2025-11-10 16:47:21\n\n{code}"


def write_runs(tmp_path):
    runs = {
        "eval_20250102_030405_123456": [
            ("01_sphere.scad", artifact("a sphere", "sphere(r=10);")),
            ("02_old_cat.scad", artifact("an old cat", "// c\n\ncube([1]);\n\nx")),
            ("03_bad.scad", artifact("bad", "module a() { cube(1);")),
        ],
        "eval_20250203_040506_654321": [("04_cube.scad", "cube(1);"), ("REVIEW.md", "# x")],
    }
    for run, files in runs.items():
        (tmp_path / run).mkdir()
        for name, text in files:
            (tmp_path / run / name).write_text(text, encoding="utf-8")
    return runs


def test_artifact_files(spark, tmp_path, rows):
    first, second = write_runs(tmp_path)
    files = a.read_artifacts(spark, str(tmp_path))
    assert files.count() == 4
    at = datetime(2025, 11, 10, 16, 47, 21)
    assert rows(a.parse_artifact(files)) == [
        (first, 1, "sphere", "a sphere", at, "sphere(r=10);"),
        (first, 2, "old_cat", "an old cat", at, "// c\n\ncube([1]);\n\nx"),
        (first, 3, "bad", "bad", at, "module a() { cube(1);"),
        (second, 4, "cube", None, None, "cube(1);"),
    ]
    rates = {x.run: (x.total, x.passed, x.failed) for x in validate_syntax(files).collect()}
    assert rates == {first: (3, 2, 1), second: (1, 1, 0), None: (4, 3, 1)}
    one_run = a.read_artifacts(spark, str(tmp_path / first), str(tmp_path / second))
    assert one_run.count() == 4


def test_many_small_artifacts_are_read_by_few_tasks_and_once(spark, tmp_path, rows):
    n = 32 * a.TASKS_PER_CORE * 4 + 200  # more than Spark gives to so many tasks
    texts = spark.range(n).select(
        F.concat(F.lit("run "), F.col("id") % 3).alias("run"),
        F.concat("id", F.lit("_x.scad")).alias("file_name"),
        F.concat(F.lit("cube("), "id", F.lit(");")).alias("content"),
    )
    folder = str(tmp_path / "files")
    written = a.write_artifact_files(texts, folder)
    read = a.read_artifacts(spark, folder)
    assert read.rdd.getNumPartitions() <= a.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = a.store_artifacts(read)
    (tmp_path / "files" / "run 0" / "0_x.scad").unlink()
    assert found.count() == n and a.missing_files(written, found).count() == 0
    assert a.missing_files(written, a.read_artifacts(spark, folder)).count() == 1


def test_artifact_table(spark, tmp_path, rows):
    data = [("run", 1, "cat", "a cat", datetime(2025, 1, 2, 3, 4, 5), "cube(1);")]
    schema = (
        "run STRING, ordinal INT, object STRING, prompt STRING, generated_at TIMESTAMP, code STRING"
    )
    rendered = a.render_artifact(spark.createDataFrame(data, schema), "X")
    assert rendered.first().file_name == "01_cat.scad"
    assert rendered.first().content == artifact("a cat", "cube(1);").replace(
        "2025-11-10 16:47:21", "2025-01-02 03:04:05"
    )
    path = str(tmp_path / "t")
    a.write_artifacts(rendered, path)
    assert rows(a.parse_artifact(a.read_artifact_table(spark, path))) == data


def test_report_and_reviews(spark, tmp_path, rows):
    data = [
        ("run", i, f"old_cat_{i}", f"{i:02d}_x.scad", i == 1, "c.png" if i == 1 else None, "bad")
        for i in range(1, 41)
    ]
    schema = (
        "run STRING, ordinal INT, object STRING, file_name STRING, rendered BOOLEAN, "
        "image STRING, error STRING"
    )
    results = spark.createDataFrame(data, schema)
    sections = v.report(results, F.lit("2025-11-10 16:48:57").cast("timestamp"), "Some")
    text = {r.section: r.text for r in sections.collect()}
    assert text[0].startswith("# Some Evaluation Report\n\n**Generated at:** 2025-11-10 16:48:57\n")
    assert "**Rendering Rate:** 2.5% (1/40 models rendered successfully)" in text[0]
    assert text[1] == (
        "### 1. Old Cat 1\n\n- **File:** `01_x.scad`\n- **Preview:** ![old_cat_1](c.png)\n"
        "- **Rendered:** ✅ Success\n- **Quality:** __ / 5 (fill in after review)\n"
        "- **Resemblance:** __ / 5 (fill in after review)\n"
        "- **Notes:** _[Add your observations here]_\n\n---\n\n"
    )
    assert "- **Rendered:** ❌ Failed\n- **Error:** `bad`\n" in text[2]

    path = tmp_path / "reports"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    v.write_report(sections, str(path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((path / "run=run").glob("part-*"))
    assert len(parts) > 1
    assert "".join(f.read_text() for f in parts) == "".join(text[k] for k in sorted(text))
    unfilled = [("run", i, None, None, None) for i in range(1, 41)]
    assert rows(v.read_reviews(spark, str(path))) == sorted(unfilled, key=repr)

    one = tmp_path / "eval_1"
    one.mkdir()
    whole = "".join(text[k] for k in sorted(text))
    whole = whole.replace("Quality:** __", "Quality:** 4", 1).replace("_[Add your", "nice _[Add", 1)
    whole = whole.replace("Resemblance:** __", "Resemblance:** 9", 1)
    (one / "REVIEW.md").write_text(whole)
    got = v.read_reviews(spark, str(one)).orderBy("ordinal").limit(2)
    assert [tuple(r) for r in got.collect()] == [
        ("eval_1", 1, 4, None, "nice _[Add observations here]_"),
        ("eval_1", 2, None, None, None),
    ]


def test_rates(spark):
    empty = spark.createDataFrame([], "run STRING, rendered BOOLEAN")
    assert tuple(render_rate(empty).first()) == (0, 0, 0.0)
    rated = spark.createDataFrame([(4, 5), (5, 2), (None, None)], "quality INT, resemblance INT")
    assert tuple(review_scores(rated).first()) == (4.5, 3.5, 70.0)
    log = spark.createDataFrame(
        [("a", 0, "warning"), ("a", 1, ""), (None, 124, "")], "run STRING, exit_code INT, output STRING"
    )
    got = {(x.run, x.overall): (x.total, x.passed, x.failed, x.warnings, x.pass_rate) for x in validate_logs(log).collect()}
    assert got == {
        ("a", False): (2, 1, 1, 1, 50.0),
        (None, False): (1, 0, 1, 0, 0.0),
        (None, True): (3, 1, 2, 1, 1 / 3 * 100),
    }
    none = pass_rate(check_syntax(spark.createDataFrame([], "run STRING, code STRING")))
    assert none.count() == 0


@pytest.mark.parametrize(
    "raw, title",
    [("old_cat", "Old Cat"), ("3d_o'neil", "3D O'Neil"), ("ALL_caps", "All Caps"), ("", "")],
)
def test_display_title(spark, raw, title):
    df = spark.createDataFrame([(raw,)], "s STRING")
    assert df.select(p.display_title(F.col("s"))).first()[0] == title == raw.replace("_", " ").title()


def test_names(spark):
    df = spark.createDataFrame([("hey helper, make me a big cat", 123)], "s STRING, i INT")
    obj = p.object_name(F.col("s"), "make", "helper")
    row = df.select(
        obj,
        p.artifact_name(F.lit(3), obj),
        p.artifact_name(F.col("i"), obj, ".png"),
        p.is_artifact(F.lit("a.scad")),
        p.is_artifact(F.lit("a.scad.txt")),
        p.generation_prompt(F.lit("cat")),
        p.run_id(F.lit("2025-11-10 16:47:20").cast("timestamp"), F.lit("job")),
    ).first()
    assert tuple(row)[:5] == ("big_cat", "03_big_cat.scad", "123_big_cat.png", True, False)
    assert row[5] == p.GENERATION_TEMPLATE.format(name="cat")
    assert row[6][:21] == "eval_20251110_164720_" and 100000 <= int(row[6][21:]) <= 999999


def test_names_on_disk_and_notes_of_lines(spark, tmp_path):
    run = tmp_path / "my run+50%=é"
    run.mkdir()
    (run / "01_tea pot.scad").write_bytes(artifact("tea pot", "cube(1);").replace("\n", "\r\n").encode())
    (run / "REVIEW.md").write_text(
        "# Report\n\n### 1. Tea\n\n- **Quality:** 4/5\n- **Resemblance:** 3 / 5\n"
        "- **Notes:** line one\nline two\n\n---\n\n### 2. Cup\n\n- **Quality:** 2/5\n- **Notes:** \n"
    )
    got = a.parse_artifact(a.read_artifacts(spark, str(tmp_path))).first()
    assert (got.run, got.object, got.prompt, got.code) == (run.name, "tea pot", "tea pot", "cube(1);")
    assert got.generated_at is not None
    reviews = v.read_reviews(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(x.run, x.quality, x.notes) for x in reviews] == [(run.name, 4, "line one\nline two"), (run.name, 2, None)]


def test_sources_in_folders_with_signs_of_patterns(spark, tmp_path, rows):
    names = ["run [1]", "50% +x", "a{b,c}", "back?*"]
    for i, name in enumerate(names):
        spark.range(i * 10, i * 10 + 10, 1, 2).write.parquet(str(tmp_path / name))
    spark.range(500, 505).write.parquet(str(tmp_path / "run 1"))  # what the first would match as a pattern
    paths = {name: d.exact_path(str(tmp_path / name)) for name in names}
    found = d.read_sources(spark, paths)
    assert found.rejects.count() == 0
    got = rows(found.rows, "row_id", "source", "id")
    assert got == sorted(((i, names[i // 10], i) for i in range(40)), key=repr)
    for name in names:
        df = d.read_dataset(spark, d.exact_path(str(tmp_path / name))).where("id % 2 = 1")
        assert sorted(r.row_id for r in d.with_row_id(df).collect()) == [1, 3, 5, 7, 9]


def test_rejects_name_source_and_stage(spark, tmp_path, rows):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    spark.range(3).write.parquet(str(tmp_path / "half"))
    (tmp_path / "half" / "part-bad.parquet").write_bytes(b"PAR1 no footer here")
    (tmp_path / "none").mkdir()
    paths = {n: str(tmp_path / n) for n in ("good", "half", "none", "gone")}
    found = d.read_sources(spark, paths)
    assert rows(found.rejects, "source", "stage") == [("gone", "listing"), ("half", "footers"), ("none", "schema")]
    assert found.rows.count() == 3 and found.rejects.where("reason = '' or path = ''").count() == 0


def test_files_are_counted_without_data(spark, tmp_path):
    spark.range(100).selectExpr("id", "repeat('x', 50) AS text").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = d.file_index(df)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_bucketed_results_are_met_without_moving_them(spark, tmp_path, rows):
    from partforge.operators.joins import not_done, not_done_bucketed
    from partforge.schemas import RESULT

    table, path = "bucketed_results_test", str(tmp_path / "it's here")
    stored = r.open_results(spark, table, path, 4)
    items = spark.createDataFrame([(i, f"n{i}") for i in range(50)] + [(50, None), (51, "")], "row_id BIGINT, name STRING")
    assert not_done_bucketed(items, stored).count() == 52
    done = [(f"n{i}", "c", "", "Valid", True) for i in range(0, 50, 3)] + [(None, "c", "", "Valid", True)] * 2
    for some in (done[:5], done[5:]):
        r.append_bucketed(spark.createDataFrame(some, RESULT), table)
    files = len(list((tmp_path / "it's here").glob("*.parquet")))
    assert files <= 8  # a file a bucket and session
    spark.sql(f"DROP TABLE {table}")  # another session opens the files again
    stored = r.open_results(spark, table, path, 4)
    assert rows(not_done_bucketed(items, stored)) == rows(not_done(items, stored))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = not_done_bucketed(items, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    spark.sql(f"DROP TABLE {table}")


def test_artifact_files_are_written_read_and_missed(spark, tmp_path, rows):
    data = [(run, 1, "cube", "a cube", datetime(2025, 11, 10), code) for run, code in (("r [1]", "cube(1);"), ("50% é", ""))]
    outputs = spark.createDataFrame(data, "run STRING, ordinal INT, object STRING, prompt STRING, generated_at TIMESTAMP, code STRING")
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        written = a.write_artifact_files(a.render_artifact(outputs), path)
        files = a.read_artifacts(spark, path)
        assert rows(written, "path") == [("50% é/01_cube.scad",), ("r [1]/01_cube.scad",)]
        assert rows(a.parse_artifact(files), "run", "object", "code") == [("50% é", "cube", ""), ("r [1]", "cube", "cube(1);")]
        assert a.missing_files(written, files).count() == 0
    (tmp_path / "plain" / "r [1]" / "01_cube.scad").write_text("cut off")
    (tmp_path / "plain" / "50% é" / "01_cube.scad").unlink()
    written = a.write_artifact_files(a.render_artifact(outputs.limit(0)), str(tmp_path / "plain")).unionByName(written)
    assert a.missing_files(written, a.read_artifacts(spark, str(tmp_path / "plain"))).count() == 2


def test_results_as_arrays(spark, tmp_path, rows, monkeypatch):
    from partforge.schemas import RESULT

    monkeypatch.setattr(r, "ARRAY_ROWS", 3)
    data = [(f"n{i}", 'line "1"\nline 2' if i % 2 else None, "", "Valid", True) for i in range(10)]
    path = str(tmp_path / "arrays")
    for some in (data[:4], data[4:]):
        r.write_results(spark.createDataFrame(some, RESULT).coalesce(1), path, "json_array")
    files = list((tmp_path / "arrays").glob("*.txt"))
    assert len(files) == 4 and max(len(json.loads(f.read_text())) for f in files) == 3
    assert rows(r.read_results(spark, path, "json_array")) == sorted(data, key=repr)
