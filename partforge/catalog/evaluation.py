"""Artifacts, ratings, reports and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.catalog.registry import query, table
from partforge.catalog.texts import CLEAN_SQL, CODES_SQL, NL, OUTPUTS_SQL, SOURCE_RATE_SQL, SYNTAX_SQL, codes, raw_outputs
from partforge.operators.checks import check_syntax
from partforge.operators.joins import with_ratings
from partforge.operators.ordering import number_outputs
from partforge.operators.stats import pass_rate, render_rate, review_scores
from partforge.plans.evaluate import evaluate_job, scored
from partforge.session import shared_folder
from partforge.sources import artifacts as a
from partforge.sources import reviews as r
from partforge.sources.results import read_results, write_results

# --- files --------------------------------------------------------------------------------


@query(
    """SELECT p_brand AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT
        AS ordinal, replace(p_name, ' ', '_') AS object, 'a ' || p_name AS prompt,
        '2025-11-10 16:47:21' AS generated_at, p_type || chr(10) || chr(10) || p_size AS code
       FROM part"""
)
def artifact_roundtrip(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("run", F.col("p_brand"))
    outputs = number_outputs(parts, "run", "p_partkey").select(
        "run",
        "ordinal",
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("object"),
        F.concat(F.lit("a "), "p_name").alias("prompt"),
        F.lit("2025-11-10 16:47:21").cast("timestamp").alias("generated_at"),
        F.concat("p_type", F.lit("\n\n"), "p_size").alias("code"),
    )
    folder = shared_folder(spark, "artifacts")
    a.write_artifacts(a.render_artifact(outputs), folder)
    parsed = a.parse_artifact(a.read_artifact_table(spark, folder))
    return parsed.withColumn("generated_at", F.date_format("generated_at", a.STAMP))


_RESULT_SQL = """SELECT 'doc ' || doc_id AS name, text AS code, source AS original_code,
    'Valid' AS status, true AS valid FROM documents"""


def _written(spark, sf_dir, fmt: str) -> DataFrame:
    results = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id")).alias("name"),
        F.col("text").alias("code"),
        F.col("source").alias("original_code"),
        F.lit("Valid").alias("status"),
        F.lit(True).alias("valid"),
    )
    folder = shared_folder(spark, "results")
    write_results(results, folder, fmt)
    return read_results(spark, folder, fmt)


@query(_RESULT_SQL)
def results_roundtrip(spark, sf_dir):
    return _written(spark, sf_dir, "parquet")


@query(_RESULT_SQL)
def results_roundtrip_json(spark, sf_dir):
    return _written(spark, sf_dir, "json")


@query(_RESULT_SQL)
def results_roundtrip_array(spark, sf_dir):
    return _written(spark, sf_dir, "json_array")


_ODD = " 50% [x] +é"


@query(
    f"""WITH {CODES_SQL}, {SYNTAX_SQL}
        SELECT source || '{_ODD}' AS run, * EXCLUDE (source), 0 AS lost FROM ({SOURCE_RATE_SQL})"""
)
def artifact_files_pass_rate(spark, sf_dir):
    """Pass rates of code written as a file each, in folders with odd names, half of them with other line ends."""
    outputs = codes(spark, sf_dir).select(
        F.concat("source", F.lit(_ODD)).alias("run"),
        F.col("doc_id").alias("ordinal"),
        F.lit("part").alias("object"),
        F.lit("a part").alias("prompt"),
        F.lit("2025-11-10 16:47:21").cast("timestamp").alias("generated_at"),
        "code",
    )
    folder = shared_folder(spark, "files")
    files = a.render_artifact(outputs)
    other = F.when(F.col("ordinal") % 2 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    written = a.write_artifact_files(files.withColumn("content", other), folder)
    found = a.store_artifacts(a.read_artifacts(spark, folder))
    lost = a.missing_files(written, found).count()
    return pass_rate(check_syntax(a.parse_artifact(found))).withColumn("lost", F.lit(lost))


# --- ratings and rates --------------------------------------------------------------------

_RUN_SQL = "'run ' || doc_id % 8"
RATED_SQL = f"""rated AS (SELECT {_RUN_SQL} AS run, documents.doc_id AS ordinal,
    quality * 3 + 2 AS quality, toxic * 4 + 1 AS resemblance
    FROM documents LEFT JOIN labels USING (doc_id))"""


def outputs(spark, sf_dir) -> DataFrame:
    run = F.concat(F.lit("run "), F.col("doc_id") % 8)
    docs = table(spark, sf_dir, "documents")
    return docs.select(run.alias("run"), F.col("doc_id").alias("ordinal"))


def reviews(spark, sf_dir) -> DataFrame:
    run = F.concat(F.lit("run "), F.col("doc_id") % 8)
    return table(spark, sf_dir, "labels").select(
        run.alias("run"),
        F.col("doc_id").alias("ordinal"),
        (F.col("quality") * 3 + 2).alias("quality"),
        (F.col("toxic") * 4 + 1).alias("resemblance"),
    )


@query(f"WITH {RATED_SQL} SELECT * FROM rated")
def rated_outputs(spark, sf_dir):
    return with_ratings(outputs(spark, sf_dir), reviews(spark, sf_dir))


@query(
    f"""WITH {RATED_SQL} SELECT avg(quality) AS quality, avg(resemblance) AS resemblance,
        avg(resemblance) / 5 * 100 AS resemblance_rate FROM rated"""
)
def overall_scores(spark, sf_dir):
    return review_scores(with_ratings(outputs(spark, sf_dir), reviews(spark, sf_dir)))


@query(
    f"""WITH {RATED_SQL} SELECT run, avg(quality) AS quality, avg(resemblance) AS resemblance,
        avg(resemblance) / 5 * 100 AS resemblance_rate FROM rated GROUP BY run"""
)
def scores_per_run(spark, sf_dir):
    return scored(outputs(spark, sf_dir), reviews(spark, sf_dir))


RENDERED_SQL = """rendered AS (SELECT lang AS run, doc_id,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS ordinal,
    'part_of_' || source AS object, coalesce(quality = 1, false) AS rendered,
    CASE WHEN quality = 1 THEN doc_id || '.png' END AS image,
    CASE WHEN quality = 1 THEN NULL ELSE 'no ' || doc_id END AS error
    FROM documents LEFT JOIN labels USING (doc_id))"""


def rendered(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    done = F.coalesce(F.col("quality") == 1, F.lit(False))
    return number_outputs(docs.join(labels, "doc_id", "left"), "lang", "doc_id").select(
        F.col("lang").alias("run"),
        "ordinal",
        F.concat(F.lit("part_of_"), "source").alias("object"),
        F.format_string("%02d_part.scad", "ordinal").alias("file_name"),
        done.alias("rendered"),
        F.when(done, F.concat("doc_id", F.lit(".png"))).alias("image"),
        F.when(~done, F.concat(F.lit("no "), "doc_id")).alias("error"),
    )


@query(
    f"""WITH {RENDERED_SQL} SELECT run, count(*) AS total, count(*) FILTER (rendered) AS rendered,
        count(*) FILTER (rendered) / count(*)::DOUBLE * 100 AS rate FROM rendered GROUP BY run"""
)
def render_rates(spark, sf_dir):
    return render_rate(rendered(spark, sf_dir), ["run"])


# --- reports ------------------------------------------------------------------------------


def _template_sql(template: str, **values: str) -> str:
    """A report template as SQL text with expressions for its fields."""
    text = "'" + template.replace("'", "''") + "'"
    for field, value in values.items():
        text = text.replace("{" + field + "}", f"' || {value} || '")
    return text


_RATES = "count(*) FILTER (rendered) / count(*)::DOUBLE * 100"
_DONE = _template_sql(r.RENDERED, object="object", image="image")
_NOT_DONE = _template_sql(r.NOT_RENDERED, error="error")
_HEAD_SQL = _template_sql(
    r.HEAD,
    title="'Model'",
    stamp="'2025-11-10 16:48:57'",
    total="count(*)",
    rendered="count(*) FILTER (rendered)",
    rate=f"printf('%.1f', {_RATES})",
)
_SECTION_SQL = _template_sql(
    r.SECTION,
    ordinal="ordinal",
    name="'Part Of ' || upper(left(substring(object, 9), 1)) || substring(object, 10)",
    file="format('{:02d}_part.scad', ordinal)",
    outcome=f"CASE WHEN rendered THEN {_DONE} ELSE {_NOT_DONE} END",
)
REPORT_SQL = f"""sections AS (
    SELECT run, 0::BIGINT AS section, {_HEAD_SQL} AS text FROM rendered GROUP BY run
    UNION ALL SELECT run, ordinal, {_SECTION_SQL} FROM rendered
    UNION ALL SELECT DISTINCT run, 9223372036854775807, {_template_sql(r.GUIDE)} FROM rendered)"""


def _sections(spark, sf_dir) -> DataFrame:
    at = F.lit("2025-11-10 16:48:57").cast("timestamp")
    return r.report(rendered(spark, sf_dir), at)


@query(f"WITH {RENDERED_SQL}, {REPORT_SQL} SELECT run, section, text FROM sections")
def report_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(
    f"""WITH {RENDERED_SQL} SELECT run, ordinal::INT AS ordinal,
        CASE WHEN rendered THEN 4 END AS quality, CASE WHEN ordinal % 2 = 0 THEN 3 END
          AS resemblance, CASE WHEN rendered THEN 'fine' END AS notes FROM rendered"""
)
def reviews_roundtrip(spark, sf_dir):
    """Reports written, filled in for some outputs, and read back."""
    done = F.contains("text", F.lit("✅"))
    text = F.when(
        done,
        F.replace(
            F.replace("text", F.lit("Quality:** __"), F.lit("Quality:** 4")),
            F.lit("_[Add your observations here]_"),
            F.lit("fine"),
        ),
    ).otherwise(F.col("text"))
    filled = _sections(spark, sf_dir).withColumn("text", text)
    text = F.when(
        F.col("section") % 2 == 0,
        F.replace("text", F.lit("Resemblance:** __"), F.lit("Resemblance:** 3")),
    ).otherwise(F.col("text"))
    folder = shared_folder(spark, "reports")
    r.write_report(filled.withColumn("text", text), folder)
    return r.read_reviews(spark, folder)


@query(
    f"""WITH {OUTPUTS_SQL}, {CLEAN_SQL},
        n AS (SELECT lang AS run, doc_id, code, 'hey assistant, create me a ' || source AS prompt,
          source AS object, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS ordinal
          FROM cleaned JOIN documents USING (doc_id))
        SELECT run, format('{{:02d}}_{{}}.scad', ordinal, object) AS file_name,
          '// Generated by partforge' || {NL} || '// Prompt: ' || prompt || {NL}
          || '// Generated at: 2025-11-10 16:47:21' || {NL} || {NL} || code AS content FROM n"""
)
def evaluate_job_artifacts(spark, sf_dir):
    return _evaluation(spark, sf_dir).artifacts.select("run", "file_name", "content")


@query(
    """WITH x AS (SELECT lang AS run, coalesce(quality = 1, false) AS rendered
          FROM documents LEFT JOIN labels USING (doc_id))
        SELECT run, count(*) AS total, count(*) FILTER (rendered) AS rendered,
          count(*) FILTER (rendered) / count(*)::DOUBLE * 100 AS rate FROM x GROUP BY run"""
)
def evaluate_job_rates(spark, sf_dir):
    return _evaluation(spark, sf_dir).rates


def _evaluation(spark, sf_dir):
    responses = raw_outputs(spark, sf_dir).select(
        F.col("lang").alias("run"),
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("hey assistant, create me a "), "source").alias("prompt"),
        "response",
        F.lit("2025-11-10 16:47:21").cast("timestamp").alias("generated_at"),
    )
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    log = table(spark, sf_dir, "labels").join(langs, "doc_id").select(
        F.col("lang").alias("run"),
        F.col("doc_id").alias("row_id"),
        F.lit(0).alias("exit_code"),
        (F.col("quality") == 1).alias("image_exists"),
        F.lit("").alias("stderr"),
        F.lit("part.png").alias("image"),
    )
    return evaluate_job(responses, log, F.lit("2025-11-10 16:48:57").cast("timestamp"))
