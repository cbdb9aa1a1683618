"""Resume, attempts, outcomes, progress, prompts and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.catalog.registry import query, table
from partforge.functions import prompts as p
from partforge.operators.attempts import resolve_attempts, to_failures, to_results
from partforge.operators.calls import CallPolicy
from partforge.operators.checks import check_response
from partforge.operators.generation import generate_with, map_batches
from partforge.operators.joins import done_names, not_done, not_done_bucketed, with_original
from partforge.operators.ordering import RUN_BITS, id_cells, number_outputs, running_totals
from partforge.operators.progress import progress
from partforge.operators.projections import head_n, row_at
from partforge.operators.stats import session_stats, total_items
from partforge.plans.generate import generate_job, session_report
from partforge.schemas import ATTEMPT
from partforge.session import shared_folder
from partforge.sources.datasets import exact_path, file_index, read_dataset, with_default, with_row_id
from partforge.sources.ledger import Ledger
from partforge.sources.results import append_bucketed, append_results, open_results, read_results

# --- sources and resume -------------------------------------------------------------------


def _named(df: DataFrame) -> DataFrame:
    """Names of documents or labels; every fiftieth is NULL."""
    name = F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("doc "), F.col("doc_id")))
    return df.withColumn("name", name)


_NAMED_SQL = "CASE WHEN doc_id % 50 <> 0 THEN 'doc ' || doc_id END AS name"


@query("SELECT doc_id AS row_id, doc_id, lang FROM documents")
def dataset_rows(spark, sf_dir):
    placed = with_row_id(table(spark, sf_dir, "documents"))
    return placed.select("row_id", "doc_id", "lang")


@query(
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, lang FROM documents
       QUALIFY lang = 'en'"""
)
def dataset_rows_many_files(spark, sf_dir):
    """Positions in a dataset of eight files, in a folder with signs of patterns in its name, under a filter."""
    folder = f"{shared_folder(spark, 'many')}/run [1] 50% {{a,b}}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    stored = read_dataset(spark, exact_path(folder))
    return with_row_id(stored.where("lang = 'en'"), index=file_index(stored)).select("row_id", "doc_id", "lang")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 120")
def first_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return head_n(docs, 120, "doc_id")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1 OFFSET 5")
def row_at_position(spark, sf_dir):
    placed = with_row_id(table(spark, sf_dir, "documents"))
    return row_at(placed, 5).select("doc_id", "text")


@query("SELECT doc_id, '' AS code FROM labels")
def default_code(spark, sf_dir):
    return with_default(table(spark, sf_dir, "labels"), "code").select("doc_id", "code")


@query(
    f"""WITH d AS (SELECT doc_id, {_NAMED_SQL} FROM documents),
          l AS (SELECT {_NAMED_SQL} FROM labels)
        SELECT doc_id, name FROM d
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name IS NOT DISTINCT FROM d.name)"""
)
def resume_anti_join(spark, sf_dir):
    docs = _named(table(spark, sf_dir, "documents"))
    done = _named(table(spark, sf_dir, "labels"))
    return not_done(docs, done).select("doc_id", "name")


@query(
    f"""WITH d AS (SELECT doc_id, {_NAMED_SQL} FROM documents),
          l AS (SELECT {_NAMED_SQL} FROM labels)
        SELECT doc_id, name FROM d
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name IS NOT DISTINCT FROM d.name)"""
)
def resume_bucketed(spark, sf_dir):
    """Resume against results that two sessions have stored in buckets by name."""
    done = _named(table(spark, sf_dir, "labels")).select(
        "name", *[F.lit(x).alias(c) for c, x in (("code", ""), ("original_code", ""), ("status", "Valid"))],
        F.lit(True).alias("valid"), "doc_id",
    )
    path = shared_folder(spark, "buckets")
    stored = "results_" + path.rsplit("-", 1)[1]
    open_results(spark, stored, path, 8)
    for i in (0, 1):
        append_bucketed(done.where(F.col("doc_id") % 2 == i), stored)
    return not_done_bucketed(_named(table(spark, sf_dir, "documents")), spark.table(stored)).select("doc_id", "name")


@query(f"SELECT DISTINCT {_NAMED_SQL} FROM labels")
def completed_names(spark, sf_dir):
    return done_names(_named(table(spark, sf_dir, "labels")))


# --- attempts -----------------------------------------------------------------------------


def attempts(spark, sf_dir) -> DataFrame:
    """Events as attempts: an item is a user's day, its attempts are counted by event id."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    placed = running_totals(
        events,
        ["user_id", "day"],
        id_cells("event_id", RUN_BITS),
        [F.col("event_id")],
        {"attempt": F.lit(1).cast("bigint")},
    )
    return _checked(placed)


def _checked(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return df.withColumns(
        {
            "code": F.when(kind == "view", F.lit("")).when(
                kind != "error", F.concat(F.lit("cube("), "event_id", F.lit(");"))
            ),
            "valid": kind == "purchase",
            "message": F.when(kind == "purchase", F.lit("Valid")).otherwise(F.lit("ERROR: 1")),
        }
    )


_ITEM = ["user_id", "day"]


def outcomes_sql(attempt: str) -> str:
    return f"""
    e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events),
    n AS (SELECT *, {attempt} AS attempt FROM e),
    w AS (SELECT user_id, day, max(attempt) AS last,
            arg_max(event_type, (attempt, CASE event_type WHEN 'error' THEN 0
              WHEN 'view' THEN 1 ELSE 2 END)) AS kind,
            min((attempt, left(md5('cube(' || event_id || ');' || chr(10) || 'Valid'), 14), event_id))
              FILTER (event_type = 'purchase') AS won
          FROM n WHERE attempt <= 5 GROUP BY ALL),
    o AS (SELECT user_id, day,
            CASE WHEN won IS NOT NULL THEN 'success' WHEN last >= 5 THEN 'failed'
              ELSE 'pending' END AS status,
            coalesce(won[1], last)::BIGINT AS attempt,
            'cube(' || won[3] || ');' AS code,
            CASE WHEN won IS NOT NULL THEN 'Valid' WHEN last >= 5 THEN
              CASE kind WHEN 'error' THEN 'Failed to generate code after 5 attempts'
                WHEN 'view' THEN 'Failed to extract code after 5 attempts'
                ELSE 'Failed validation after 5 attempts' END END AS message,
            won IS NOT NULL AND won[1] > 1 AS needed_retry
          FROM w)"""


OUTCOMES_SQL = outcomes_sql("row_number() OVER (PARTITION BY user_id, day ORDER BY event_id)")
OUTCOME_COLUMNS = "user_id, day, status, attempt, code, message, needed_retry"


def outcomes(spark, sf_dir) -> DataFrame:
    return resolve_attempts(attempts(spark, sf_dir), keys=_ITEM)


@query(f"WITH {OUTCOMES_SQL} SELECT {OUTCOME_COLUMNS} FROM o")
def resolved_attempts(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query(
    f"""WITH {OUTCOMES_SQL} SELECT 'user ' || user_id AS name, code, '' AS original_code,
        message AS status, true AS valid FROM o WHERE status = 'success'
        UNION ALL SELECT 'doc ' || doc_id, text, text, 'Valid', true FROM documents"""
)
def accumulated_results(spark, sf_dir):
    """Results of earlier sessions and of this one."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id")).alias("name"),
        F.col("text").alias("code"),
        F.col("text").alias("original_code"),
        F.lit("Valid").alias("status"),
        F.lit(True).alias("valid"),
    )
    named = outcomes(spark, sf_dir).withColumn("name", F.concat(F.lit("user "), "user_id"))
    return append_results(docs, to_results(named))


@query(
    f"""WITH {OUTCOMES_SQL} SELECT 'user ' || user_id AS name, message AS error
        FROM o WHERE status = 'failed'"""
)
def failed_items(spark, sf_dir):
    named = outcomes(spark, sf_dir).withColumn("name", F.concat(F.lit("user "), "user_id"))
    return to_failures(named)


_STATS_SQL = """count(*) AS total, count(*) FILTER (status = 'success') AS success,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (needed_retry) AS retries,
    count(*) FILTER (status = 'success') / count(*)::DOUBLE * 100 AS success_pct,
    count(*) FILTER (status = 'failed') / count(*)::DOUBLE * 100 AS failed_pct"""


@query(f"WITH {OUTCOMES_SQL} SELECT {_STATS_SQL} FROM o")
def session_statistics(spark, sf_dir):
    return session_stats(outcomes(spark, sf_dir))


@query(
    f"""WITH {OUTCOMES_SQL}, s AS (SELECT *, attempt * 1.5::DOUBLE AS seconds FROM o)
        SELECT day, {_STATS_SQL}, round(avg(seconds), 6) AS mean_seconds FROM s GROUP BY day"""
)
def session_statistics_by_day(spark, sf_dir):
    timed = outcomes(spark, sf_dir).withColumn("seconds", F.col("attempt") * 1.5)
    return session_stats(timed, ["day"]).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("SELECT count(*) AS total_items FROM documents")
def total_result_items(spark, sf_dir):
    return total_items(table(spark, sf_dir, "documents"))


@query(
    """WITH c AS (SELECT 's' || user_id % 3 AS session, event_id, ts, event_type,
            count(*) OVER (PARTITION BY user_id % 3) AS total FROM events),
          n AS (SELECT *, row_number() OVER w AS completed,
            (count(*) FILTER (event_type <> 'error') OVER w) AS success,
            (count(*) FILTER (event_type = 'error') OVER w) AS failed,
            (count(*) FILTER (event_type = 'click') OVER w) AS retries,
            (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000::DOUBLE AS spent
            FROM c WINDOW w AS (PARTITION BY session ORDER BY ts, event_id
              ROWS UNBOUNDED PRECEDING))
        SELECT session, event_id, completed, success, failed, retries,
          floor(spent)::BIGINT AS elapsed_seconds, spent / completed AS mean_seconds,
          total - completed AS remaining,
          floor(spent / completed * (total - completed))::BIGINT AS eta_seconds
        FROM n"""
)
def progress_log(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("session"), "event_id", "ts", "event_type"
    )
    totals = events.groupBy("session").agg(F.count("*").alias("total"))
    # Three sessions by construction, so their totals are safe to broadcast.
    done = events.join(F.broadcast(totals), "session").select(
        "session",
        F.col("event_id").alias("row_id"),
        "total",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started_at"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        (F.col("event_type") == "click").alias("needed_retry"),
    )
    return progress(done).select(
        "session",
        F.col("row_id").alias("event_id"),
        "completed",
        "success",
        "failed",
        "retries",
        "elapsed_seconds",
        "mean_seconds",
        "remaining",
        "eta_seconds",
    )


# --- prompts and names --------------------------------------------------------------------


@query(
    f"""SELECT p_partkey, replace('{p.GENERATION_TEMPLATE}', '{{name}}', p_name) AS asked,
        'hey assistant, create me a ' || p_name AS created,
        'hey helper, make me a ' || p_name AS made FROM part"""
)
def prompts(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        p.generation_prompt(name).alias("asked"),
        p.instruction(name).alias("created"),
        p.instruction(name, "make", "helper").alias("made"),
    )


@query(
    """WITH n AS (SELECT p_partkey, p_brand, replace(p_name, ' ', '_') AS object,
          row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ordinal FROM part)
        SELECT p_partkey, object, ordinal, format('{:02d}_{}.scad', ordinal, object) AS file_name,
          array_to_string(list_transform(string_split(object, '_'),
            lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') AS title, true AS accepted
        FROM n"""
)
def artifact_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("asked", p.instruction(F.col("p_name")))
    named = number_outputs(parts, "p_brand", "p_partkey").withColumn(
        "object", p.object_name(F.col("asked"))
    )
    file_name = p.artifact_name(F.col("ordinal"), F.col("object"))
    return named.select(
        "p_partkey",
        "object",
        "ordinal",
        file_name.alias("file_name"),
        p.display_title(F.col("object")).alias("title"),
        p.is_artifact(file_name).alias("accepted"),
    )


@query(
    """SELECT event_id, 'eval_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' ||
        (('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT % 900000 + 100000) AS run
        FROM events"""
)
def run_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    run = p.run_id(F.col("ts"), F.col("event_id").cast("string"))
    return events.select("event_id", run.alias("run"))


@query(
    """SELECT p_partkey, 'cube(' || p_size || ');' AS code, p_name AS original_code
       FROM part"""
)
def original_code(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    source = parts.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("code"))
    made = F.concat(F.lit("cube("), "p_size", F.lit(");")).alias("code")
    results = parts.select(F.col("p_partkey").alias("row_id"), made)
    return with_original(results, source).withColumnRenamed("row_id", "p_partkey")


# --- supplied functions -------------------------------------------------------------------


def _stand_in():
    """A stand-in generator: answers by the name in the prompt, with failures of each kind.

    An inner function travels to the tasks by value, so they need no installed package.
    """

    def connect():
        def call(prompt: str) -> str | None:
            name = prompt.split("3D model of: ")[1].split("\n")[0]
            if name.endswith("ring"):
                raise ValueError(f"no answer for {name}")
            if name.endswith("bolt"):
                return None
            if name.startswith("red"):
                return f"```openscad\ncube({len(name)};\n```"
            return f"Here is it:\n// {name}\ncube({len(name)});"

        return call

    return connect


_ANSWER_SQL = """CASE WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt' THEN NULL
    WHEN p_name LIKE 'red%' THEN '```openscad' || chr(10) || 'cube(' || length(p_name) || ';'
      || chr(10) || '```'
    ELSE 'Here is it:' || chr(10) || '// ' || p_name || chr(10) || 'cube(' || length(p_name)
      || ');' END"""


@query(
    f"""SELECT p_partkey AS row_id, p_name AS name, 2 AS attempt, {_ANSWER_SQL} AS response,
        CASE WHEN p_name LIKE '%ring' THEN 'no answer for ' || p_name END AS error FROM part"""
)
def generated_attempts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("name"),
        p.generation_prompt(F.col("p_name")).alias("prompt"),
    )
    return generate_with(parts, _stand_in(), attempt=2).drop("finished_at")


@query(
    f"""SELECT p_partkey AS row_id, p_name AS name, 2 AS attempt, {_ANSWER_SQL} AS response,
        CASE WHEN p_name LIKE '%ring' THEN 'no answer for ' || p_name END AS error FROM part"""
)
def generated_concurrent(spark, sf_dir):
    """As `generated_attempts`, with several calls of a task in flight."""
    parts = _sources(spark, sf_dir).withColumn("prompt", p.generation_prompt(F.col("name")))
    policy = CallPolicy(in_flight=8, seconds=60, tries=2, backoff=0.01)
    return generate_with(parts, _stand_in(), attempt=2, policy=policy).drop("finished_at")


def _sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("code"),
    )


@query("SELECT doc_id, length(text) AS chars, upper(lang) AS lang FROM documents")
def mapped_batches(spark, sf_dir):
    def shape(batch):
        return batch[["doc_id"]].assign(chars=batch["text"].str.len(), lang=batch["lang"].str.upper())

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return map_batches(docs, shape, "doc_id BIGINT, chars BIGINT, lang STRING")


@query(
    """SELECT p_partkey AS row_id, p_name AS name,
        CASE WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt' OR p_name LIKE 'red%'
          THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt'
            THEN 'Failed to generate code after 5 attempts'
          WHEN p_name LIKE 'red%' THEN 'Failed validation after 5 attempts'
          ELSE 'Valid' END AS message,
        CASE WHEN NOT (p_name LIKE '%ring' OR p_name LIKE '%bolt' OR p_name LIKE 'red%')
          THEN '// ' || p_name || chr(10) || 'cube(' || length(p_name) || ');' END AS code
        FROM part"""
)
def generate_job_outcomes(spark, sf_dir):
    parts = _sources(spark, sf_dir)
    done = generate_job(spark, parts, shared_folder(spark, "results"), _stand_in())
    return done.select("row_id", "name", "status", "message", "code")


# --- sessions that stop and go on -----------------------------------------------------------


def _moody():
    """As `_stand_in`, but a call may go unanswered, by its key: another attempt has another key."""
    inner = _stand_in()

    def connect():
        call = inner()
        return lambda prompt, key: call(prompt) if key >= "8" else None

    return connect


def _stopped_session(spark, sf_dir) -> tuple[str, str]:
    """The ledger and the results of a session that was stopped amid the attempts of a slice, and went on."""
    work, results = shared_folder(spark, "ledger"), shared_folder(spark, "results")
    policy = CallPolicy(in_flight=4, seconds=60, keyed=True)
    parts = _sources(spark, sf_dir)
    for most_steps in (3, None):
        generate_job(
            spark, parts, results, _moody(), work=work, policy=policy, slice_rows=1100, most_steps=most_steps
        )
    return work, results


_SESSION_SQL = f"""
    c AS (SELECT p_partkey AS row_id, p_name AS name, p_type, a.attempt::BIGINT AS attempt,
            sha256(p_partkey || ':' || a.attempt || ':' ||
              replace('{p.GENERATION_TEMPLATE}', '{{name}}', p_name)) >= '8'
              AND NOT (p_name LIKE '%ring' OR p_name LIKE '%bolt') AS answered,
            p_name LIKE 'red%' AS wrong
          FROM part, range(1, 6) a(attempt)),
    o AS (SELECT row_id, name, p_type, min(attempt) FILTER (answered AND NOT wrong) AS won,
            max(answered) FILTER (attempt = 5) AS spoke FROM c GROUP BY ALL),
    s AS (SELECT row_id, name, p_type, won IS NOT NULL AS good,
            CASE WHEN won IS NOT NULL THEN 'success' ELSE 'failed' END AS status,
            CASE WHEN won IS NOT NULL THEN 'Valid' WHEN spoke THEN 'Failed validation after 5 attempts'
              ELSE 'Failed to generate code after 5 attempts' END AS message,
            coalesce(won, 5) AS attempt, coalesce(won > 1, false) AS needed_retry,
            CASE WHEN won IS NOT NULL
              THEN '// ' || name || chr(10) || 'cube(' || length(name) || ');' END AS code FROM o)"""


@query(f"WITH {_SESSION_SQL} SELECT row_id, name, status, message, attempt, needed_retry, code, attempt AS tried FROM s")
def generate_job_resumed(spark, sf_dir):
    """Outcomes of a session that was stopped, and how many attempts of each item the ledger holds."""
    work, _ = _stopped_session(spark, sf_dir)
    made = Ledger(spark, work).attempts(check_response(spark.createDataFrame([], ATTEMPT)).schema)
    tried = made.groupBy("row_id").agg(F.count("*").alias("tried"))
    done = resolve_attempts(made).withColumn("attempt", F.col("attempt").cast("bigint"))
    return done.join(tried, "row_id")


@query(f"WITH {_SESSION_SQL} SELECT name, code, p_type AS original_code, message AS status, good AS valid FROM s WHERE good")
def generate_job_results(spark, sf_dir):
    """What a stopped session has saved in the end."""
    _, results = _stopped_session(spark, sf_dir)
    return read_results(spark, results)


@query(
    f"""WITH {_SESSION_SQL} SELECT {_STATS_SQL}, count(*) FILTER (good) AS total_items,
        count(*) AS completed, 0 AS remaining FROM s"""
)
def generate_job_statistics(spark, sf_dir):
    """Statistics of a stopped session, all results, and the last line of its progress."""
    report = session_report(spark, *_stopped_session(spark, sf_dir))
    last = report.progress.agg(F.max("completed").alias("completed"), F.min("remaining").cast("int").alias("remaining"))
    parts = report.statistics.unionByName(report.total, allowMissingColumns=True)
    parts = parts.unionByName(last, allowMissingColumns=True)  # a row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
