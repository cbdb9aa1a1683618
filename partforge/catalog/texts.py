"""Extraction, cleaning, checks and log classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.catalog.registry import query, table
from partforge.functions import text as t
from partforge.operators.checks import (
    check_response,
    check_syntax,
    compile_status,
    render_status,
    validator_status,
)
from partforge.operators.stats import pass_rate
from partforge.plans.validate import validate_logs, validate_syntax

WS = "'" + t.PY_WS + "'"
NL = "chr(10)"

# --- answers and code texts made from documents -----------------------------------------

ANSWERS = [
    ("", ""),
    ("Sure, see below.\n```\n", "\n```\nDone."),
    ("Text\n```openscad\nHere is a cube\n$fn = 50;\n// part\n", "\ncube([1, 2, 3]);\n```"),
    ("Here is the model:\n\nmodule part() {\n", "\n}"),
]
OUTPUTS = [
    ("", ""),
    (
        "system\n\nToday Date: 26 July 2024\n\nuser\n\na cube<|eot_id|>"
        + t.ASSISTANT_HEADER
        + "\n\n",
        "<|eot_id|> tail",
    ),
    ("user\n\nassistant\nCutting Knowledge Date: December 2023\n", "<|end_of_text|>tail"),
    ("  assistant\n", "\nкккккк\nafter"),
]
CODES = [
    ("module part() {\n", "\n}"),
    ("union() {\n// {{ }\n", ""),
    ("translate([1, 2, 3]) cube(4));\n", ""),
    ("", ""),
]


def _wrapped(kinds: list[tuple[str, str]], n: int) -> Column:
    """The text between the words of its kind; kinds beyond the list comment the text out."""
    kind = F.col("doc_id") % n
    made = F.concat(F.lit("// "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n// ")))
    for i, (before, after) in enumerate(kinds):
        made = F.when(kind == i, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(
            made
        )
    return made


def _wrapped_sql(kinds: list[tuple[str, str]], n: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{a}' || text || '{b}'" for i, (a, b) in enumerate(kinds))
    comment = f"'// ' || replace(text, {NL}, {NL} || '// ')"
    return f"CASE doc_id % {n} {cases} ELSE {comment} END"


def answers(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _wrapped(ANSWERS, 4).alias("response"))


def codes(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", _wrapped(CODES, 5).alias("code"))


def raw_outputs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", _wrapped(OUTPUTS, 4).alias("response"))


# Named subqueries for the SQL: inputs first, then one rule each, from `taken` to `made`.
ANSWERS_SQL = f"answers AS (SELECT doc_id, {_wrapped_sql(ANSWERS, 4)} AS response FROM documents)"
OUTPUTS_SQL = f"outputs AS (SELECT doc_id, {_wrapped_sql(OUTPUTS, 4)} AS response FROM documents)"
CODES_SQL = f"codes AS (SELECT doc_id, source, {_wrapped_sql(CODES, 5)} AS code FROM documents)"


def _or(template: str, words: list[str]) -> str:
    return "(" + " OR ".join(template.format(w.replace("'", "''")) for w in words) + ")"


EXTRACT_SQL = f"""
    fenced AS (SELECT doc_id, CASE
            WHEN contains(response, '```openscad')
              THEN split_part(split_part(response, '```openscad', 2), '```', 1)
            WHEN contains(response, '```') THEN split_part(response, '```', 2)
            ELSE response END AS body
          FROM answers),
    answer_lines AS (SELECT doc_id, body, string_split(body, {NL}) AS lines FROM fenced),
    code_starts AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x:
            NOT {_or("starts_with(trim(x, " + WS + "), '{}')", t.LEAD_INS)}
            AND ({_or("starts_with(trim(x, " + WS + "), '{}')", t.CODE_STARTS)}
                 OR {_or("contains(x, '{}')", t.CODE_WORDS)})), true), 0) AS pos
          FROM answer_lines),
    extracted AS (SELECT doc_id, trim(CASE WHEN pos > 0 THEN array_to_string(lines[pos:], {NL})
                              ELSE body END, {WS}) AS code
          FROM code_starts)"""


@query(f"WITH {ANSWERS_SQL}, {EXTRACT_SQL} SELECT doc_id, code FROM extracted")
def extract_code(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", t.extract_code(F.col("response")).alias("code"))


CLEAN_SQL = f"""
    replies AS (SELECT doc_id, string_split(response, '{t.ASSISTANT_HEADER}')[-1] AS body
          FROM outputs),
    reply_lines AS (SELECT doc_id, string_split(body, {NL}) AS lines FROM replies),
    content_starts AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x:
            trim(x, {WS}) NOT IN ('', 'system', 'user', 'assistant')
            AND NOT contains(x, 'Cutting Knowledge Date:') AND NOT contains(x, 'Today Date:')
            AND NOT ends_with(trim(x, {WS}), 'assistant')), true), 1) AS pos
          FROM reply_lines),
    contents AS (SELECT doc_id, array_to_string(lines[pos:], {NL}) AS body FROM content_starts),
    spoken AS (SELECT doc_id, string_split(split_part(split_part(split_part(split_part(body,
            '<|eot_id|>', 1), '<|end_of_text|>', 1), '<|eom_id|>', 1),
            '<|reserved_special_token_', 1), {NL}) AS lines
          FROM contents),
    garbage AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x:
            trim(x, {WS}) <> '' AND (
              length(regexp_replace(x, '[^ -~]', '', 'g')) / length(x)::DOUBLE < 0.8
              OR regexp_matches(x, '{t.GARBAGE_RUN}'))), true), len(lines) + 1) AS stop
          FROM spoken),
    cleaned AS (SELECT doc_id, trim(array_to_string(lines[1:stop - 1], {NL}), {WS}) AS code
          FROM garbage)"""


@query(f"WITH {OUTPUTS_SQL}, {CLEAN_SQL} SELECT doc_id, code FROM cleaned")
def clean_response(spark, sf_dir):
    outputs = raw_outputs(spark, sf_dir)
    return outputs.select("doc_id", t.clean_response(F.col("response")).alias("code"))


@query(
    f"""SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' {chr(9)} ' ELSE
        {NL} || text || chr(160) END, {WS}), '') AS response FROM documents"""
)
def trim_response(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("\n"), F.col("text"), F.lit("\xa0"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t ")).otherwise(padded)
    return docs.select("doc_id", t.trim_response(raw).alias("response"))


@query(
    """SELECT doc_id, length(text) AS chars, n_chars AS stated,
         CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS short,
         CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS longer,
         left(text, 100) AS cut
       FROM documents"""
)
def previews(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        t.n_chars(text).alias("chars"),
        F.col("n_chars").alias("stated"),
        t.preview(text, 150).alias("short"),
        t.preview(text, 200).alias("longer"),
        t.preview(text, 100, "").alias("cut"),
    )


def _signs(label: str, opening: str, closing: str) -> str:
    opened = f"(length(code) - length(replace(code, '{opening}', '')))"
    closed = f"(length(code) - length(replace(code, '{closing}', '')))"
    return f"""CASE WHEN {opened} <> {closed} THEN
        'Unbalanced {label}: ' || {opened} || ' open, ' || {closed} || ' close' END"""


SYNTAX_SQL = f"""
    bodies AS (SELECT doc_id, source, array_to_string(list_filter(string_split(code, {NL}),
            lambda x: x <> '' AND NOT starts_with(x, '//')), {NL}) AS code FROM codes),
    checked AS (SELECT doc_id, source, list_filter([
            {_signs("braces", "{", "}")}, {_signs("parentheses", "(", ")")},
            {_signs("brackets", "[", "]")},
            CASE WHEN code = '' THEN 'File contains only comments or is empty' END,
            CASE WHEN NOT regexp_matches(code, 'module|function|sphere|cube|cylinder|union'
              || '|difference|intersection|translate|rotate|scale')
              THEN 'No OpenSCAD keywords found' END,
            CASE WHEN strlen(code) <> length(code) THEN 'Contains non-ASCII characters' END],
            lambda e: e IS NOT NULL) AS errors FROM bodies)"""

PASS_RATE_SQL = """SELECT {by}, grouping({by}) = 1 AS overall, count(*) AS total,
      count(*) FILTER (valid) AS passed, count(*) FILTER (NOT valid) AS failed,
      count(*) FILTER ({warned}) AS warnings,
      count(*) FILTER (valid) / count(*)::DOUBLE * 100 AS pass_rate
    FROM {checks} GROUP BY ROLLUP ({by})"""


SOURCE_RATE_SQL = PASS_RATE_SQL.format(
    by="source", warned="false", checks="(SELECT source, errors = [] AS valid FROM checked)"
)


@query(
    f"""WITH {CODES_SQL}, {SYNTAX_SQL} SELECT doc_id, errors = [] AS valid,
        array_to_string(errors, '; ') AS errors FROM checked"""
)
def check_syntax_errors(spark, sf_dir):
    checked = check_syntax(codes(spark, sf_dir))
    return checked.select("doc_id", "valid", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {CODES_SQL}, {SYNTAX_SQL} {SOURCE_RATE_SQL}")
def syntax_pass_rate(spark, sf_dir):
    return pass_rate(check_syntax(codes(spark, sf_dir)), "source")


@query(f"WITH {CODES_SQL}, {SYNTAX_SQL} SELECT * RENAME (source AS run) FROM ({SOURCE_RATE_SQL})")
def validate_job(spark, sf_dir):
    path = F.format_string("runs/%s/%02d_part.scad", F.col("source"), F.col("doc_id"))
    files = codes(spark, sf_dir).select(path.alias("path"), F.col("code").alias("content"))
    return validate_syntax(files)


@query(
    f"""WITH {OUTPUTS_SQL}, {CLEAN_SQL},
        codes AS (SELECT doc_id, source, code FROM cleaned JOIN documents USING (doc_id)),
        {SYNTAX_SQL} {SOURCE_RATE_SQL}"""
)
def cleaned_pass_rate(spark, sf_dir):
    """Raw outputs, cleaned, checked, and counted per source."""
    outputs = raw_outputs(spark, sf_dir)
    cleaned = outputs.select("source", t.clean_response(F.col("response")).alias("code"))
    return pass_rate(check_syntax(cleaned), "source")


@query(
    f"""WITH {ANSWERS_SQL}, {EXTRACT_SQL},
        codes AS (SELECT doc_id, '' AS source, code FROM extracted), {SYNTAX_SQL}
        SELECT doc_id, codes.code <> '' AND errors = [] AS valid,
          CASE WHEN codes.code = '' THEN 'Empty code' WHEN errors = [] THEN 'Valid'
            ELSE array_to_string(errors, '; ') END AS message
        FROM checked JOIN codes USING (doc_id)"""
)
def check_responses(spark, sf_dir):
    return check_response(answers(spark, sf_dir)).select("doc_id", "valid", "message")


# --- tool logs made from events ----------------------------------------------------------

LOG_LINES = "['opened ' || props, 'WARNING: value ' || event_id, 'Warning again', 'done']"
ERR_LINES = """['start', 'ERROR: bad ' || props, 'PARSE stop', 'error two', 'ERROR 3',
    'error 4', 'error 5', 'error 6']"""

LOG_SQL = f"""log AS (SELECT *,
    CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 WHEN 'click' THEN 124
      ELSE 1 END AS exit_code,
    CASE WHEN event_type = 'purchase' THEN array_to_string({LOG_LINES}, {NL})
      WHEN event_type = 'error' THEN array_to_string({ERR_LINES}, {NL}) ELSE 'quiet' END AS output
    FROM events)"""


def tool_log(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    logged = F.concat_ws(
        "\n",
        F.concat(F.lit("opened "), "props"),
        F.concat(F.lit("WARNING: value "), "event_id"),
        F.lit("Warning again"),
        F.lit("done"),
    )
    failed = F.concat_ws(
        "\n",
        F.lit("start"),
        F.concat(F.lit("ERROR: bad "), "props"),
        F.lit("PARSE stop"),
        F.lit("error two\nERROR 3\nerror 4\nerror 5\nerror 6"),
    )
    return table(spark, sf_dir, "events").select(
        "*",
        F.when(kind.isin("purchase", "signup"), 0)
        .when(kind == "click", 124)
        .otherwise(1)
        .alias("exit_code"),
        F.when(kind == "purchase", logged)
        .when(kind == "error", failed)
        .otherwise(F.lit("quiet"))
        .alias("output"),
    )


@query(
    f"""WITH {LOG_SQL} SELECT event_id, exit_code = 0 AND user_id % 10 > 0 AS valid,
        CASE WHEN user_id % 10 = 0 THEN 'Empty code' WHEN event_type = 'click'
          THEN 'Compilation timeout' WHEN exit_code = 0 AND contains(output, 'WARNING')
          THEN 'Valid (with warnings)' WHEN exit_code = 0 THEN 'Valid'
          WHEN event_type = 'error' THEN 'ERROR: bad ' || props
          ELSE 'Compilation failed' END AS message
        FROM log"""
)
def compile_outcomes(spark, sf_dir):
    log = tool_log(spark, sf_dir).select(
        "event_id",
        F.when(F.col("user_id") % 10 > 0, F.lit("cube(1);")).otherwise(F.lit("")).alias("code"),
        "exit_code",
        F.when(F.col("exit_code") == 0, F.col("output")).otherwise(F.lit("")).alias("stdout"),
        F.when(F.col("exit_code") == 0, F.lit("")).otherwise(F.col("output")).alias("stderr"),
        (F.col("event_type") == "click").alias("timed_out"),
    )
    return compile_status(log).select("event_id", "valid", "message")


@query(
    f"""WITH {LOG_SQL} SELECT event_id, exit_code = 0 AS passed,
        exit_code = 0 AND contains(lower(output), 'warning') AS warned,
        exit_code = 124 AS timed_out,
        array_to_string(CASE WHEN exit_code = 0 THEN list_filter(string_split(output, {NL}),
            lambda x: contains(lower(x), 'warning'))
          WHEN exit_code = 124 THEN [] ELSE (list_filter(string_split(output, {NL}),
            lambda x: contains(x, 'ERROR') OR contains(x, 'error') OR contains(x, 'PARSE')))[1:5]
          END, ' | ') AS details
        FROM log"""
)
def validator_outcomes(spark, sf_dir):
    return validator_status(tool_log(spark, sf_dir)).select(
        "event_id", "passed", "warned", "timed_out", F.array_join("details", " | ").alias("details")
    )


@query(
    f"""WITH {LOG_SQL}, checks AS (SELECT 'user_' || (user_id % 7) AS run, exit_code = 0 AS valid,
          exit_code = 0 AND contains(lower(output), 'warning') AS warned FROM log)
        {PASS_RATE_SQL.format(by="run", warned="warned", checks="checks")}"""
)
def validator_pass_rate(spark, sf_dir):
    run = F.concat(F.lit("user_"), F.col("user_id") % 7)
    return validate_logs(tool_log(spark, sf_dir).withColumn("run", run))


@query(
    f"""WITH {LOG_SQL} SELECT event_id, exit_code = 0 AND value >= 5 AS rendered,
        CASE WHEN exit_code = 0 AND value >= 5 THEN event_id || '.png' END AS image,
        CASE WHEN exit_code = 0 AND value >= 5 THEN NULL
          WHEN event_type = 'click' THEN 'Rendering timeout'
          WHEN event_type = 'view' THEN 'No display available (install xvfb: sudo apt install xvfb)'
          WHEN event_type = 'error' THEN output ELSE 'Unknown error' END AS error
        FROM log"""
)
def render_outcomes(spark, sf_dir):
    kind = F.col("event_type")
    log = tool_log(spark, sf_dir).select(
        "event_id",
        "exit_code",
        (F.col("value") >= 5).alias("image_exists"),
        F.concat(F.col("event_id"), F.lit(".png")).alias("image"),
        F.when(kind == "error", F.col("output"))
        .when(kind == "view", F.lit("cannot open X server"))
        .otherwise(F.lit(""))
        .alias("stderr"),
        (kind == "click").alias("timed_out"),
    )
    return render_status(log).select("event_id", "rendered", "image", "error")
