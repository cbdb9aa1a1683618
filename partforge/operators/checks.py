"""Checks of code texts and classification of tool logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.functions.text import extract_code, trim_response

# What the syntax check counts and looks for, and its messages.
PAIRED_SIGNS = [("braces", "{", "}"), ("parentheses", "(", ")"), ("brackets", "[", "]")]
KEYWORDS = [
    "module", "function", "sphere", "cube", "cylinder", "union",
    "difference", "intersection", "translate", "rotate", "scale",
]
NOTHING_LEFT = "File contains only comments or is empty"
NO_KEYWORD = "No OpenSCAD keywords found"
NON_ASCII = "Contains non-ASCII characters"

# Outcomes of compiling and rendering.
VALID = "Valid"
VALID_WITH_WARNINGS = "Valid (with warnings)"
EMPTY_CODE = "Empty code"
COMPILE_FAILED = "Compilation failed"
COMPILE_TIMEOUT = "Compilation timeout"
TIMEOUT_EXIT = 124
RENDER_TIMEOUT = "Rendering timeout"
RENDER_OFF = "Rendering disabled (set ENABLE_RENDERING=True to enable)"
NO_DISPLAY = "No display available (install xvfb: sudo apt install xvfb)"
NO_BINARY = "OpenSCAD not found at '{}'"
UNKNOWN_ERROR = "Unknown error"


def _occurrences(text: Column, sign: str) -> Column:
    """How often a one-byte sign occurs; byte lengths are stored, character counts are not."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def check_syntax(df: DataFrame, code: str = "code") -> DataFrame:
    """Add `valid` and `errors`: unbalanced signs, no code, no keyword, non-ASCII characters.

    Comment lines that start in the first column do not count.
    """
    text = F.coalesce(F.col(code), F.lit(""))
    # A removed comment leaves an empty line, which none of the checks can see.
    body = F.when(F.contains(text, F.lit("//")), F.regexp_replace(text, r"(?dm)^//.*", ""))
    df = df.withColumn("_body", body.otherwise(text))
    body = F.col("_body")

    failed, messages = [], []
    for label, opening, closing in PAIRED_SIGNS:
        n_open, n_close = _occurrences(body, opening), _occurrences(body, closing)
        message = F.concat(
            F.lit(f"Unbalanced {label}: "), n_open, F.lit(" open, "), n_close, F.lit(" close")
        )
        failed.append(n_open != n_close)
        messages.append(message)
    failed.append(~F.rlike(body, F.lit(r"[^\n]")))
    has_keyword = reduce(or_, [F.contains(body, F.lit(word)) for word in KEYWORDS])
    failed += [~has_keyword, F.octet_length(body) != F.length(body)]
    messages += [F.lit(NOTHING_LEFT), F.lit(NO_KEYWORD), F.lit(NON_ASCII)]
    errors = [F.when(f, m).otherwise("") for f, m in zip(failed, messages, strict=True)]
    return df.withColumns(
        {
            # array_remove compiles, array_compact would have this step interpreted.
            "errors": F.array_remove(F.array(*errors), ""),
            # From the tests themselves, so that no message is built where only this is read.
            "valid": ~reduce(or_, failed),
        }
    ).drop("_body")


def check_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add `code`, `valid` and `message` to raw answers: trim, extract, check syntax."""
    coded = df.withColumn("code", extract_code(trim_response(F.col(response))))
    checked = check_syntax(coded)
    has_code = F.length("code") > 0
    return checked.withColumns(
        {
            "valid": F.coalesce(has_code & F.col("valid"), F.lit(False)),
            "message": F.when(~F.coalesce(has_code, F.lit(False)), F.lit(EMPTY_CODE))
            .when(F.col("valid"), F.lit(VALID))
            .otherwise(F.array_join("errors", "; ")),
        }
    ).drop("errors")


def _first_line_with(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?dm)^.*(?:{pattern}).*", 0), F.lit(""))


def compile_status(df: DataFrame) -> DataFrame:
    """Add `valid` and `message` to compile logs.

    Reads `code, exit_code, stdout, stderr, timed_out`, and `exception` if the
    log has it.
    """
    ok = F.col("exit_code") == 0
    warned = F.contains("stdout", F.lit("WARNING")) | F.contains("stderr", F.lit("WARNING"))
    raised = F.col("exception") if "exception" in df.columns else F.lit(None).cast("string")
    ran = F.length(F.coalesce("code", F.lit(""))) > 0
    finished = ran & ~F.coalesce("timed_out", F.lit(False)) & raised.isNull()
    message = (
        F.when(~ran, F.lit(EMPTY_CODE))
        .when(F.col("timed_out"), F.lit(COMPILE_TIMEOUT))
        .when(raised.isNotNull(), raised)
        .when(ok & warned, F.lit(VALID_WITH_WARNINGS))
        .when(ok, F.lit(VALID))
        .otherwise(
            F.coalesce(_first_line_with(F.col("stderr"), "ERROR|error"), F.lit(COMPILE_FAILED))
        )
    )
    return df.withColumns({"valid": F.coalesce(finished & ok, F.lit(False)), "message": message})


def validator_status(df: DataFrame) -> DataFrame:
    """Add `passed`, `warned`, `timed_out` and `details` to validator logs `(exit_code, output)`.

    `details` holds the warning lines of a pass, or at most five error lines of a failure.
    """
    output = F.coalesce("output", F.lit(""))
    passed = F.col("exit_code") == 0
    timed_out = F.col("exit_code") == TIMEOUT_EXIT

    def lines_with(pattern: str) -> Column:
        return F.regexp_extract_all(output, F.lit(rf"(?dm)^.*{pattern}.*"), F.lit(0))

    nothing = F.array().cast("array<string>")
    return df.withColumns(
        {
            "passed": passed,
            "warned": passed & F.rlike(output, F.lit("(?i)warning")),
            "timed_out": timed_out,
            "details": F.when(passed, lines_with("(?i:warning)"))
            .when(timed_out, nothing)
            .otherwise(F.slice(lines_with("(?:ERROR|error|PARSE)"), 1, 5)),
        }
    )


def render_status(df: DataFrame, binary: str = "openscad", enabled: bool = True) -> DataFrame:
    """Add `rendered` and `error` to render logs, and keep `image` only for a success.

    Reads `exit_code, image_exists, stderr, image`, and `timed_out`,
    `binary_missing` and `exception` if the log has them.
    """
    if not enabled:
        return df.withColumns(
            {
                "rendered": F.lit(False),
                "error": F.lit(RENDER_OFF),
                "image": F.lit(None).cast("string"),
            }
        )

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)

    raised = F.col("exception") if "exception" in df.columns else F.lit(None).cast("string")
    stopped = flag("timed_out") | flag("binary_missing") | raised.isNotNull()
    done = (F.col("exit_code") == 0) & F.col("image_exists")
    rendered = F.coalesce(~stopped & done, F.lit(False))
    stderr = F.coalesce(F.nullif("stderr", F.lit("")), F.lit(UNKNOWN_ERROR))
    error = (
        F.when(rendered, F.lit(None).cast("string"))
        .when(flag("timed_out"), F.lit(RENDER_TIMEOUT))
        .when(flag("binary_missing"), F.lit(NO_BINARY.format(binary)))
        .when(raised.isNotNull(), raised)
        .when(F.rlike(stderr, F.lit("DISPLAY|X server")), F.lit(NO_DISPLAY))
        .otherwise(stderr)
    )
    return df.withColumns(
        {"rendered": rendered, "error": error, "image": F.when(rendered, F.col("image"))}
    )
