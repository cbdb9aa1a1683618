"""Generate code for the names of a source that have no result yet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partforge.functions.prompts import generation_prompt
from partforge.operators.attempts import MAX_RETRIES, resolve_attempts, to_results, winners
from partforge.operators.calls import CallPolicy
from partforge.operators.checks import check_response
from partforge.operators.generation import generate_with
from partforge.operators.joins import not_done, with_original
from partforge.operators.progress import progress
from partforge.operators.projections import head_n
from partforge.operators.stats import session_stats, total_items
from partforge.schemas import ATTEMPT
from partforge.session import shared_folder
from partforge.sources.datasets import with_default
from partforge.sources.ledger import ITEMS, Ledger
from partforge.sources.results import read_results, write_results

#: Row ids of a slice: what is repeated at most when a session stops.
SLICE_ROWS = 1 << 16


def generate_job(
    spark: SparkSession,
    source: DataFrame,
    results: str,
    connect: Callable[[], Callable[..., str | None]],
    samples: int | None = None,
    max_retries: int = MAX_RETRIES,
    parallelism: int | None = None,
    check: Callable[[DataFrame], DataFrame] = check_response,
    work: str | None = None,
    policy: CallPolicy = CallPolicy(),
    slice_rows: int = SLICE_ROWS,
    most_steps: int | None = None,
) -> DataFrame:
    """Run the missing items through the generator and append what is valid to `results`.

    The session's ledger is in `work`. Wave by wave of slices, each step makes one attempt for each
    item still open, commits it to the ledger and appends its successes to the results. Called again
    with the same `work`, a session that was stopped, or had enough with `most_steps`, goes on
    with the items it began with, after their last committed attempt: no committed call is made
    again. A step is of one slice at first; later of as many as went before, up to `SLICE_ROWS` row ids.
    Returns the outcome of each item that was asked for.
    """
    ledger = Ledger(spark, work or shared_folder(spark, "attempts"))
    items = head_n(with_default(source, "code"), samples)
    ledger.begin(not_done(items, read_results(spark, results)), slice_rows, items)
    schema = check(spark.createDataFrame([], ATTEMPT)).schema
    if any(s.slice != ITEMS for s in ledger.steps()):
        _save_rest(spark, ledger, items, results, schema, max_retries)
    made = 0
    for wave, done in ledger.waves(max(1, SLICE_ROWS // slice_rows)):
        attempt, still_open = (done.attempt, done.open) if done else (0, 1)
        while still_open and attempt < max_retries and made != most_steps:
            asked = ledger.items(*wave) if not attempt else _unanswered(ledger, wave[0], attempt, schema)
            attempt, made = attempt + 1, made + 1
            asked = asked.withColumn("prompt", generation_prompt(F.col("name")))
            tried = check(generate_with(asked, connect, attempt, parallelism, policy))
            stored, still_open = ledger.write(tried, wave[0], attempt, wave[-1])
            write_results(_successes(stored, ledger.originals(*wave), items, max_retries), results)
        if made == most_steps:
            break
    return resolve_attempts(ledger.attempts(schema), max_retries)


def _unanswered(ledger: Ledger, number: int, attempt: int, schema) -> DataFrame:
    return ledger.read([(number, attempt)], schema).where(~F.col("valid")).select("row_id", "name")


def _successes(attempts: DataFrame, originals: DataFrame | None, items: DataFrame, max_retries: int) -> DataFrame:
    """What won, next to the code it was generated anew for; that is in `items` if the ledger does not have it.

    As a step's attempts have one number, the winners are found without looking them up by it, and no
    step broadcasts a table, of which the driver would get one per step.
    """
    originals = items.select("row_id", "code") if originals is None else originals
    return to_results(with_original(winners(attempts, max_retries), originals.hint("merge")))


def _save_rest(spark, ledger: Ledger, items: DataFrame, results: str, schema, max_retries: int) -> None:
    """Append the successes that a session committed but did not get to append before it stopped.

    Only those of the last step can be missing. Names may repeat, so rows are counted: all
    successes with one of these names against all results with one.
    """
    newest = max((s for s in ledger.steps() if s.slice != ITEMS), key=lambda s: s.started_at)
    names = ledger.read([(newest.slice, newest.attempt)], schema).where("valid").select("name").distinct()
    names = names.withColumnRenamed("name", "_name")
    same = F.col("name").eqNullSafe(F.col("_name"))
    saved = read_results(spark, results).join(names, same, "left_semi")
    there = ledger.attempts(schema).join(names, same, "left_semi")
    rest = _successes(there, ledger.originals(), items, max_retries).exceptAll(saved)
    if not rest.isEmpty():
        write_results(rest, results)


@dataclass(frozen=True)
class SessionReport:
    """What a session has come to: counts, all results so far, and its progress item by item."""

    statistics: DataFrame
    total: DataFrame
    progress: DataFrame


def session_report(
    spark: SparkSession,
    work: str,
    results: str,
    max_retries: int = MAX_RETRIES,
    check: Callable[[DataFrame], DataFrame] = check_response,
) -> SessionReport:
    """Statistics of the session whose ledger is in `work`, also while it runs or after it stopped.

    An item counts as completed with its success, or with the last attempt it had.
    """
    ledger = Ledger(spark, work)
    attempts = ledger.attempts(check(spark.createDataFrame([], ATTEMPT)).schema)
    outcomes = resolve_attempts(attempts, max_retries)
    finished = attempts.groupBy("row_id", "attempt").agg(F.max("finished_at").alias("finished_at"))
    ended = outcomes.where(F.col("status") != "pending").join(finished, ["row_id", "attempt"])
    began = min((s.started_at for s in ledger.steps()), default=None)
    done = ended.select(
        F.lit("session").alias("session"),
        "row_id",
        F.lit(began).cast("timestamp").alias("started_at"),
        "finished_at",
        F.lit(ledger.items().count() if began else 0).alias("total"),
        "status",
        "needed_retry",
    )
    return SessionReport(session_stats(outcomes), total_items(read_results(spark, results)), progress(done))
