"""From raw evaluation responses to artifacts, rates and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.functions.prompts import ASSISTANT, object_name
from partforge.functions.text import clean_response
from partforge.operators.checks import render_status
from partforge.operators.joins import with_ratings
from partforge.operators.ordering import number_outputs
from partforge.operators.stats import render_rate, review_scores
from partforge.sources.artifacts import GENERATOR, render_artifact
from partforge.sources.reviews import report


@dataclass(frozen=True)
class Evaluation:
    artifacts: DataFrame
    rendered: DataFrame
    rates: DataFrame
    report: DataFrame


def evaluate_job(
    responses: DataFrame,
    render_log: DataFrame,
    reported_at: Column,
    generator: str = GENERATOR,
    assistant: str = ASSISTANT,
) -> Evaluation:
    """Clean, number and name the responses `(run, row_id, prompt, response, generated_at)`.

    `render_log` is `(run, row_id, exit_code, image_exists, stderr, image)`; an
    output without an entry counts as not rendered.
    """
    # Cleaned first: what the numbering moves is code, not raw responses.
    cleaned = responses.select(
        "run",
        "row_id",
        "prompt",
        "generated_at",
        object_name(F.col("prompt"), assistant=assistant).alias("object"),
        clean_response(F.col("response")).alias("code"),
    )
    artifacts = render_artifact(number_outputs(cleaned), generator)
    rendered = render_status(
        artifacts.drop("content", "code").join(render_log, ["run", "row_id"], "left")
    )
    return Evaluation(
        artifacts, rendered, render_rate(rendered, ["run"]), report(rendered, reported_at)
    )


def scored(outputs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review scores per run, once the reports are filled in."""
    return review_scores(with_ratings(outputs, reviews), ["run"])
