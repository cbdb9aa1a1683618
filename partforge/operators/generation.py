"""Caller-supplied functions: batched maps and code generators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.operators.calls import Answer, CallPolicy, answers
from partforge.schemas import ATTEMPT


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Columns in, columns out, a batch of rows at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(each, schema)


def call_key(row_id: object, attempt: int, prompt: str | None) -> str:
    """What names a call: the same in every repetition of its task."""
    return hashlib.sha256(f"{row_id}:{attempt}:{prompt}".encode()).hexdigest()


#: Answers are handed on when there are so many, or when the first of them has waited so long.
ANSWERS, SECONDS = 256, 1.0


def generate_with(
    prompts: DataFrame,
    connect: Callable[[], Callable[..., str | None]],
    attempt: int = 1,
    parallelism: int | None = None,
    policy: CallPolicy = CallPolicy(),
) -> DataFrame:
    """Call a generator for each row `(row_id, name, prompt)`; gives attempts.

    `connect` runs once per task and returns the function to call, with the prompt and,
    if the policy says `keyed`, a key that a repeated task gives again, so that a service can answer
    what it has answered before. A call that raises, runs out of time, or returns nothing, is an
    attempt without a response. Calls are slow, so the rows are first spread over `parallelism`
    tasks, as many as the session has cores if not given; by row id, so that a repeated task
    sees the same rows. In a task as many calls are in flight as the policy says, and answers go
    on as they come.
    """
    parallelism = parallelism or prompts.sparkSession.sparkContext.defaultParallelism

    def call_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()

        def ask(row: tuple) -> str | None:
            row_id, _, prompt = row
            return call(prompt, call_key(row_id, attempt, prompt)) if policy.keyed else call(prompt)

        rows = (
            row
            for batch in batches
            for row in zip(*(batch[c].tolist() for c in ("row_id", "name", "prompt")), strict=True)
        )
        held: list[Answer] = []
        for answer in answers(rows, ask, policy):
            held.append(answer)
            if len(held) >= ANSWERS or answer.finished_at - held[0].finished_at >= SECONDS:
                yield attempts_of(held)
                held = []
        if held:
            yield attempts_of(held)

    def attempts_of(held: list[Answer]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "row_id": [a.row[0] for a in held],
                "name": [a.row[1] for a in held],
                "attempt": attempt,
                "response": [a.response for a in held],
                "error": [a.error for a in held],
                "finished_at": pd.to_datetime([int(a.finished_at * 1e6) for a in held], unit="us", utc=True),
            }
        )

    spread = prompts.select("row_id", "name", "prompt").repartition(parallelism, F.col("row_id"))
    return spread.mapInPandas(call_each, ATTEMPT)
