"""Turn source examples into token tables for a trainer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partforge.functions.chat import LLAMA, ChatTemplate, render_chat, to_messages
from partforge.operators.ordering import assign_batches, epochs, shuffle_epochs
from partforge.operators.projections import to_pairs
from partforge.operators.stats import TOKEN_LIMIT, longest, token_stats
from partforge.operators.tokenized import encode_at_once, encode_pairs, mask_labels, n_tokens, pack, to_datum
from partforge.sources.datasets import Sources, read_sources, write_prepared

# Shapes of training arrays.
SHIFTED = "shifted"
MASKED = "masked"


@dataclass(frozen=True)
class Prepared:
    """Where the examples of a run are stored, and their statistics."""

    examples: str
    stats: DataFrame
    longest: DataFrame


def prepare_job(
    spark: SparkSession,
    source: DataFrame,
    out: str,
    tokenizer=None,
    template: ChatTemplate = LLAMA,
    token_limit: int = TOKEN_LIMIT,
    shapes: tuple[str, ...] = (SHIFTED, MASKED),
) -> Prepared:
    """Render, count and encode the examples once, and store them with their training arrays.

    `source` has `row_id, name, code`. A trainer that packs reads the MASKED
    arrays and one that batches the SHIFTED ones; both start from the stored
    table. An unused shape is not worth its encoding. A tokenizer in Python is called once a row.
    """
    both = to_messages(F.col("input"), F.col("output"))
    made = to_pairs(source).withColumn("text", render_chat(both, template))
    if tokenizer is not None and tokenizer.in_python:
        made = encode_at_once(made, tokenizer, template)
        made = to_datum(made).drop("full_tokens") if SHIFTED in shapes else made.drop("full_tokens", "prompt_tokens")
        made = made if MASKED in shapes else made.drop("input_ids", "labels")
    else:
        made = n_tokens(made, tokenizer)
        if SHIFTED in shapes:
            made = to_datum(encode_pairs(made, tokenizer, template)).drop("full_tokens")
        if MASKED in shapes:
            chats = made.withColumn("messages", both)
            made = mask_labels(chats, "messages", tokenizer, template).drop("messages")
    examples = f"{out}/examples"
    write_prepared(made, examples)
    stored = spark.read.parquet(examples)
    return Prepared(
        examples,
        token_stats(stored, token_limit),
        longest(stored.select("row_id", "input", "output", "n_tokens")),
    )


def prepare_sources(
    spark: SparkSession, paths: dict[str, str], out: str, columns: list, **how
) -> tuple[Prepared, Sources]:
    """`prepare_job` over several named sources, those that cannot be read left out and told.

    `columns` are the `name` and `code` of every source's rows; row ids count on from source to source.
    """
    found = read_sources(spark, paths, columns=columns)
    return prepare_job(spark, found.rows, out, **how), found


def packed_blocks(spark: SparkSession, prepared: Prepared, max_len: int) -> DataFrame:
    """Blocks for a trainer that packs."""
    stored = spark.read.parquet(prepared.examples)
    return pack(stored, max_len, ["input_ids", "labels"])


def batched_epochs(
    spark: SparkSession, prepared: Prepared, n_epochs: int, batch_size: int, seed: int
) -> DataFrame:
    """Batches for a trainer that reads shuffled epochs.

    Only keys are ranked; the arrays join their rank afterwards, by row id.
    """
    stored = spark.read.parquet(prepared.examples)
    order = shuffle_epochs(epochs(stored.select("row_id"), n_epochs), seed)
    data = stored.select("row_id", "input_tokens", "target_tokens", "weights")
    return assign_batches(order, batch_size).join(data, "row_id")
