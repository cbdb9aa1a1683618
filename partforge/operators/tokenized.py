"""Token arrays: counts, shifted training data, masked labels and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.functions.chat import (
    LLAMA,
    ChatTemplate,
    chat_segments,
    render_chat,
    render_prompt,
    to_messages,
)
from partforge.functions.tokens import WordTokenizer
from partforge.operators.ordering import id_cells, running_totals

# Fixed value: the label that a loss function leaves out.
IGNORED = -100


def n_tokens(pairs: DataFrame, tokenizer=None) -> DataFrame:
    """Add `n_tokens` of input, a line feed, and output."""
    tokenizer = tokenizer or WordTokenizer()
    text = F.concat("input", F.lit("\n"), "output")
    return pairs.withColumn("n_tokens", tokenizer.count(text))


def encode_pairs(
    pairs: DataFrame, tokenizer=None, template: ChatTemplate = LLAMA
) -> DataFrame:
    """Add `full_tokens` of the rendered pair and `prompt_tokens` of its prompt, encoded once each."""
    tokenizer = tokenizer or WordTokenizer()
    both = to_messages(F.col("input"), F.col("output"))
    prompt = F.slice(both, 1, 1)
    return pairs.withColumns(
        {
            "full_tokens": tokenizer.ids(render_chat(both, template)),
            "prompt_tokens": F.size(tokenizer.ids(render_prompt(prompt, template))),
        }
    )


def to_datum(encoded: DataFrame) -> DataFrame:
    """Add `input_tokens`, `target_tokens` and `weights` for next-token training.

    Weights are 0 for the prompt and 1 for the completion, shifted with the targets.
    """
    n = F.size("full_tokens")
    prompt = F.col("prompt_tokens")
    shifted = F.greatest(n - 1, F.lit(0))
    zeros, ones = F.array_repeat(F.lit(0), prompt), F.array_repeat(F.lit(1), n - prompt)
    return encoded.withColumns(
        {
            "input_tokens": F.slice("full_tokens", F.lit(1), shifted),
            "target_tokens": F.slice("full_tokens", F.lit(2), shifted),
            "weights": F.slice(
                F.concat(zeros, ones), F.lit(2), F.greatest(n - 1, prompt - 1, F.lit(0))
            ),
        }
    )


def mask_labels(
    chats: DataFrame,
    messages: str = "messages",
    tokenizer=None,
    template: ChatTemplate = LLAMA,
) -> DataFrame:
    """Add `input_ids` and `labels`; only the tokens of assistant turns keep their label."""
    tokenizer = tokenizer or WordTokenizer()
    segments = chat_segments(F.col(messages), template)
    texts = F.transform(segments, lambda s: s["text"])
    learned = F.transform(segments, lambda s: s["learned"])
    labels = F.zip_with("_ids", learned, labels_of)
    return (
        chats.withColumn("_ids", tokenizer.ids_each(texts))
        .withColumns({"input_ids": F.flatten("_ids"), "labels": F.flatten(labels)})
        .drop("_ids")
    )


def encode_at_once(pairs: DataFrame, tokenizer, template: ChatTemplate = LLAMA) -> DataFrame:
    """What `n_tokens`, `encode_pairs` and `mask_labels` add to pairs, from one call of the tokenizer a row.

    For a tokenizer that runs in Python: the pair, its rendered text, its prompt and the pieces of the text
    go over in one array, instead of in four passes.
    """
    both = to_messages(F.col("input"), F.col("output"))
    segments = chat_segments(both, template)
    texts = [
        F.concat("input", F.lit("\n"), "output"),
        render_chat(both, template),
        render_prompt(F.slice(both, 1, 1), template),
    ]
    pieces = F.concat(F.array(*texts), F.transform(segments, lambda s: s["text"]))
    encoded = pairs.withColumn("_all", tokenizer.ids_each(pieces))
    one = lambda i: F.get("_all", F.lit(i))
    learned = F.transform(segments, lambda s: s["learned"])
    own = F.slice("_all", F.lit(len(texts) + 1), F.size("_all") - len(texts))
    return encoded.withColumns(
        {
            "n_tokens": F.size(one(0)),
            "full_tokens": one(1),
            "prompt_tokens": F.size(one(2)),
            "input_ids": F.flatten(own),
            "labels": F.flatten(F.zip_with(own, learned, labels_of)),
        }
    ).drop("_all")


def labels_of(ids: Column, keep: Column) -> Column:
    """A piece's ids as its labels, if it is learned."""
    return F.when(keep, ids).otherwise(F.array_repeat(F.lit(IGNORED), F.size(ids)))


def unmask_view(c_labels: Column, blank: int) -> Column:
    """Labels with the masked ones shown as blanks, for decoding and reading."""
    return F.transform(c_labels, lambda x: F.when(x == IGNORED, blank).otherwise(x))


def pack(
    sequences: DataFrame, max_len: int, columns: list[str], row_id: str = "row_id"
) -> DataFrame:
    """Blocks of `max_len` tokens cut from all sequences laid end to end in row order.

    Reads token arrays of equal length per row from `columns` (tokens, labels,
    weights, ...). Gives `block`, from 0, the packed columns, and `examples`:
    the row id and length of each piece in the block. Only the last block may be
    short. A row is cut where it is, so what moves is pieces of at most
    `max_len` tokens, and no more than `max_len` tokens meet in one group. The
    lengths are summed in a pass of their own: store what is costly to encode.
    """
    n = F.size(columns[0])
    placed = running_totals(
        sequences.select(row_id, *columns),
        [],
        id_cells(row_id),
        [F.col(row_id)],
        {"_end": n.cast("bigint")},
    )
    start = F.col("_end") - n

    def piece(block: Column) -> Column:
        skip = F.greatest(block * max_len - start, F.lit(0))
        stop = F.least((block + 1) * max_len - start, n.cast("bigint"))
        skip, size = skip.cast("int"), (stop - skip).cast("int")
        return F.struct(
            block.alias("block"),
            size.alias("size"),
            *[F.slice(c, skip + 1, size).alias(c) for c in columns],
        )

    first, last = F.floor(start / max_len), F.floor((F.col("_end") - 1) / max_len)
    touched = F.when(n > 0, F.sequence(first, last))
    pieces = placed.select(row_id, F.explode(F.transform(touched, piece)).alias("_p"))
    members = F.array_sort(
        F.collect_list(F.struct(F.col(row_id), "_p.size", *[f"_p.{c}" for c in columns]))
    )
    blocks = pieces.groupBy(F.col("_p.block").alias("block")).agg(members.alias("_m"))
    return blocks.select(
        "block",
        *[F.flatten(F.col("_m")[c]).alias(c) for c in columns],
        F.transform(
            "_m", lambda m: F.struct(m[row_id].alias(row_id), m["size"].alias("size"))
        ).alias("examples"),
    )
