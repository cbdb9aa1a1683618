"""Chats, token arrays, packing and losses."""

import math
import random

import pytest
from pyspark.sql import functions as F

from partforge.functions import chat
from partforge.functions.tokens import SuppliedTokenizer, WordTokenizer, words
from partforge.operators import stats, tokenized
from partforge.operators.projections import to_pairs, turn_pairs

LENGTHS = WordTokenizer(F.length)


def head(role):
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n"


def test_render(spark):
    df = spark.createDataFrame([("ask", "code"), ("ask", None)], "input STRING, output STRING")
    both = chat.to_messages(F.col("input"), F.col("output"))
    template = chat.ChatTemplate(preamble="<s>")
    got = df.coalesce(1).select(
        chat.render_chat(both), chat.render_prompt(F.slice(both, 1, 1), template)
    )
    user = head("user") + "ask<|eot_id|>"
    first, second = got.collect()
    assert first[0] == user + head("assistant") + "code<|eot_id|>"
    assert first[1] == "<s>" + user + head("assistant")
    assert second[0] == user + head("assistant") + "<|eot_id|>"


def test_words(spark):
    texts = ["", "  ", "a", " a\tb\n\nc\x0bd\x0ce\r ", "x\xa0y"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").coalesce(1)
    got = [r[0] for r in df.select(words(F.col("t"))).collect()]
    assert got == [[], [], ["a"], ["a", "b", "c", "d", "e"], ["x\xa0y"]]


def datum(full, n_prompt):
    weights = [0] * n_prompt + [1] * (len(full) - n_prompt)
    return full[:-1], full[1:], weights[1:]


@pytest.mark.parametrize(
    "full, n_prompt", [([1, 2, 3, 4], 2), ([1, 2], 2), ([7], 0), ([], 0), ([1, 2], 5), ([], 3)]
)
def test_datum(spark, full, n_prompt):
    df = spark.createDataFrame([(full, n_prompt)], "full_tokens ARRAY<INT>, prompt_tokens INT")
    r = tokenized.to_datum(df).first()
    assert (r.input_tokens, r.target_tokens, r.weights) == datum(full, n_prompt)


def test_supplied_tokenizer_equals_native(spark):
    df = spark.createDataFrame(
        [(1, "make it", "cube ( 1 ) ;"), (2, "", "")], "row_id INT, input STRING, output STRING"
    )
    supplied = SuppliedTokenizer(lambda: lambda text: [len(w) for w in text.split()])
    for build in (
        lambda t: tokenized.to_datum(tokenized.encode_pairs(df, t)),
        lambda t: tokenized.n_tokens(df, t),
        lambda t: tokenized.mask_labels(
            df.withColumn("messages", chat.to_messages(F.col("input"), F.col("output"))),
            tokenizer=t,
        ),
    ):
        native = sorted(map(str, build(LENGTHS).collect()))
        assert sorted(map(str, build(supplied).collect())) == native


def test_masking_several_turns(spark):
    turns = [("system", "be brief"), ("user", "a b"), ("assistant", "c d e"), ("user", "f")]
    turns += [("assistant", "")]
    df = spark.createDataFrame([(turns,)], "messages ARRAY<STRUCT<role: STRING, content: STRING>>")
    r = tokenized.mask_labels(df, tokenizer=LENGTHS).first()
    want_ids, want_labels = [], []
    for role, content in turns:
        prefix = [len(head(role).strip())]
        body = [len(w) for w in (content + "<|eot_id|>").split()]
        want_ids += prefix + body
        want_labels += [-100] * len(prefix) + (body if role == "assistant" else [-100] * len(body))
    assert (r.input_ids, r.labels) == (want_ids, want_labels)
    shown = df.select(tokenized.unmask_view(F.lit([-100, 5, -100]), 9)).first()[0]
    assert shown == [9, 5, 9]


@pytest.mark.parametrize("max_len", [1, 7, 64, 5000])
@pytest.mark.parametrize("partitions", [1, 5])
def test_packing(spark, max_len, partitions):
    rng = random.Random(3)
    lengths = [0, 7, 14, 64, 1, 0, 200] + [rng.randint(0, 30) for _ in range(120)] + [0]
    data = [(i * 100, [i * 1000 + k for k in range(n)]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(data, "row_id BIGINT, ids ARRAY<INT>").repartition(partitions)
    df = df.withColumn("labels", F.transform("ids", lambda x: -x))
    blocks = tokenized.pack(df, max_len, ["ids", "labels"]).orderBy("block").collect()
    flat = [t for _, ids in data for t in ids]
    assert [b.block for b in blocks] == list(range(math.ceil(len(flat) / max_len)))
    assert [b.ids for b in blocks] == [
        flat[i : i + max_len] for i in range(0, len(flat), max_len)
    ]
    assert all(b.labels == [-t for t in b.ids] for b in blocks)
    for b in blocks:
        owners = [(t // 1000) * 100 for t in b.ids]
        assert [(e.row_id, e["size"]) for e in b.examples] == [
            (o, owners.count(o)) for o in sorted(set(owners))
        ]


def test_packing_one_long_row(spark):
    """Most tokens in one row: its pieces are spread, none is lost."""
    df = spark.createDataFrame([(1, [0] * 10), (2, list(range(100_000))), (3, [5])], "row_id BIGINT, ids ARRAY<INT>")
    blocks = tokenized.pack(df, 512, ["ids"])
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 100_011
    assert blocks.agg(F.max(F.size("ids"))).first()[0] == 512


def test_turn_pairs_across_stretches(spark, monkeypatch):
    from partforge.operators import projections

    monkeypatch.setattr(projections, "TURN_BITS", 2)
    roles = ["system", "user", "assistant", "user", "assistant", "user", "user", "assistant"]
    roles += ["assistant", "user", "system", "assistant", "user", "assistant"]
    data = [(1, t, role, f"t{t}") for t, role in enumerate(roles)]
    data += [(2, t, role, f"u{t}") for t, role in enumerate(roles) if t not in (4, 6)]
    df = spark.createDataFrame(data, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    seen = {(c, t): (role, text) for c, t, role, text in data}
    want = {
        (c, t, text, seen[(c, t + 1)][1])
        for (c, t), (role, text) in seen.items()
        if role == "user" and seen.get((c, t + 1), ("",))[0] == "assistant"
    }
    got = [tuple(r) for r in turn_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_to_pairs(spark, rows):
    df = spark.createDataFrame([(1, "cat", "cube(1);")], "row_id INT, name STRING, code STRING")
    pairs = to_pairs(df, "make", "helper")
    assert rows(pairs) == [(1, "hey helper, make me a cat", "cube(1);")]


def test_losses(spark):
    log = [
        (1, [-1.0, -2.0], [0, 1]),
        (1, [-3.0], [1]),
        (2, [-1.0], [0]),
        (3, [-4.0, -6.0], [1, 1]),
    ]
    df = spark.createDataFrame(log, "step INT, logprobs ARRAY<DOUBLE>, weights ARRAY<INT>")
    loss = stats.step_loss(df)
    assert {r.step: r.loss for r in loss.collect()} == {1: 2.5, 2: None, 3: 5.0}
    means = {r.epoch: r.mean_loss for r in stats.epoch_loss(loss, 2).collect()}
    assert means == {1: 2.5, 2: 5.0}


def test_token_stats_and_longest(spark):
    df = spark.createDataFrame([(3, 5), (1, 9), (2, 9)], "row_id INT, n_tokens INT")
    s = stats.token_stats(df, 5).first()
    assert tuple(s) == (3, 23, 23 / 3, 9, 2)
    assert stats.longest(df).first().row_id == 1
    assert stats.over_limit(df, 5).count() == 2
