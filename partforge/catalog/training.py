"""Chats, tokens, packing, batches and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.catalog.registry import query, table
from partforge.functions.chat import render_chat, render_prompt, to_messages
from partforge.functions.tokens import SuppliedTokenizer, WordTokenizer
from partforge.operators import ordering, stats, tokenized
from partforge.operators.projections import to_pairs, turn_pairs
from partforge.plans.prepare import MASKED, SHIFTED, batched_epochs, packed_blocks, prepare_job, prepare_sources
from partforge.session import shared_folder
from partforge.sources.datasets import exact_path, read_many, read_sources, write_prepared

SEED = 3407
N_EPOCHS = 3
BATCH = 32
BLOCK = 512
LIMIT = 100

# Ids that SQL can compute as well: the length of the word.
LENGTHS = WordTokenizer(F.length)


def _text(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


# --- sources ------------------------------------------------------------------------------


@query(
    """SELECT doc_id AS row_id, 'documents' AS source, text AS code FROM documents
       UNION ALL SELECT (SELECT count(*) FROM documents) + item_id, 'benchmark', text
       FROM benchmark"""
)
def concatenated_sources(spark, sf_dir):
    return _sources(spark, sf_dir)


def _sources(spark, sf_dir) -> DataFrame:
    names = ["documents", "not_there", "benchmark"]
    paths = {name: f"{sf_dir}/{name}.parquet" for name in names}
    return read_many(spark, paths, columns=[F.col("text").alias("code")])


@query(
    """WITH s AS (SELECT 'documents' AS source FROM documents
          UNION ALL SELECT 'benchmark' FROM benchmark)
        SELECT source, grouping(source) = 1 AS overall, count(*) AS examples
        FROM s GROUP BY ROLLUP (source)"""
)
def rows_per_source(spark, sf_dir):
    return stats.source_counts(_sources(spark, sf_dir))


@query(
    """WITH d AS (SELECT count(*) AS n FROM documents), b AS (SELECT count(*) AS n FROM benchmark)
       SELECT 'documents' AS source, NULL AS stage, n AS examples, 0 AS first_id, n - 1 AS last_id FROM d
       UNION ALL SELECT 'benchmark', NULL, b.n, d.n, d.n + b.n - 1 FROM d, b
       UNION ALL VALUES ('not_there', 'listing', NULL, NULL, NULL), ('broken', 'footers', NULL, NULL, NULL),
         ('empty', 'schema', NULL, NULL, NULL)"""
)
def sources_with_corrupt(spark, sf_dir):
    """Sources of which some cannot be read: the rows of the others, and why and when each failed."""
    folder = shared_folder(spark, "sources")
    table(spark, sf_dir, "documents").select("text").write.parquet(f"{folder}/sound [1]")
    table(spark, sf_dir, "documents").select("text").limit(9).write.text(f"{folder}/broken")
    spark.range(0).withColumn("k", F.col("id")).write.partitionBy("k").parquet(f"{folder}/empty")  # no file
    paths = {
        "not_there": f"{folder}/not_there",
        "documents": exact_path(f"{folder}/sound [1]"),
        "broken": f"{folder}/broken",
        "empty": f"{folder}/empty",
        "benchmark": f"{sf_dir}/benchmark.parquet",
    }
    found = read_sources(spark, paths, columns=["text"])
    counts = found.rows.groupBy("source").agg(
        F.count("*").alias("examples"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id")
    )
    return counts.unionByName(found.rejects.select("source", "stage"), allowMissingColumns=True)


# --- chats --------------------------------------------------------------------------------

PAIRS_SQL = """p AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""

_HEADER = "'<|start_header_id|>{}<|end_header_id|>' || chr(10) || chr(10)"
_EOT = "'<|eot_id|>'"
PROMPT_SQL = f"{_HEADER.format('user')} || input || {_EOT} || {_HEADER.format('assistant')}"
CHAT_SQL = f"{PROMPT_SQL} || output || {_EOT}"


def pairs(spark, sf_dir) -> DataFrame:
    return turn_pairs(table(spark, sf_dir, "conversations"))


def _messages() -> Column:
    return to_messages(F.col("input"), F.col("output"))


@query(f"WITH {PAIRS_SQL} SELECT * FROM p")
def instruction_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(
    "SELECT doc_id, 'hey assistant, create me a ' || source AS input, text AS output FROM documents"
)
def source_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return to_pairs(
        docs.select("doc_id", F.col("source").alias("name"), F.col("text").alias("code"))
    )


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, {CHAT_SQL} AS text FROM p")
def rendered_chats(spark, sf_dir):
    text = render_chat(_messages())
    return pairs(spark, sf_dir).select("conv_id", "turn", text.alias("text"))


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, {PROMPT_SQL} AS text FROM p")
def rendered_prompts(spark, sf_dir):
    text = render_prompt(F.slice(_messages(), 1, 1))
    return pairs(spark, sf_dir).select("conv_id", "turn", text.alias("text"))


# --- tokens -------------------------------------------------------------------------------

_WORDS = "regexp_extract_all({}, '[^ \t\n\r\f\x0b]+')"
_LENGTHS = "list_transform(" + _WORDS + ", lambda w: length(w))"
COUNTED_SQL = f"""{PAIRS_SQL},
    c AS (SELECT *, conv_id * 1000 + turn AS row_id,
            len({_WORDS.format("input || chr(10) || output")}) AS n_tokens FROM p)"""


def counted(spark, sf_dir) -> DataFrame:
    row_id = F.col("conv_id") * 1000 + F.col("turn")
    return tokenized.n_tokens(pairs(spark, sf_dir).withColumn("row_id", row_id))


@query(
    f"""SELECT doc_id, len({_WORDS.format("text")}) AS n,
        array_to_string({_LENGTHS.format("text")}, ',') AS ids FROM documents"""
)
def encoded_texts(spark, sf_dir):
    ids = LENGTHS.ids(F.col("text")).alias("ids")
    encoded = table(spark, sf_dir, "documents").select("doc_id", ids)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n"), _text("ids"))


@query(
    f"""SELECT conv_id, turn, len({_WORDS.format("text")}) AS n,
        array_to_string({_LENGTHS.format("text")}, ',') AS ids FROM conversations"""
)
def encoded_by_supplied(spark, sf_dir):
    """The same ids from a tokenizer that the caller supplies as Python code."""
    supplied = SuppliedTokenizer(lambda: lambda text: [len(word) for word in text.split()])
    encoded = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        supplied.ids(F.col("text")).alias("ids"),
        supplied.count(F.col("text")).cast("bigint").alias("n"),
    )
    return encoded.select("conv_id", "turn", "n", _text("ids"))


@query(
    f"""WITH {COUNTED_SQL} SELECT count(*) AS examples, sum(n_tokens)::BIGINT AS total_tokens,
        round(avg(n_tokens), 6) AS mean_tokens, max(n_tokens) AS max_tokens,
        count(*) FILTER (n_tokens > {LIMIT}) AS over_limit FROM c"""
)
def token_statistics(spark, sf_dir):
    summary = stats.token_stats(counted(spark, sf_dir), LIMIT)
    return summary.withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    f"""WITH {COUNTED_SQL} SELECT row_id, n_tokens, input, length(output) AS chars,
        len({_WORDS.format("output")}) AS output_tokens
        FROM c ORDER BY n_tokens DESC, row_id LIMIT 1"""
)
def longest_example(spark, sf_dir):
    top = stats.longest(counted(spark, sf_dir))
    return top.select(
        "row_id",
        "n_tokens",
        "input",
        F.length("output").alias("chars"),
        LENGTHS.count(F.col("output")).alias("output_tokens"),
    )


@query(f"WITH {COUNTED_SQL} SELECT conv_id, turn, n_tokens FROM c WHERE n_tokens > {LIMIT}")
def examples_over_limit(spark, sf_dir):
    return stats.over_limit(counted(spark, sf_dir), LIMIT).select("conv_id", "turn", "n_tokens")


@query(
    f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, {_LENGTHS.format(CHAT_SQL)} AS f,
          len({_WORDS.format(PROMPT_SQL)}) AS n FROM p)
        SELECT conv_id, turn, array_to_string(f[:-2], ',') AS input_tokens,
          array_to_string(f[2:], ',') AS target_tokens,
          array_to_string(list_transform(range(2, greatest(len(f), n) + 1),
            lambda i: CASE WHEN i <= n THEN 0 ELSE 1 END), ',') AS weights
        FROM t"""
)
def shifted_data(spark, sf_dir):
    data = tokenized.to_datum(tokenized.encode_pairs(pairs(spark, sf_dir), LENGTHS))
    return data.select(
        "conv_id", "turn", _text("input_tokens"), _text("target_tokens"), _text("weights")
    )


MASKED_SQL = f"""{PAIRS_SQL}, t AS (SELECT conv_id, turn,
      {_LENGTHS.format(_HEADER.format("user"))} AS h1, {_LENGTHS.format("input || " + _EOT)} AS b1,
      {_LENGTHS.format(_HEADER.format("assistant"))} AS h2,
      {_LENGTHS.format("output || " + _EOT)} AS b2
      FROM p),
    m AS (SELECT conv_id, turn, h1 || b1 || h2 || b2 AS input_ids,
      list_transform(h1 || b1 || h2, lambda x: -100) || b2 AS labels FROM t)"""


@query(
    f"""WITH {MASKED_SQL} SELECT conv_id, turn, array_to_string(input_ids, ',') AS input_ids,
        array_to_string(labels, ',') AS labels FROM m"""
)
def masked_labels(spark, sf_dir):
    chats = pairs(spark, sf_dir).withColumn("messages", _messages())
    masked = tokenized.mask_labels(chats, tokenizer=LENGTHS)
    return masked.select("conv_id", "turn", _text("input_ids"), _text("labels"))


@query(
    f"""WITH {MASKED_SQL} SELECT conv_id, turn, array_to_string(list_transform(labels,
        lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ',') AS shown FROM m"""
)
def unmasked_view(spark, sf_dir):
    chats = pairs(spark, sf_dir).withColumn("messages", _messages())
    masked = tokenized.mask_labels(chats, tokenizer=LENGTHS)
    shown = masked.withColumn("shown", tokenized.unmask_view(F.col("labels"), 0))
    return shown.select("conv_id", "turn", _text("shown"))


# --- packing and batches ------------------------------------------------------------------

PACKED_SQL = """
    o AS (SELECT row_id, ids, sum(len(ids)) OVER (ORDER BY row_id) - len(ids) AS start FROM s),
    u AS (SELECT row_id, start + unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM o),
    b AS (SELECT (pos // {block})::BIGINT AS block, pos, row_id, id FROM u),
    e AS (SELECT block, row_id, count(*) AS n FROM b GROUP BY ALL),
    x AS (SELECT block, string_agg(row_id || ':' || n, ',' ORDER BY row_id) AS examples
          FROM e GROUP BY block)
    SELECT block, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, any_value(examples)
      AS examples FROM b JOIN x USING (block) GROUP BY block"""


def _block_text(blocks: DataFrame, ids: str) -> DataFrame:
    members = F.transform("examples", lambda e: F.concat_ws(":", e["row_id"], e["size"]))
    return blocks.select(
        "block",
        F.size(ids).cast("bigint").alias("n"),
        F.array_join(F.col(ids).cast("array<string>"), ",").alias("ids"),
        F.array_join(members, ",").alias("examples"),
    )


@query(
    f"WITH s AS (SELECT doc_id AS row_id, {_LENGTHS.format('text')} AS ids FROM documents),"
    + PACKED_SQL.format(block=BLOCK)
)
def packed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), LENGTHS.ids(F.col("text")).alias("ids")
    )
    folder = shared_folder(spark, "encoded")
    write_prepared(docs, folder)
    return _block_text(tokenized.pack(spark.read.parquet(folder), BLOCK, ["ids"]), "ids")


ORDER_SQL = f"""r AS (SELECT doc_id AS row_id, epoch, row_number() OVER (PARTITION BY epoch
      ORDER BY md5('{SEED}-' || epoch || '-' || doc_id), doc_id) AS rank
    FROM documents, range(1, {N_EPOCHS + 1}) t(epoch))"""


@query(
    f"""WITH {ORDER_SQL} SELECT row_id, epoch::INT AS epoch, rank,
        (rank - 1) // {BATCH} AS batch FROM r"""
)
def shuffled_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    order = ordering.shuffle_epochs(ordering.epochs(docs, N_EPOCHS), SEED)
    return ordering.assign_batches(order, BATCH)


@query(f"SELECT ceil(count(*) / {BATCH})::BIGINT AS steps FROM documents")
def steps_in_epoch(spark, sf_dir):
    return stats.steps_per_epoch(table(spark, sf_dir, "documents"), BATCH)


# --- losses -------------------------------------------------------------------------------

LOSS_SQL = """l AS (SELECT l_orderkey + 1 AS step, round(-sum(-(l_discount + l_tax) *
      (l_linenumber % 2)) / nullif(sum(l_linenumber % 2), 0), 6) AS loss
    FROM lineitem GROUP BY l_orderkey)"""


def losses(spark, sf_dir) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("step"),
        F.array(-(F.col("l_discount") + F.col("l_tax"))).alias("logprobs"),
        F.array(F.col("l_linenumber") % 2).alias("weights"),
    )
    return stats.step_loss(log).withColumn("loss", F.round("loss", 6))


@query(f"WITH {LOSS_SQL} SELECT step, loss FROM l")
def step_losses(spark, sf_dir):
    return losses(spark, sf_dir)


@query(
    f"""WITH {LOSS_SQL} SELECT (step - 1) // 313 + 1 AS epoch, round(avg(loss), 5) AS mean_loss
        FROM l GROUP BY 1"""
)
def epoch_losses(spark, sf_dir):
    means = stats.epoch_loss(losses(spark, sf_dir), 313)
    return means.withColumn("mean_loss", F.round("mean_loss", 5))


@query(f"WITH {LOSS_SQL} SELECT step, loss FROM l WHERE step % 100 = 0")
def checkpoints(spark, sf_dir):
    return ordering.checkpoint_steps(losses(spark, sf_dir), 100)


# --- the whole preparation ----------------------------------------------------------------


def _prepared(spark, sf_dir, *shapes: str):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("name"), F.col("text").alias("code")
    )
    out = shared_folder(spark, "prepared")
    return prepare_job(spark, docs, out, LENGTHS, token_limit=1000, shapes=shapes)


_SOURCE_SQL = """p AS (SELECT doc_id, 'hey assistant, create me a ' || source AS input,
    text AS output FROM documents)"""


@query(
    f"""WITH {_SOURCE_SQL}, c AS (SELECT len({_WORDS.format("input || chr(10) || output")}) AS n
          FROM p)
        SELECT count(*) AS examples, sum(n)::BIGINT AS total_tokens,
          round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens,
          count(*) FILTER (n > 1000) AS over_limit FROM c"""
)
def prepare_job_statistics(spark, sf_dir):
    summary = _prepared(spark, sf_dir).stats
    return summary.withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(
    f"""WITH {_SOURCE_SQL}, {ORDER_SQL},
        d AS (SELECT doc_id AS row_id, {_LENGTHS.format(CHAT_SQL)} AS f,
          len({_WORDS.format(PROMPT_SQL)}) AS n FROM p)
        SELECT epoch::INT AS epoch, row_id, (rank - 1) // {BATCH} AS batch,
          array_to_string(f[:-2], ',') AS input_tokens,
          greatest(len(f) - n, 0) AS learned
        FROM r JOIN d USING (row_id)"""
)
def prepare_job_batches(spark, sf_dir):
    batches = batched_epochs(spark, _prepared(spark, sf_dir, SHIFTED), N_EPOCHS, BATCH, SEED)
    learned = F.aggregate("weights", F.lit(0).cast("bigint"), lambda total, w: total + w)
    return batches.select(
        "epoch", "row_id", "batch", _text("input_tokens"), learned.alias("learned")
    )


@query(
    f"""WITH {_SOURCE_SQL},
        s AS (SELECT doc_id AS row_id, list_transform({_WORDS.format(_HEADER.format("user"))}
            || {_WORDS.format("input || " + _EOT)}
            || {_WORDS.format(_HEADER.format("assistant"))}, lambda w: -100)
            || {_LENGTHS.format("output || " + _EOT)} AS ids FROM p),
        {PACKED_SQL.format(block=4096)}"""
)
def prepare_job_blocks(spark, sf_dir):
    return _block_text(packed_blocks(spark, _prepared(spark, sf_dir, MASKED), 4096), "labels")


def _load_lengths():
    return lambda text: [len(word) for word in text.replace("\n", " ").split(" ") if word]


@query(
    f"""WITH {_SOURCE_SQL},
        d AS (SELECT doc_id AS row_id, {_LENGTHS.format(CHAT_SQL)} AS f,
          len({_WORDS.format(PROMPT_SQL)}) AS n, len({_WORDS.format("input || chr(10) || output")}) AS n_tokens,
          list_transform({_WORDS.format(_HEADER.format("user"))} || {_WORDS.format("input || " + _EOT)}
            || {_WORDS.format(_HEADER.format("assistant"))}, lambda w: -100)
            || {_LENGTHS.format("output || " + _EOT)} AS labels FROM p)
        SELECT row_id, n_tokens, array_to_string(f[:-2], ',') AS input_tokens,
          greatest(len(f) - n, 0) AS learned, array_to_string(labels, ',') AS labels FROM d"""
)
def prepare_job_supplied(spark, sf_dir):
    """The stored examples of a tokenizer in Python, which sees each row once."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("name"), F.col("text").alias("code")
    )
    done = prepare_job(spark, docs, shared_folder(spark, "prepared"), SuppliedTokenizer(_load_lengths))
    learned = F.aggregate("weights", F.lit(0).cast("bigint"), lambda total, w: total + w)
    return spark.read.parquet(done.examples).select(
        "row_id", "n_tokens", _text("input_tokens"), learned.alias("learned"), _text("labels")
    )


@query(
    f"""WITH s AS (
          SELECT doc_id AS row_id, 'documents' AS source, source AS name, text AS code FROM documents
          UNION ALL SELECT (SELECT count(*) FROM documents) + item_id, 'benchmark', NULL, text FROM benchmark),
        p AS (SELECT row_id, source, 'hey assistant, create me a ' || coalesce(name, source) AS input, code AS output
              FROM s)
        SELECT row_id, source, len({_WORDS.format("input || chr(10) || output")}) AS n_tokens,
          array_to_string(({_LENGTHS.format(CHAT_SQL)})[:-2], ',') AS input_tokens FROM p"""
)
def prepare_job_sources(spark, sf_dir):
    """Examples of two sources and one that is not there."""
    folder = shared_folder(spark, "named")
    table(spark, sf_dir, "benchmark").withColumn("source", F.lit("benchmark")).write.parquet(folder)
    paths = {"documents": f"{sf_dir}/documents.parquet", "not_there": f"{sf_dir}/not_there", "benchmark": folder}
    columns = [F.col("source").alias("name"), F.col("text").alias("code")]
    done, found = prepare_sources(
        spark, paths, shared_folder(spark, "prepared"), columns, tokenizer=LENGTHS, shapes=(SHIFTED,)
    )
    stored = spark.read.parquet(done.examples).select("row_id", "n_tokens", _text("input_tokens"))
    return stored.join(found.rows.select("row_id", "source"), "row_id")


@query("SELECT doc_id, lang, text FROM documents")
def prepared_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "prepared")
    write_prepared(table(spark, sf_dir, "documents"), folder, ["lang"])
    return spark.read.parquet(folder).select("doc_id", "lang", "text")
