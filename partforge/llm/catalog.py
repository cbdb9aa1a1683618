"""Queries op1 to op13 over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partforge.llm import (
    bpe_transducer,
    chat_bytes,
    curve_packing,
    exact_dedup,
    language_mixture,
    merkle,
    nb_svm,
    ngram_join,
    prefix_trie,
    range_coder,
    rule_forest,
    url_rules,
    warc,
)
from partforge.llm.staging import staged
from partforge.session import shared_folder

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT)
           >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
""")
def op1_warc(spark, sf_dir):
    """Every page archived, and read back from the archive."""
    folder = shared_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages.select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload")), folder)
    return warc.read_archive(spark, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""")
def op4_exact_dedup(spark, sf_dir):
    """The decision for every document."""
    return exact_dedup.dedup_decisions(table(spark, sf_dir, "documents"))


# Host, path and verdict of the listed rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query()
def op5_url_filter(spark, sf_dir):
    """The verdict on every page's URL."""
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


@query()
def op2_range_coder(spark, sf_dir):
    """Every document's ids, written in compressed blocks and read back."""
    path = shared_folder(spark, "ids")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    range_coder.write_ids(table(spark, sf_dir, "documents"), path, tokenizer, end=1, vocabulary=49_408)
    return range_coder.read_ids(spark, path, with_ids=False)


@query()
def op6_curve_packing(spark, sf_dir):
    """Every document's ids, packed along the curve."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return curve_packing.pack(table(spark, sf_dir, "documents"), tokenizer, end=0, with_ids=False)


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')
                || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""")
def op7_chat_format(spark, sf_dir):
    """Every conversation, and one that quotes the template, formatted and read back."""
    quoted = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(added.columns).unionByName(added)
    return chat_bytes.read_conversations(staged(chat_bytes.format_turns(turns), "chats"))


@query()
def op10_bpe_transducer(spark, sf_dir):
    """Every document encoded and decoded again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_transducer.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


@query()
def op8_language_mixture(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    return language_mixture.identify(docs, language_mixture.learn_from(docs))


@query()
def op9_rule_forest(spark, sf_dir):
    """The rules' statistics of every document, and the verdict."""
    return rule_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s
), i AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, i.y FROM r JOIN i ON r.other = i.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)
""")
def op3_ngram_join(spark, sf_dir):
    """The component of every document among links of 0.9 over three-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query("""
WITH RECURSIVE n AS (
  SELECT doc_id, lang, crc32_7, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents JOIN (
    SELECT doc_id AS c_id, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)),
      lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) ) AS crc, xor(crc, 4294967295) % 7 AS crc32_7
    FROM documents GROUP BY doc_id
  ) ON doc_id = c_id
), d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i FROM (
    SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
      CASE WHEN crc32_7 = 0 AND n_chars IS NOT NULL
        THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS tampered FROM n)
), u AS (
  SELECT 0 AS l, lang, i, leaf AS h FROM d
  UNION ALL
  SELECT l + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM u) WHERE n > 1 GROUP BY l, lang, i // 2
), s AS (
  SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i
  FROM (SELECT lang, arg_max(h, l) AS h, max(l) AS l FROM u GROUP BY lang)
), t AS (
  SELECT 0 AS l, i, subroot AS h FROM s
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM t) WHERE n > 1 GROUP BY l, i // 2
), f AS (
  SELECT d.doc_id, d.lang, d.i, 0 AS l, '' AS proof, coalesce(tampered, leaf) AS h FROM d
  UNION ALL
  SELECT f.doc_id, f.lang, f.i, f.l + 1, proof || coalesce(u.h, ''),
    sha256(CASE WHEN (f.i >> f.l) & 1 = 0 THEN f.h || coalesce(u.h, '') ELSE u.h || f.h END)
  FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.l < s.height
  LEFT JOIN u ON u.lang IS NOT DISTINCT FROM f.lang AND u.l = f.l AND u.i = xor(f.i >> f.l, 1)
), g AS (
  SELECT f.doc_id, f.lang, f.i, s.i AS k, 0 AS l, proof, h, subroot FROM f JOIN s
    ON f.lang IS NOT DISTINCT FROM s.lang AND f.l = s.height
  UNION ALL
  SELECT g.doc_id, g.lang, g.i, g.k, g.l + 1, proof || coalesce(t.h, ''),
    sha256(CASE WHEN (g.k >> g.l) & 1 = 0 THEN g.h || coalesce(t.h, '') ELSE t.h || g.h END), subroot
  FROM g LEFT JOIN t ON t.l = g.l AND t.i = xor(g.k >> g.l, 1) WHERE g.l < (SELECT max(l) FROM t)
)
SELECT g.doc_id, d.leaf, g.subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM g JOIN d ON g.lang IS NOT DISTINCT FROM d.lang AND g.i = d.i JOIN t r ON r.l = (SELECT max(l) FROM t)
WHERE g.l = (SELECT max(l) FROM t)
""")
def op11_merkle_manifest(spark, sf_dir):
    """The manifest of all documents, and what a check of each against its root says."""
    return merkle.checked_documents(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS p, h, bytes FROM (
    SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
      sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(
      list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)),
      lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), k AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) AS k, k + greatest(c.n - c.h, 0) AS size
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), r AS (
  SELECT k.conv_id, t.p AS d, t.h, t.bytes FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 5 AND t.p <= k.h
  UNION ALL
  SELECT k.conv_id, t.p - k.h + k.k, t.h, t.bytes FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h
), f AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS f, 0::BIGINT AS bytes FROM k
  UNION ALL
  SELECT r.conv_id, r.d, sha256(f.f || r.h), r.bytes FROM f JOIN r ON r.conv_id = f.conv_id AND r.d = f.d + 1
), g AS (SELECT f.*, k.size FROM f JOIN k USING (conv_id)),
n AS (
  SELECT d, f, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
  FROM g GROUP BY d, f
), e AS (
  SELECT n.*, a.f AS pf FROM n LEFT JOIN f a ON a.conv_id = n.conv_id AND a.d = n.d - 1
), m AS (
  SELECT e.*, coalesce(x.n_children, 0) AS n_children FROM e
  LEFT JOIN (SELECT d - 1 AS d, pf AS f, count(*) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2) x ON x.d = e.d AND x.f = e.f
), s AS (
  SELECT f.d, f.f, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved
  FROM m JOIN f ON f.conv_id = m.conv_id AND f.d <= m.d GROUP BY f.d, f.f
)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.f = m.f LEFT JOIN n p ON p.d = m.d - 1 AND p.f = m.pf
""")
def op13_prefix_trie(spark, sf_dir):
    """The trie of all conversations, rebuilt so that they share their starts."""
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


@query()
def op12_nb_svm(spark, sf_dir):
    """The quality of every document, learned from four fifths of the labelled ones."""
    return nb_svm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
