"""Language ID by mixture inference.

Hashed character trigrams are counted per language over all learning rows, and give the
likelihood of every trigram in every language. A document is a row of short segments,
each with its likelihood per language. Expectation-maximisation estimates how the
document's segments are shared among languages; the set of languages grows as long as a
further one raises the likelihood by more than a penalty for its parameter. The answer
is the language with the largest share, and the score that share, or the posterior of
the language where a single one is enough. A document of several languages counts as
identified if they explain it together, even if none of them has half of it.

Text without a letter, and null or empty text, is `und` with score 0; so is everything
if there is nothing to learn from. Ties go to the first language in alphabetical order.
Rows are judged one by one, so repeated rows and other columns change nothing, and an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import slices

BUCKETS = 1 << 15
SEGMENT = 64  # trigrams
ROUNDS = 12
PENALTY = 6.0  # log-likelihood that a further language has to gain, and half a log of the segments
TEMPER = 0.25  # neighbouring trigrams overlap, so a segment says less than the sum of its trigrams
LETTER = re.compile(r"[^\W\d_]")  # letters, and some signs for numbers


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category."""
    return any(found.group().isalpha() for found in LETTER.finditer(text))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram of bytes that starts at each position."""
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def document_buckets(text: str) -> np.ndarray:
    return trigram_buckets(np.frombuffer(f" {text} ".encode(), np.uint8))


def counted(learning: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of `learning` (text, lang); every task adds up before the shuffle."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(document_buckets(text), minlength=BUCKETS)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "bucket", "n"]
            )

    rows = learning.select("text", "lang").where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log-likelihoods of the buckets per language; their number is that of BUCKETS times the languages."""

    languages: list[str]
    log_p: np.ndarray

    def segments(self, text: str) -> np.ndarray:
        """Log-likelihood of each segment of a text in each language."""
        buckets = document_buckets(text)
        starts = np.arange(0, len(buckets), SEGMENT)
        return np.add.reduceat(self.log_p[buckets], starts, axis=0).astype(np.float64) * TEMPER

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged(text)[:2]

    def judged(self, text: str | None) -> tuple[str, float, float]:
        """The language and its score, and how well all languages found in the text are supported together.

        A single language has its posterior as support. Several ones have their posterior
        against text that is in no language, or the score if that is more.
        """
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, 0.0
        likelihood = self.segments(text)
        shares, posterior = mixture(likelihood)
        best = int(np.argmax(shares))
        alone = np.count_nonzero(shares) == 1
        score = float(np.clip(posterior[best] if alone else shares[best], 0.0, 1.0))
        return self.languages[best], score, score if alone else max(score, self.support(text, likelihood, shares))

    def support(self, text: str, likelihood: np.ndarray, shares: np.ndarray) -> float:
        """The posterior of a mixture against a text whose trigrams are all alike probable."""
        flat = -np.log(BUCKETS) * TEMPER * len(document_buckets(text))
        further = (np.count_nonzero(shares) - 1) * penalty(len(likelihood))
        return float(np.exp(-np.logaddexp(0.0, flat + further - explained(likelihood, shares))))


def shared_out(likelihood: np.ndarray, languages: list[int]) -> tuple[np.ndarray, float]:
    """Shares of a set of languages and the log-likelihood of the segments, by expectation-maximisation."""
    chosen = likelihood[:, languages]
    top = chosen.max(axis=1, keepdims=True)
    p = np.exp(chosen - top)
    shares = np.full(len(languages), 1 / len(languages))
    for _ in range(ROUNDS):
        joint = p * shares
        shares = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    return shares, float((np.log((p * shares).sum(axis=1)) + top[:, 0]).sum())


def explained(likelihood: np.ndarray, shares: np.ndarray) -> float:
    """The log-likelihood of the segments under these shares."""
    top = likelihood.max(axis=1, keepdims=True)
    chosen = shares > 0
    return float((np.log(np.exp(likelihood - top)[:, chosen] @ shares[chosen] + 1e-300) + top[:, 0]).sum())


def penalty(segments: int) -> float:
    """What a further language has to gain."""
    return PENALTY + 0.5 * np.log(segments)


def mixture(likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all languages in a document, and their posterior if it has one language only."""
    total = likelihood.sum(axis=0)
    posterior = np.exp(total - total.max())
    posterior /= posterior.sum()
    shares = np.zeros(likelihood.shape[1])
    chosen, value = [int(np.argmax(total))], total.max()
    least = penalty(len(likelihood))
    found = np.ones(1)
    reach = likelihood.max(axis=1).sum()  # no set of languages can do better
    while len(chosen) < len(shares) and reach - value > least:
        tried = [(*shared_out(likelihood, [*chosen, x]), x) for x in range(len(shares)) if x not in chosen]
        more, better, language = max(tried, key=lambda t: (t[1], -t[2]))
        if better - value <= least:
            break
        chosen, value, found = [*chosen, language], better, more
    shares[chosen] = found
    return shares, posterior


def learn(learning: DataFrame) -> Model:
    """The model of `learning` (text, lang): languages times BUCKETS counts come to the driver."""
    counts = counted(learning).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    table[counts["bucket"].to_numpy(np.int64), np.searchsorted(languages, counts["lang"])] = counts["n"]
    log_p = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)) if languages else table
    return Model(languages, log_p.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: a fixed quarter; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame) -> Model:
    return learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(batches):
        for batch in slices(batches):
            found = [shared.value.predict(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()),
                pa.array([y for _, y in found], pa.float64()),
            ], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(identified, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language, or languages together, have at least that support, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def filtered(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.judged(x) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x != "und" and y >= least_score for x, _, y in found], pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)
