"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes.

A text is the set of its byte n-grams of one to `ORDERS` bytes, in `BUCKETS` by hash; a word equal to the
word before it is written as one mark, so that repetition shows as an n-gram too. An
indicator weighs the log of the ratio of its smoothed shares in both classes (counted over all
labelled documents), and a document's vector has length one. On the vectors, dual coordinate
descent fits a hinge-loss model: one document's multiplier after the other takes the value that is
best for it, within its bounds. A logistic curve through the margins of documents that the
descent has not seen turns a margin into the probability of label 1.

The descent sees a bounded sample: at most `SAMPLE` labelled documents by the hash of their id, and
at most `MOST_INDICATORS` indicators of them together. Everything else covers all rows.

Null text counts as empty; an empty text has the score of the bias alone. A null doc_id is never
learned from and not held out; an id with labels of both kinds is not learned from. Repeated rows
are counted each time. Without labels, or with labels of one kind, the score is the smoothed share of
label 1. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.exact_dedup import maybe_in
from partforge.llm.staging import slices, staged

ORDERS = 3
BITS = 17
BUCKETS = 1 << BITS
STRETCH = 1 << 20  # bytes that are hashed at a time
SAMPLE = 8192
MOST_INDICATORS = 1 << 24
CALIBRATE = 4  # one sampled document in so many is kept for the curve
SMOOTH = 1.0
COST = 1.0
ROUNDS = 12
MARK = b"\x01"
THRESHOLD = 0.3
M1 = np.uint64(0x9E3779B97F4A7C15)


def marked(text: str) -> bytes:
    """The text with MARK for each word that equals the word before it."""
    words = text.encode().split(b" ")
    return b" ".join([MARK if w == v and w else w for v, w in zip([b"", *words], words)])


class Indicators:
    """The buckets of a text's n-grams, through one table that is used again."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, bool)

    def of(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer(marked(text or ""), np.uint8)
        for start in range(0, len(raw), STRETCH):
            part = raw[start : start + STRETCH + ORDERS - 1].astype(np.uint64)
            code = np.zeros(len(part), np.uint64)
            for order in range(ORDERS):
                code = (code[: len(part) - order] << np.uint64(8)) | part[order:]
                if not len(code):
                    break
                self.seen[((code * np.uint64(8) + np.uint64(order + 1)) * M1) >> np.uint64(64 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.uint32)


@dataclass
class Model:
    """What an indicator adds to the margin, its squared weight, the bias, and the curve of the margin."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(self.square[found].sum())
        return self.bias + (float(self.weight[found].sum()) / np.sqrt(length) if length > 0 else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(probability(self.slope * self.margin(found) + self.shift))


def probability(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The log of an indicator's share among those of class 1 over that of class 0."""
    p, q = positive + SMOOTH, negative + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int = ROUNDS,
            seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum of C_i max(0, 1 - y_i (w x_i + b)), C being higher for the rarer class."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = max(1, int((labels > 0).sum())), max(1, int((labels == 0).sum()))
    cost = np.where(labels > 0, COST * len(y) / (2 * share[0]), COST * len(y) / (2 * share[1]))
    vectors = []
    for found in rows:
        x = ratio[found]
        length = np.sqrt((x * x).sum())
        vectors.append(x / length if length > 0 else x * 0)
    squares = np.array([(x * x).sum() + 1 for x in vectors])  # 1 for the bias
    weight, bias, multiplier = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (weight[rows[i]] @ vectors[i] + bias) - 1
            new = min(max(multiplier[i] - gradient / squares[i], 0.0), cost[i])
            step = (new - multiplier[i]) * y[i]
            if step:
                weight[rows[i]] += step * vectors[i]
                bias += step
                worst = max(worst, abs(step))
                multiplier[i] = new
        if worst < 1e-3:
            break
    return weight, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, with smoothed targets, by Newton's method."""
    n1, n0 = int((labels > 0).sum()), int((labels == 0).sum())
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    x = np.stack([margins, np.ones(len(margins))], axis=1)

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - target * z).sum()) + 1e-6 * float(a @ a)

    for _ in range(50):
        p = probability(x @ at)
        slope = x.T @ (p - target) + 2e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def fitted(rows: list[np.ndarray], labels: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> Model:
    """The model of sampled indicators and their labels, and of the counts of all labelled documents."""
    ratio = log_ratios(positive, negative)
    kept = np.arange(len(rows)) % CALIBRATE == 0
    train, rest = np.flatnonzero(~kept), np.flatnonzero(kept)
    if len(set(labels[train].tolist())) < 2:
        share = (int((labels > 0).sum()) + 1) / (len(labels) + 2)
        none = np.zeros(BUCKETS, np.float32)
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    weight, bias = descend([rows[i] for i in train], labels[train], ratio)
    model = Model((weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in rest])
    model.slope, model.shift = curve(margins, labels[rest])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: a fixed fifth; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the ids that may be learned from and have one kind of label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    kinds = rows.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    return kinds.where("label = most").select("doc_id", (F.col("label") > 0).cast("int").alias("label"))


COUNTED = "bucket int, positive long, negative long, place long, label int, indicators binary"


def counted(known: DataFrame, bound: int) -> DataFrame:
    """Counts of indicators by class, a task at a time, and the indicators of documents with `place` up to `bound`."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        indicators, counts = Indicators(), np.zeros((2, BUCKETS), np.int64)
        names = [x.split()[0] for x in COUNTED.split(", ")]
        for batch in slices(batches):
            sampled = []
            rows = (batch.column(i).to_pylist() for i in range(3))
            for text, label, place in zip(*rows, strict=True):
                found = indicators.of(text)
                counts[1 - label, found] += 1
                if place <= bound:
                    sampled.append((place, label, found.astype("<u4").tobytes()))
            if sampled:
                place, label, found = (pa.array(x, t) for x, t in zip(zip(*sampled), (pa.int64(), pa.int32(), pa.binary())))
                empty = [pa.nulls(len(sampled), t) for t in (pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*empty, place, label, found], names)
        at = np.flatnonzero(counts.any(axis=0))
        rest = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *map(pa.array, counts[:, at]), *rest], names)

    return known.select("text", "label", "place").mapInArrow(count, COUNTED)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST_INDICATORS) -> Model:
    """The model of the labelled documents: BUCKETS counts and a bounded sample come to the driver."""
    known = staged(known_labels(labels), "known")
    total = known.count()
    # the sample's documents are those with the smallest hashes; the bound keeps what each task sends on small
    bound = (1 << 62) if total <= sample else int((1 << 62) * min(1.0, 1.25 * sample / total))
    rows = maybe_in(docs.select("doc_id", "text"), known, "doc_id", "maybe").where("maybe").join(known, "doc_id")
    place = F.shiftright(F.xxhash64("doc_id"), 1) + (1 << 62)  # from 0 to 2^63 - 1
    rows = staged(counted(rows.withColumn("place", F.shiftright(place, 1)), bound), "counted")
    sums = rows.where("bucket is not null").groupBy("bucket").agg(F.sum("positive"), F.sum("negative"))
    positive, negative = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, p, n in sums.toLocalIterator():  # no more than BUCKETS rows
        positive[bucket], negative[bucket] = p, n
    size = F.octet_length("indicators") / 4
    taken = rows.where("place is not null").select("place", "label", "indicators", size.alias("size"))
    taken = taken.orderBy("place", "label", "indicators").limit(sample)
    found, kinds, held = [], [], 0
    for row in taken.toLocalIterator():  # bounded by `sample` rows and `most` indicators
        held += row["size"]
        if held > most:
            break
        found.append(np.frombuffer(row["indicators"], "<u4"))
        kinds.append(row["label"])
    return fitted(found, np.array(kinds, np.int64), positive, negative)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in slices(batches):
            scores = np.array([shared.value.score(indicators.of(x)) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality of every document, learned from the labelled ones that are not held out."""
    return scored(docs, learn(docs, labels))
