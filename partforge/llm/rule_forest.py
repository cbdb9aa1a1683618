"""Quality rules: fixed limits, and an isolation forest over the rules' statistics.

The statistics of every whole text are counted exactly. Two limits fail a document
outright. An isolation forest isolates unusual combinations of word lengths, symbols and
capitals. The ratios of repeated lines and words are left out of it: with them, the
threshold that lets good documents pass lets nearly all labelled bad ones pass as well
(figures in README). `n_dup_lines` is thus reported but has no say in a verdict;
repeated words have theirs by the limit. The trees split at random, and a document that is alone after few splits is anomalous. The trees
are grown on at most `TREES * SAMPLE` rows, those with the smallest hash among the
labelled ones; the threshold is the anomaly score that best tells labelled good rows
from labelled bad ones over all labelled rows while letting pass `KEEP_GOOD` of the good ones.

A word is `[^\\x20\\x09-\\x0D]+`. Null and empty text has no words and fails. Without labelled
rows of both kinds only the limits decide. Repeated rows are judged each, other columns
play no part, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import slices, staged

TREES = 64
SAMPLE = 256
BINS = 2000
KEEP_GOOD = 0.995
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper"]
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUING = bytes(b for b in range(256) if not 0x80 <= b <= 0xBF)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    m = len(numbers)
    if m > 2_000_000:  # three numbers no longer fit 63 bits: number the pairs first
        _, pairs = np.unique(at[:-1] * m + at[1:], return_inverse=True)
        windows = pairs[:-1] * m + at[2:]
    else:
        windows = (at[:-2] * m + at[1:-1]) * m + at[2:]
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    same = sorted_windows[1:] == sorted_windows[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in STATISTICS and EXTRA."""
    data = (text or "").encode()
    words = data.split()  # of bytes: at exactly the six ASCII blanks
    chars = sum(map(len, words)) - len(data.translate(None, CONTINUING))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words), chars, len(data.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(data.translate(None, NOT_UPPER)),
    )


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest looks at: ratios, so that length alone is no anomaly."""
    words, chars = np.maximum(counts[:, 0], 1.0), np.maximum(counts[:, 1], 1.0)
    symbols, upper = counts[:, 2], counts[:, 5]
    return np.stack([np.log(chars / words), np.log1p(symbols / words), symbols / chars, upper / chars], axis=1)


def add_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of `docs` (doc_id, text)."""

    def counted(batches):
        for batch in slices(batches):
            rows = np.array([statistics(x) for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], ["doc_id", *STATISTICS, *EXTRA])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in [*STATISTICS, *EXTRA])
    return docs.select("doc_id", "text").mapInArrow(counted, schema)


@dataclass
class Forest:
    """Trees as arrays: node k has the children 2k+1 and 2k+2; a leaf has the feature -1 and its expected depth."""

    feature: np.ndarray
    split: np.ndarray
    depth: np.ndarray
    threshold: float = 2.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1, the mean path length taken against that of a random tree."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, depth in zip(self.feature, self.split, self.depth, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += depth[node]
        return 2.0 ** (-total / len(self.feature) / usual_depth(SAMPLE))

    def keeps(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Failed the limits, kept, and the anomaly score, of rows of statistics."""
        base = failed(counts[:, 0], counts[:, 4])
        if not len(self.feature):
            return base, ~base, np.zeros(len(counts))
        scores = self.scores(features(counts))
        return base, ~base & (scores < self.threshold), scores


LEVELS = 8


def usual_depth(n: int) -> float:
    """The mean depth of a search that fails in a random binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int = 11) -> Forest:
    """Trees on samples of the rows, which come in no particular order."""
    rng, size = np.random.default_rng(seed), 2 ** (LEVELS + 1) - 1
    feature, split, depth = np.full((TREES, size), -1), np.zeros((TREES, size)), np.zeros((TREES, size))
    for tree in range(TREES):
        sample = rows[rng.permutation(len(rows))[:SAMPLE]]
        open_nodes = [(0, 0, sample)]
        while open_nodes:
            node, level, part = open_nodes.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == LEVELS or len(part) < 2 or not len(wide):
                depth[tree, node] = level + usual_depth(len(part))
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            at = high[f] if at <= low[f] else at
            feature[tree, node], split[tree, node] = f, at
            right = part[:, f] >= at
            open_nodes += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return Forest(feature, split, depth)


NO_FOREST = Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))


def scored_columns(forest: Forest, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = [*STATISTICS, *EXTRA]
    return forest.keeps(np.stack([batch.column(x).to_numpy() for x in names], axis=1).reshape(-1, len(names)))


def calibrated(counts: DataFrame, labels: DataFrame) -> Forest:
    """The forest and its threshold, from `counts` (add_statistics) and `labels` (doc_id, quality)."""
    spark = counts.sparkSession
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    known = staged(counts.join(good, "doc_id"), "labelled")
    # the rows with the least hashes; the bound keeps what each task sends on small
    share = min(1.0, 1.25 * TREES * SAMPLE / max(1, known.count()))
    place = F.xxhash64("doc_id")
    low = known.where(place <= int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else known
    sample = low.orderBy(place, "doc_id").limit(TREES * SAMPLE).select(*STATISTICS, *EXTRA).toPandas()
    if not len(sample):
        return NO_FOREST
    rows = sample.to_numpy(np.int64)
    rows = rows[~failed(rows[:, 0], rows[:, 4])]
    if not len(rows):
        return NO_FOREST
    forest = grow(features(rows))
    shared = spark.sparkContext.broadcast(forest)

    def binned(batches):
        held = np.zeros((2, BINS), np.int64)
        for batch in batches:
            base, _, scores = scored_columns(shared.value, batch)
            label = (batch.column("good").to_numpy() > 0).astype(int)
            at = np.minimum((scores * BINS).astype(int), BINS - 1)
            np.add.at(held, (label[~base], at[~base]), 1)
        label, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(held[label, at])], ["good", "bin", "n"])

    found = known.mapInArrow(binned, "good long, bin long, n long").groupBy("good", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((2, BINS))
    for good_row, at, n in found.collect():  # two times BINS rows at most
        table[good_row, at] = n
    if not table[0].sum() or not table[1].sum():
        return NO_FOREST
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1] / table.sum(axis=1, keepdims=True)  # share at or above each bin
    gain = np.where(above[1] <= 1 - KEEP_GOOD, above[0] - above[1], -1.0)
    best = int(np.argmax(gain))
    forest.threshold = best / BINS if gain[best] > 0 else 2.0
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATISTICS, base_failed, kept and anomaly of every row of `docs` (doc_id, text)."""
    counts = staged(add_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(calibrated(counts, labels))

    def judged(batches):
        for batch in batches:
            base, kept, scores = scored_columns(shared.value, batch)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in ("doc_id", *STATISTICS)], pa.array(base), pa.array(kept), pa.array(scores)],
                ["doc_id", *STATISTICS, "base_failed", "kept", "anomaly"],
            )

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS)
    return counts.mapInArrow(judged, schema + ", base_failed boolean, kept boolean, anomaly double")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    counts = staged(add_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(calibrated(counts, labels))
    at = docs.columns.index("text")

    def filtered(batches):
        for batch in slices(batches):
            rows = np.array([statistics(x) for x in batch.column(at).to_pylist()], np.int64)
            yield batch.filter(pa.array(shared.value.keeps(rows)[1]))

    return docs.mapInArrow(filtered, docs.schema)
