"""Token ids in blocks, compressed by context mixing and a range coder.

A block holds whole documents. Its ids are cut into lanes of equal length that are
coded side by side: step t codes the t-th id of every lane, so that the model and the
coder work on arrays, while every lane has a coder and bytes of its own. The model of
a block starts empty and learns from all lanes after each step:

- order 2 and order 1 each predict one id for a context, with a confidence;
- the mixer turns both confidences, and whether the predictions agree, into adaptive
  frequencies of "the id of order 2", "that of order 1" and "another one";
- another id is coded by order 0, adaptive frequencies of all ids.

The range coder has 64 bits and no carry: digits of 16 bits leave when they can no
longer change. A block ends with the CRC-32 of its ids, checked on reading.

Null text counts as empty, an empty document has no ids but those appended, and a
repeated doc_id is coded each time, in the order of its ids; a null doc_id comes first.
An empty table gives no blocks. Other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partforge.llm.staging import by_bytes, slices
from partforge.llm.units import unit_encoder

MAGIC = b"PFRC"
BLOCK_IDS = 1 << 20
MOST_LANES = 4096
STEPS = 192  # the least steps a block's lanes should have, for the model to learn
SCALE = 16  # bits of the total frequency of order 0
MIX = 12  # bits of the total frequency of the mixer
SURE = 3
CONFIDENCE = 1 << SURE
STATES = 2 * CONFIDENCE * CONFIDENCE  # of the mixer: both confidences, and whether the predictions agree
SAID = -CONFIDENCE  # the bits of an entry that hold the id predicted


def next_entries() -> list[np.ndarray]:
    """For order 2 and order 1, by kind and state, what becomes of an entry: SAID if the id predicted stays, and the
    next confidence. That of a wrong prediction is halved, that of a right one grows."""
    kind, two, one, same = np.indices((3, CONFIDENCE, CONFIDENCE, 2)).reshape(4, -1)
    return [
        (np.where(trust > 1, SAID, 0) | np.where(right, np.minimum(trust + 1, CONFIDENCE - 1), trust >> 1)).astype("i4")
        for trust, right in ((two, kind == 0), (one, (kind == 1) | (kind == 0) & (same == 1)))
    ]


NEXT_TWO, NEXT_ONE = next_entries()
HASHES = 1 << 18
LOWER = (1 << 32) - 1
TURNED = 16  # steps whose ids are laid side by side at once
REBUILD = 32  # steps between two rebuilds of order 0
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
DIGIT = np.uint64(16)
HIGH = np.uint64(48)
ONE = np.uint64(1)
TOP = np.uint64(1 << 48)  # the lowest digit that may leave
FLOOR = np.uint64(1 << 32)
NARROW = np.uint64(1 << 16)  # a range below FLOOR even a digit on


class Mixer:
    """The model of one block: what it says depends only on the ids coded before.

    Ids are moved up by SURE bits here, to be compared with entries as they are.
    """

    def __init__(self, lanes: int, vocabulary: int, reading: bool = False):
        self.vocabulary = vocabulary
        self.reading = reading
        self.one = np.zeros(vocabulary, np.int32)  # of a context, the id predicted times CONFIDENCE and the confidence
        self.two = np.zeros(HASHES, np.int32)
        self.kinds = np.ones((3, STATES), np.int64)
        self.start = np.zeros((3, STATES), np.int64)  # of the mixer's frequencies
        self.width = np.zeros((3, STATES), np.int64)
        self.zero = np.ones(vocabulary, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.hash = np.zeros(lanes, np.uint32)  # what the id before the last adds to the slot
        self.step = 0
        self.unseen: list[np.ndarray] = []
        self.rebuild()

    def rebuild(self) -> None:
        """Cumulative frequencies of order 0 in SCALE bits, at least 1 for every id."""
        spare = (1 << SCALE) - self.vocabulary
        total = np.cumsum(self.zero)
        total -= self.zero[0]
        most = max(1, int(total[-1]))
        total *= spare
        total //= most
        cumulative = np.arange(self.vocabulary + 1)
        cumulative[1:] += total
        widths = np.diff(cumulative)
        self.packed = widths << 32  # and starts, both in one place, to be looked up at once
        self.packed |= cumulative[:-1]
        if self.reading:
            self.owner = np.repeat(np.arange(self.vocabulary, dtype=np.uint16), widths)

    def look(self) -> None:
        """The predictions and frequencies for the next id of every lane."""
        last = self.last.astype(np.uint32)
        mixed = last * np.uint32(0x9E3779B1) + self.hash
        self.slot = (mixed >> np.uint32(7) & np.uint32(HASHES - 1)).astype(np.int64)
        self.hash = last * np.uint32(0x85EBCA6B)
        two, one = self.two.take(self.slot), self.one.take(self.last)
        self.p2, self.p1 = two & SAID, one & SAID
        two ^= self.p2
        one ^= self.p1
        state = two << SURE
        state |= one
        state <<= 1
        state |= self.p1 == self.p2
        self.state = state
        start, kinds = self.start, self.kinds
        start[1], start[2] = kinds[0], kinds[0] + kinds[1]
        total = start[2] + kinds[2]
        start[1:] *= (1 << MIX) - 3
        start[1:] //= total
        start[1:] += ((1,), (2,))
        self.width[:2] = self.start[1:]
        self.width[1] -= self.start[1]
        np.subtract(1 << MIX, self.start[2], out=self.width[2])

    def spot(self, missed: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The place by kind and state: order 2 is right, order 1 is (`missed`), or neither (`missed` and `other`)."""
        spot = (missed.view(np.int8) + other.view(np.int8)).astype(np.int32)
        spot *= STATES
        spot += self.state
        return spot.astype(np.int64)

    def learn(self, moved: np.ndarray, ids: np.ndarray, spot: np.ndarray, rare: np.ndarray) -> None:
        """Take in the next id of every lane, also `moved` up; `spot` is its place by kind and state, and `rare` are
        the ids that no order predicted."""
        self.kinds += np.bincount(spot, minlength=3 * STATES).reshape(3, STATES)
        for table, at, said, following in (
            (self.two, self.slot, self.p2, NEXT_TWO),
            (self.one, self.last, self.p1, NEXT_ONE),
        ):
            new = following.take(spot)
            entry = said ^ moved
            entry &= new
            entry ^= moved  # the id predicted where it stays, else that of the lane
            new &= CONFIDENCE - 1
            entry |= new
            table[at] = entry
        self.unseen.append(rare)
        self.last = ids
        self.step += 1
        if self.step % REBUILD == 0 or self.step & (self.step - 1) == 0:
            self.zero += 32 * np.bincount(np.concatenate(self.unseen), minlength=self.vocabulary)
            self.unseen = []
            self.rebuild()


class Coder:
    """Range coders side by side, one a lane: the interval [low, low + range) of 64 bits."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, FULL)

    def narrow(self, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Keep the part of the intervals that belongs to frequencies `start` to `start + width`."""
        self.range >>= np.uint64(bits)
        self.low += self.range * start.view(np.uint64)
        self.range *= width.view(np.uint64)

    def narrow_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        """The same for some of the lanes."""
        span = self.range.take(lanes) >> np.uint64(bits)
        self.low[lanes] += span * start.view(np.uint64)
        self.range[lanes] = span * width.view(np.uint64)

    def settle(self) -> None:
        """Move digits out until every interval is wide; one that spans a border of digits is cut off there."""
        low, span = self.low, self.range
        differ = low + span
        differ -= ONE
        differ ^= low
        settled, small = differ < TOP, span < FLOOR
        cut = np.flatnonzero(small > settled)
        if len(cut):
            span[cut] = np.minimum(span[cut], FLOOR - (low[cut] & (FLOOR - ONE)))
        more = differ < FLOOR  # the next digit is settled, too
        more |= span < NARROW
        more[cut] = True
        settled |= small
        self.move_all(settled)
        digits = settled.astype(np.uint64) * DIGIT
        low <<= digits
        span <<= digits
        lanes = np.flatnonzero(more)
        low, span = low[lanes], span[lanes]
        settled = (low ^ (low + span - ONE)) < TOP
        while len(lanes):
            if not settled.all():
                span = np.where(settled, span, np.minimum(span, FLOOR - (low & (FLOOR - ONE))))
            self.move(lanes, low)
            low, span = low << DIGIT, span << DIGIT
            self.low[lanes], self.range[lanes] = low, span
            settled = (low ^ (low + span - ONE)) < TOP
            left = np.flatnonzero(settled | (span < FLOOR))
            lanes, low, span, settled = lanes[left], low[left], span[left], settled[left]


class Writer(Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.lanes = lanes
        self.out = np.zeros(room * lanes, np.uint16)  # lanes are about as far, so they write side by side
        self.at = np.arange(lanes)

    def move_all(self, which: np.ndarray) -> None:
        """Write a digit of the lanes `which`; that of the others is written over later."""
        self.out[self.at] = (self.low >> HIGH).astype(np.uint16)
        self.at += which * np.int64(self.lanes)

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.out[self.at[lanes]] = low >> HIGH
        self.at[lanes] += self.lanes

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The digits of all lanes in a row, and how many each has."""
        for i in range(4):
            self.out[self.at] = (self.low >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF)
            self.at += self.lanes
        counts = self.at // self.lanes
        out = np.ascontiguousarray(self.out.reshape(-1, self.lanes)[: int(counts.max())].T)
        return out[np.arange(out.shape[1]) < counts[:, None]], counts


class Reader(Coder):
    def __init__(self, digits: np.ndarray, counts: np.ndarray):
        super().__init__(len(counts))
        self.digits = np.append(digits, np.uint16(0))  # the last lane may look behind its end
        self.at = np.cumsum(counts) - counts
        self.code = np.zeros(len(counts), np.uint64)
        for _ in range(4):
            self.code = (self.code << DIGIT) | self.digits[self.at]
            self.at += 1

    def move_all(self, which: np.ndarray) -> None:
        """Read a digit of the lanes `which`."""
        self.code <<= which.astype(np.uint64) * DIGIT
        self.code |= self.digits.take(self.at) * which
        self.at += which

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.code[lanes] = (self.code[lanes] << DIGIT) | self.digits[self.at[lanes]]
        self.at[lanes] += 1

    def kind(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the next symbol of each lane lies at one of two frequencies or behind it."""
        span, past = self.range >> np.uint64(MIX), self.code - self.low
        return past >= span * first.view(np.uint64), past >= span * second.view(np.uint64)

    def target(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        """Where in the total frequency the next symbol of some lanes lies."""
        span = self.range.take(lanes) >> np.uint64(bits)
        found = (self.code.take(lanes) - self.low.take(lanes)) // span
        return np.minimum(found, np.uint64((1 << bits) - 1)).astype(np.int64)


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids; the last lane may end early."""
    lanes = max(1, min(MOST_LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids: header, digits a lane, digits, CRC-32. Ids must be below `vocabulary` and that below 2^16."""
    n = len(ids)
    if vocabulary > 1 << SCALE or (n and int(ids.max()) >= vocabulary):
        raise ValueError(f"ids must be below the vocabulary of {vocabulary}, and that at most {1 << SCALE}")
    lanes, steps = shape(n)
    # lane j has the ids from j * steps on: neighbours in a lane are neighbours in the text
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps)
    mixer, writer = Mixer(lanes, vocabulary), Writer(lanes, 4 * steps + 8)
    for t in range(steps):
        if t % TURNED == 0:
            turned = np.ascontiguousarray(grid[:, t : t + TURNED].T).astype(np.int64)
        now = turned[t % TURNED]
        moved = now.astype(np.int32) << SURE
        mixer.look()
        missed = mixer.p2 != moved
        other = mixer.p1 != moved
        other &= missed
        spot = mixer.spot(missed, other)
        writer.narrow(mixer.start.take(spot), mixer.width.take(spot), MIX)
        lanes_left = np.flatnonzero(other)
        rare = now.take(lanes_left)
        if len(rare):
            both = mixer.packed.take(rare)
            writer.narrow_some(lanes_left, both & LOWER, both >> 32, SCALE)
        writer.settle()
        mixer.learn(moved, now, spot, rare)
    digits, counts = writer.finish()
    head = struct.pack("<4sIIII", MAGIC, n, lanes, vocabulary, zlib.crc32(np.ascontiguousarray(ids, "<u4")))
    return head + counts.astype("<u4").tobytes() + digits.astype("<u2").tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block, checked; a damaged one is a ValueError."""
    try:
        return decoded_block(block)
    except (IndexError, struct.error) as wrong:
        raise ValueError("a block of token ids is damaged") from wrong


def decoded_block(block: bytes) -> np.ndarray:
    magic, n, lanes, vocabulary, crc = struct.unpack_from("<4sIIII", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    counts = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    reader = Reader(np.frombuffer(block, "<u2", offset=20 + 4 * lanes), counts)
    steps = -(-n // lanes)
    grid, mixer = np.zeros((steps, lanes), np.uint32), Mixer(lanes, vocabulary, reading=True)
    for t in range(steps):
        mixer.look()
        state = mixer.state.astype(np.int64)
        missed, other = reader.kind(mixer.start[1].take(state), mixer.start[2].take(state))
        spot = mixer.spot(missed, other)
        reader.narrow(mixer.start.take(spot), mixer.width.take(spot), MIX)
        moved = np.where(missed, mixer.p1, mixer.p2)
        now = (moved >> SURE).astype(np.int64)
        lanes_left = np.flatnonzero(other)
        rare = mixer.owner.take(reader.target(lanes_left, SCALE)).astype(np.int64)
        if len(rare):
            both = mixer.packed.take(rare)
            reader.narrow_some(lanes_left, both & LOWER, both >> 32, SCALE)
            now[lanes_left], moved[lanes_left] = rare, rare << SURE
        reader.settle()
        grid[t] = now
        mixer.learn(moved, now, spot, rare)
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != crc:
        raise ValueError("a block of token ids does not match its checksum")
    return ids


FRAMES = pa.schema([
    ("part", pa.int64()), ("number", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block", pa.binary()),
])


def frames(part: int, documents: Iterable[tuple[int | None, np.ndarray]], vocabulary: int,
           target: int = BLOCK_IDS) -> Iterator[pa.RecordBatch]:
    """Documents in blocks of at least `target` ids, the last one shorter; a document is never cut."""
    first = number = 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def frame() -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in held])
        row = {"part": part, "number": number, "first": first, "n_ids": len(ids),
               "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held],
               "block": encode_block(ids, vocabulary) if len(ids) else b""}
        return pa.RecordBatch.from_pylist([row], FRAMES)

    for doc_id, ids in documents:
        held.append((doc_id, ids))
        size += len(ids)
        if size >= target:
            yield frame()
            first, number, held, size = first + size, number + 1, [], 0
    if held:
        yield frame()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, vocabulary: int,
              target: int = BLOCK_IDS) -> None:
    """Encode the texts of `docs` (doc_id, text) and write their ids in ascending doc_id order to `path`.

    Parts are ranges of doc_id; a row of a file is one block with the ids and lengths of its documents.
    """

    def encoded(batches):
        from pyspark import TaskContext

        encoder = unit_encoder(tokenizer, False)

        def documents():
            for whole in batches:
                for batch in by_bytes(whole):
                    texts = [x or "" for x in batch.column(1).to_pylist()]
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                        yield doc_id, np.append(ids, np.uint32(end))

        yield from frames(TaskContext.get().partitionId(), documents(), vocabulary, target)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, number long, first long, n_ids long, doc_ids array<long>, lengths array<long>, block binary"
    ordered.mapInArrow(encoded, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, from the files at `path`.

    Ids and checksums are those of unsigned little-endian 32-bit integers.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))  # one row a part
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    placed = blocks.join(starts, "part").select(
        (F.col("part_start") + F.col("first")).alias("start"), "doc_ids", "lengths", "block"
    )
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decoded(batches):
        for batch in slices(batches, 1):
            start, doc_ids, lengths, block = (batch.column(i)[0].as_py() for i in range(4))
            ids = decode_block(block) if block else np.zeros(0, np.uint32)
            ends = np.cumsum(lengths)
            pieces = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                *[pa.array(pieces, pa.binary())] * with_ids,
            ], columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.mapInArrow(decoded, schema)
