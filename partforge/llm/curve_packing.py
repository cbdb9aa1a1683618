"""Packing along a space-filling curve: neighbours in meaning share a sequence.

A document's ids are hashed into a vector, the vector is projected to a few dimensions,
and its cell there gives a key on the Hilbert curve. Documents are range-sorted by that
key and laid into sequences one after another, cut wherever a sequence is full. Only the
end of a range is left over; it goes into sequences whose lengths are powers of two, so
that nothing is padded.

Null text counts as empty, and an empty document has the end id alone. Equal texts have
equal keys and are told apart by doc_id, so that a group of copies spreads over ranges;
a null doc_id comes first, and repeated rows are packed each. An empty table gives no
piece. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partforge.llm.staging import by_size, slices, staged
from partforge.llm.units import unit_encoder

HASHED = 64
DIMENSIONS = 4
BITS = 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position on the Hilbert curve of every row of integer coordinates below 2^bits."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the larger cells
        for i in range(len(x)):
            inside = (x[i] & q) > 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(inside, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis ^ turn) >> bit & 1
    return key


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """The curve key of every document's ids."""
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.uint32)
    mixed = ids * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    at = np.repeat(np.arange(len(documents)), lengths) * HASHED + (mixed >> np.uint32(26))
    sign = 1.0 - 2.0 * (mixed >> np.uint32(25) & np.uint32(1))
    vectors = np.bincount(at, sign, len(documents) * HASHED).reshape(-1, HASHED)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    axes = np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))
    even = 1 / (1 + np.exp(-1.702 * (vectors @ axes)))  # about evenly spread over 0 to 1
    return hilbert_keys(np.minimum(even * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def tail_lengths(rest: int) -> list[int]:
    """Powers of two that add up to `rest`, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


Piece = tuple[int | None, int, np.ndarray, int, int, int]


def cut(documents: Iterable[tuple[int | None, np.ndarray]], size: int) -> Iterator[Piece]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of documents laid end to end."""
    sequence, held = 0, []  # the pieces of a sequence that is not full yet, as the last one is laid anew
    used = 0
    for doc_id, ids in documents:
        start = 0
        while start < len(ids):
            take = min(size - used, len(ids) - start)
            held.append((doc_id, start, ids[start : start + take], len(ids), sequence, used))
            start, used = start + take, used + take
            if used == size:
                yield from held
                sequence, used, held = sequence + 1, 0, []
    for length in tail_lengths(used):
        left = length
        while left:
            doc_id, start, ids, total, _, _ = held[0]
            take = min(left, len(ids))
            yield doc_id, start, ids[:take], total, sequence, length - left
            held[0] = (doc_id, start + take, ids[take:], total, sequence, 0)
            if take == len(ids):
                held.pop(0)
            left -= take
        sequence += 1


def written(ids: np.ndarray) -> bytes:
    """How many bytes an id has, two if that is enough, and the ids."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 1024, with_ids: bool = True) -> DataFrame:
    """Every piece of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are unique; their order is that of the curve. `with_ids` adds the ids
    themselves, as unsigned little-endian 32-bit integers.
    """

    def keyed(batches):
        encoder = unit_encoder(tokenizer, True)
        for batch in chain.from_iterable(map(by_size, batches)):
            ids = [np.append(x, np.uint32(end)) for x in encoder.encode([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(curve_keys(ids)), pa.array(list(map(written, ids)), pa.binary()),
            ], ["doc_id", "key", "ids"])

    keys = staged(docs.select("doc_id", "text").mapInArrow(keyed, "doc_id long, key long, ids binary"), "curve")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def packed(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32

        def documents():
            for batch in slices(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    yield doc_id, np.frombuffer(ids, f"<u{ids[0]}", offset=1)

        rows: list[tuple] = []

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        types = [pa.int64()] * 7 + [pa.binary()] * with_ids
        for doc_id, start, ids, total, sequence, offset in cut(documents(), size):
            raw = ids.astype("<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw), total, first + sequence, offset)
            rows.append((*row, raw) if with_ids else row)
            if len(rows) == 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    ordered = keys.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ordered.mapInArrow(packed, schema + ", ids binary" * with_ids)
