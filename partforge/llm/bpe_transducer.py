"""Byte-level BPE as a transducer that reads bytes and emits tokens, and streaming decoding.

The merges say which two tokens may stand side by side: those that encoding their bytes
gives back. So each prefix of a piece has exactly one last token, and the prefixes form
a tree. Of a text read so far only those prefixes matter from which some token can still
reach past its end; whatever their branches have in common is final and is emitted. A
state of the transducer is thus the bytes behind the last emitted token, never more than the
longest token has, and the last tokens along the open branches. States and their transitions are made when they are first
needed, and forgotten together when there are too many.

Null text counts as empty and has no ids. Repeated rows are encoded each, an empty table
gives an empty result, and other columns play no part.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partforge.llm.staging import slices
from partforge.llm.units import UnitMemo, gather

MOST_STATES = 180_000
NONE = -2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class State:
    """What the transducer knows of a text: what is final, and what each open branch would add.

    `pending` has the bytes behind the last final token. `last` has the last token of each
    prefix of `pending`, NONE standing for those on no open branch, and `open` the prefixes
    from which a token can still reach on. The first prefix is empty: its last token is the
    last final one, which matters only if a token can still follow it.
    """

    __slots__ = ("pending", "last", "open", "moves", "end")

    def __init__(self, pending: bytes, last: tuple[int, ...], open_ends: list[int]):
        self.pending, self.last, self.open = pending, last, open_ends
        self.moves: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    """Tokens of a piece by the ranks of their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.left_half, self.right_half = [-1] * (max(self.tokens) + 1), [-1] * (max(self.tokens) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        for token in self.tokens:
            self.split(token)
        self.fits: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[bytes, tuple[int, ...]], State] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first, which has read nothing."""
        for state in self.states.values():
            state.moves.clear()
        self.first = State(b"", (-1,), [0])
        self.states = {(b"", (-1,)): self.first}
        self.fits.clear()

    def split(self, token: int) -> None:
        """Note the two tokens whose merge makes `token`, unless it is a byte."""
        text = self.tokens[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:  # merge the pair of the lowest rank, the leftmost first
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]  # noqa: B905
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            a, b = (self.ranks[x] for x in parts)
            self.left_half[token], self.right_half[token] = a, b
            self.pairs[a, b] = token

    def adjacent(self, left: int, right: int) -> bool:
        """Whether two tokens may follow each other; -1 is the start of a piece.

        Merges run by rank, so the two stay apart unless, going back through their last
        merges, the tokens at the seam had a pair that merges before the later of both.
        """
        if left < 0:
            return True
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, 1 << 60  # a pair at the seam counts if its rank is below `before`
        merge, left_half, right_half = self.pairs.get, self.left_half, self.right_half
        found = False
        while merge((a, b), before) >= before:
            of_a, of_b = right_half[a], left_half[b]
            # undo the merge that was made last; of equal ones the right one, as the left one is made first
            if of_b < 0 or (of_a >= 0 and a > b):
                if of_a < 0:
                    found = True
                    break
                before, a = a, of_a
            else:
                before, b = b + 1, of_b
        self.fits[left, right] = found
        return found

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after one more byte, and the tokens that it makes final."""
        pending = state.pending + bytes((byte,))
        last, lengths, rank_of, prefixes = state.last, self.lengths, self.ranks.get, self.prefixes
        token, open_ends = None, []
        for start in state.open:
            rest = pending[start:]
            if token is None:
                token = rank_of(rest)
                if token is not None and not self.adjacent(last[start], token):
                    token = None
            if rest in prefixes:
                open_ends.append(start)
        last = [*last, token]
        open_ends.append(len(pending))
        common = open_ends[0]
        for end in open_ends[1:]:  # the nearest prefix that all open branches share
            while end != common:
                if end > common:
                    end -= lengths[last[end]]
                else:
                    common -= lengths[last[common]]
        emitted = tuple(self.chain(last, common)) if common else ()
        if common:
            pending, last, open_ends = pending[common:], last[common:], [i - common for i in open_ends]
        kept = [NONE] * len(last)  # prefixes on no open branch make no difference, nor does their last token
        for end in open_ends:
            while end and kept[end] == NONE:
                kept[end] = last[end]
                end -= lengths[last[end]]
        if not open_ends[0]:
            kept[0] = last[0]
        name = pending, tuple(kept)
        target = self.states.get(name)
        if target is None:
            target = self.states[name] = State(pending, name[1], open_ends)
        state.moves[byte] = found = target, emitted
        return found

    def chain(self, last: Sequence[int], end: int) -> list[int]:
        """The tokens that lead to the prefix of length `end`."""
        tokens = []
        while end:
            tokens.append(last[end])
            end -= self.lengths[last[end]]
        return tokens[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self.forget()
        ids: list[int] = []
        state = self.first
        for byte in piece:
            state, emitted = state.moves.get(byte) or self.move(state, byte)
            if emitted:
                ids += emitted
        if state.end is None:
            state.end = tuple(self.chain(state.last, len(state.pending)))
        ids += state.end
        return ids


class BpeEncoder(UnitMemo):
    """Ids of whole texts: each match of `pattern` goes through the transducer by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__(blanks_matter=True)
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        encode = self.transducer.encode
        return [[i for piece in self.pieces(x) for i in encode(piece.encode())] for x in texts]


class Utf8Machine:
    """Says after each byte how many more the character needs; -1 is an error."""

    def __init__(self):
        self.needs, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, byte: int) -> int:
        if self.needs == 0:
            self.low, self.high = 0x80, 0xBF
            if byte < 0x80:
                return 0
            if 0xC2 <= byte <= 0xDF:
                self.needs = 1
            elif 0xE0 <= byte <= 0xEF:
                self.needs = 2
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.needs = 3
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                return -1
            return self.needs
        if not self.low <= byte <= self.high:
            self.needs = 0
            return -1
        self.low, self.high = 0x80, 0xBF
        self.needs -= 1
        return self.needs


class StreamDecoder:
    """Text from ids as they come; bytes of an unfinished character wait for the next ids."""

    def __init__(self, tokens: TokenBytes):
        self.tokens, self.waiting = tokens, b""

    def feed(self, ids: np.ndarray) -> str:
        data = self.waiting + self.tokens.join(ids)
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # a character's first byte is among the last three, if one is open
            if data[-back] >= 0xC0:
                machine = Utf8Machine()
                needs = [machine.feed(b) for b in data[-back:]]
                keep = back if needs[-1] > 0 else 0
                break
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class TokenBytes:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[[ranks[x] for x in ordered]] = [len(x) for x in ordered]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(ordered), np.uint8)
        self.decimals = list(map(str, range(len(self.lengths))))

    def join(self, ids: np.ndarray) -> bytes:
        return gather(self.data, self.starts[ids], self.lengths[ids]).tobytes()


def decoded_text(ids: np.ndarray, tokens: TokenBytes, step: int) -> str:
    """The text of ids, decoded `step` at a time."""
    stream = StreamDecoder(tokens)
    parts = [stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
    return "".join([*parts, stream.finish()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[BpeEncoder, TokenBytes]:
    """One codec a worker. Its many small objects hold no garbage, so the collector need not visit them."""
    gc.disable()
    ranks = read_ranks(path)
    return BpeEncoder(ranks, pattern), TokenBytes(ranks)


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids, unsigned little-endian 32-bit integers, of every text of `docs` (doc_id, text)."""

    def encoded(batches):
        encoder, _ = codec(ranks, pattern)
        for batch in slices(batches):
            ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, step: int = 1 << 16) -> DataFrame:
    """The rows of `encoded` (doc_id, ids) with their text, decoded `step` ids at a time."""

    def decoded(batches):
        _, tokens = codec(ranks, pattern)
        for batch in slices(batches):
            texts = [decoded_text(np.frombuffer(x, "<u4"), tokens, step) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, step: int = 1 << 16) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, one space between) and decoded_sha256 of every text.

    Encoding and decoding share one codec in a worker, and no ids leave it.
    """

    def digested(batches):
        encoder, tokens = codec(ranks, pattern)
        for batch in slices(batches):
            counts, written, read = [], [], []
            for ids in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                decimals = " ".join(map(tokens.decimals.__getitem__, ids.tolist()))
                written.append(hashlib.sha256(decimals.encode()).hexdigest())
                read.append(hashlib.sha256(decoded_text(ids, tokens, step).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(read, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(digested, schema)
