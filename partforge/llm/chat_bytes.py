"""Chat formatting by columns of bytes.

A turn is `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. A batch
of turns is laid out at once: the lengths of all segments give their offsets in one
buffer of the size needed, and numpy scatters headers and contents into it; the buffer
is the Arrow column. The loss mask of an assistant turn is the byte range of its text.

Inside texts and roles `<`, any number of backslashes and `|` get one more backslash,
so no control string of the template can appear there, and taking one away undoes it; a
role's line breaks and backslashes are escaped as well. A conversation is the turns of
one conv_id by turn, ties by their formatted bytes, null turns first; it is never held
as a whole, only streamed. A null text or role is empty, null conv_ids are one
conversation, an empty table gives no row, and other columns play no part.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import slices

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"

Part = bytes | tuple[np.ndarray, np.ndarray]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def assemble(rows: int, parts: list[Part]) -> tuple[pa.Array, np.ndarray]:
    """The parts of each row side by side, as one column; and where each part of each row starts.

    A part is the same bytes for each row, or a column's offsets and data.
    """
    lengths = np.empty((rows, len(parts)), np.int64)
    for j, part in enumerate(parts):
        lengths[:, j] = len(part) if isinstance(part, bytes) else np.diff(part[0])
    ends = np.cumsum(lengths.ravel())
    places = (ends - lengths.ravel()).reshape(rows, len(parts))
    total = int(ends[-1]) if len(ends) else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for j, part in enumerate(parts):
        if isinstance(part, bytes):
            out[(places[:, j, None] + np.arange(len(part))).ravel()] = np.tile(np.frombuffer(part, np.uint8), rows)
        else:
            offsets, data = part
            if rows and offsets[-1] > offsets[0]:
                to = np.repeat(places[:, j] - offsets[:-1], lengths[:, j]) + np.arange(offsets[0], offsets[-1])
                out[to] = data[offsets[0] : offsets[-1]]
    bounds = np.append(places[:, 0], total) if rows else np.zeros(1, np.int64)
    column = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(bounds), buffer])
    return column, places - places[:, :1]


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_roles(roles: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, and loss_start and loss_bytes of the text that is trained on, else null.

    A conversation's text is its turns' `formatted` in a row.
    """

    def formatted(batches):
        for batch in slices(batches, 1024):
            roles, texts = (pc.fill_null(batch.column(i).cast(pa.string()), "") for i in (2, 3))
            role_parts, text_parts = string_parts(escaped_roles(roles)), string_parts(escaped(texts))
            parts = [START.encode(), role_parts, b"\n", text_parts, f"{END}\n".encode()]
            column, places = assemble(batch.num_rows, parts)
            plain = pc.invert(pc.equal(roles, TRAINED_ROLE))
            hidden = plain.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), column.cast(pa.string()),
                pa.array(places[:, 3], pa.int64(), mask=hidden),
                pa.array(np.diff(text_parts[0]), pa.int64(), mask=hidden),
            ], ["conv_id", "turn", "formatted", "loss_start", "loss_bytes"])

    schema = "conv_id long, turn long, formatted string, loss_start long, loss_bytes long"
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(formatted, schema)


class Conversation:
    """Running digests of one conversation as its turns are read."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss_start: int | None, loss_bytes: int | None) -> None:
        if not formatted.startswith(START) or not formatted.endswith(f"{END}\n"):
            raise ValueError("not a formatted turn")
        role, text = formatted[len(START) : -len(END) - 1].split("\n", 1)
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        self.turns.update(f"{unescaped_role(role)}\n{unescaped(text)}\n".encode())
        if loss_start is not None:
            trained = unescaped(formatted.encode()[loss_start : loss_start + loss_bytes].decode())
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        digests = self.turns.hexdigest(), self.loss.hexdigest()
        return self.conv_id, self.n_turns, digests[0], self.loss_chars, digests[1], self.formatted_chars


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        current, rows = None, []

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
            )

        for piece in slices(batches):
            for conv_id, text, start, length in zip(*(piece.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        rows.append(current.row())
                    current = Conversation(conv_id)
                current.read(text, start, length)
            if len(rows) >= 4096:
                yield batch()
                rows.clear()
        if current is not None:
            rows.append(current.row())
        if rows:
            yield batch()

    ordered = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted")
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")  # fmt: skip
    return ordered.mapInArrow(read, schema)
