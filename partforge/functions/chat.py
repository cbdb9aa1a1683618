"""Chat messages and their rendering as training text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """The markers around a message. The body of a model's own template is up to the caller."""

    # The markers that the response masking and cleaning look for.
    header_open: str = "<|start_header_id|>"
    header_close: str = "<|end_header_id|>\n\n"
    end_of_turn: str = "<|eot_id|>"
    preamble: str = ""

    def header(self, role: Column | str) -> Column:
        role = F.lit(role) if isinstance(role, str) else role
        return F.concat(F.lit(self.header_open), role, F.lit(self.header_close))

    def body(self, content: Column) -> Column:
        return F.concat(F.coalesce(content, F.lit("")), F.lit(self.end_of_turn))


LLAMA = ChatTemplate()


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(c_input: Column, c_output: Column) -> Column:
    """The two-message conversation of an instruction pair."""
    return F.array(message("user", c_input), message("assistant", c_output))


def render_chat(c_messages: Column, template: ChatTemplate = LLAMA) -> Column:
    """Header, content and end mark of every message, after the preamble."""
    turns = F.transform(
        c_messages, lambda m: F.concat(template.header(m["role"]), template.body(m["content"]))
    )
    return F.concat(F.lit(template.preamble), F.array_join(turns, ""))


def render_prompt(c_messages: Column, template: ChatTemplate = LLAMA) -> Column:
    """The rendered messages and an open assistant header."""
    return F.concat(render_chat(c_messages, template), template.header("assistant"))


def chat_segments(c_messages: Column, template: ChatTemplate = LLAMA) -> Column:
    """The rendered text in pieces `(text, learned)`: only what an assistant says is learned."""
    turns = F.transform(
        c_messages,
        lambda m: F.array(
            F.struct(template.header(m["role"]).alias("text"), F.lit(False).alias("learned")),
            F.struct(
                template.body(m["content"]).alias("text"),
                (m["role"] == "assistant").alias("learned"),
            ),
        ),
    )
    opening = F.struct(F.lit(template.preamble).alias("text"), F.lit(False).alias("learned"))
    return F.concat(F.array(opening), F.flatten(turns))
