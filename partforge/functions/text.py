"""Column functions on raw model responses and code texts.

Each is one chain of native string functions. Line-wise rules are written as
regular expressions over the whole text where that is exact, so a text is not
split into an array unless a rule needs per-line arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
PY_WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class, without the line feed.
_BLANK = (
    r"[\t\x0b\x0c\r\x1c-\x20\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Markdown fences and the words that mark lead-in and code lines.
FENCE = "```"
TAGGED_FENCE = "```openscad"
LEAD_INS = ["Here", "Sure", "I'll", "This"]
CODE_STARTS = ["//", "module", "union", "difference"]
CODE_WORDS = ["sphere", "cube", "cylinder", "translate", "rotate"]

# Chat markers and junk found in decoded model output.
ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>"
ROLE_LINES = ["system", "user", "assistant"]
JUNK_PARTS = ["Cutting Knowledge Date:", "Today Date:"]
JUNK_ENDING = "assistant"
STOP_MARKS = ["<|eot_id|>", "<|end_of_text|>", "<|eom_id|>", "<|reserved_special_token_"]
GARBAGE_RUN = "[а-яА-ЯａристиндивидуkrvldkfилактиЎыџN]{5,}"


def _any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


_WORD_LETTERS = "".join(sorted({word[0] for word in CODE_WORDS}))

# (?d) keeps "\n" as the only line end and (?m) lets ^ and $ match at each line.
# Possessive *+ stops the blanks from being given back to satisfy a lookahead, and
# the first letters of the code words save trying each word at every character.
_FROM_CODE = (
    rf"(?dm)^{_BLANK}*+(?!{_any_of(LEAD_INS)})"
    rf"(?:{_any_of(CODE_STARTS)}|.*?(?=[{_WORD_LETTERS}])(?:{_any_of(CODE_WORDS)}))(?s:.*)"
)
_FROM_CONTENT = (
    rf"(?dm)^(?!{_BLANK}*+(?:(?:{_any_of(ROLE_LINES)}){_BLANK}*+)?$)"
    rf"(?!.*(?:{_any_of(JUNK_PARTS)}))"
    rf"(?!.*{re.escape(JUNK_ENDING)}{_BLANK}*+$)"
    r"(?s:.+)"
)
# The class of GARBAGE_RUN without repeats: Java tries the members one by one, so
# fewer are several times faster. Plain text without a run needs no look at its lines.
_GARBAGE = r"(?=[Ndfklrv\u0400-\uffff])[а-яА-ЯЎџａkrvldfN]{5}"
_NOT_PLAIN = r"[^\x20-\x7e\n]"
_PLAIN_GARBAGE = r"[krvldfN]{5}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once for an expression that names it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut_before(text: Column, pattern: str) -> Column:
    """The match of a pattern that runs to the end of the text, or all of the text without one."""
    return _let(
        F.regexp_extract(text, pattern, 0),
        lambda found: F.when(found != "", found).otherwise(text),
    )


def strip(c: Column) -> Column:
    """Trim as Python's str.strip() does."""
    return F.btrim(c, F.lit(PY_WS))


def trim_response(c: Column) -> Column:
    """The trimmed response; NULL where nothing is left."""
    return _let(strip(c), lambda trimmed: F.when(trimmed != "", trimmed))


def extract_code(c: Column) -> Column:
    """Code within a chat answer: fenced part, without the prose before the first code line.

    NULL or empty input gives NULL; the result may be empty, which callers treat
    as a failed extraction.
    """
    return _let(
        c,
        lambda answer: F.when(
            answer != "",
            _let(_fenced(answer), lambda body: strip(_cut_before(body, _FROM_CODE))),
        ),
    )


def _fenced(answer: Column) -> Column:
    """The first fenced block, tagged ones first; all of the answer without a fence."""
    return (
        F.when(
            F.contains(answer, F.lit(TAGGED_FENCE)),
            F.substring_index(F.split_part(answer, F.lit(TAGGED_FENCE), F.lit(2)), FENCE, 1),
        )
        .when(F.contains(answer, F.lit(FENCE)), F.split_part(answer, F.lit(FENCE), F.lit(2)))
        .otherwise(answer)
    )


def clean_response(c: Column) -> Column:
    """Code within a decoded model output: no chat header, special tokens or garbage tail."""
    text = _let(
        F.substring_index(c, ASSISTANT_HEADER, -1), lambda s: _cut_before(s, _FROM_CONTENT)
    )
    for mark in STOP_MARKS:
        text = F.substring_index(text, mark, 1)
    return strip(_let(text, _readable))


def _readable(text: Column) -> Column:
    """Lines before the first one that is garbage; plain text without a garbage run is all kept."""
    # Two patterns in turn, as Java scans for one class faster than for a choice.
    suspect = F.rlike(text, F.lit(_NOT_PLAIN)) | F.rlike(text, F.lit(_PLAIN_GARBAGE))
    flags = F.transform(F.split(text, "\n", -1), _is_garbage)
    # A closing True gives the position of the end when every line is readable.
    kept = F.array_position(F.concat(flags, F.array(F.lit(True))), True) - 1
    first = F.call_function("substring_index", text, F.lit("\n"), kept.cast("int"))
    return F.when(suspect, first).otherwise(text)


def _is_garbage(line: Column) -> Column:
    """A non-blank line with less than 80 % printable ASCII, or with a garbage run."""
    odd = F.length(F.regexp_replace(line, r"[\x20-\x7e]+", ""))
    mostly_odd = (odd * 5 > F.length(line)) & (strip(line) != "")
    return mostly_odd | F.rlike(line, F.lit(_GARBAGE))


def preview(c: Column, n: int, mark: str = "...") -> Column:
    """First n characters, with a mark only if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def n_chars(c: Column) -> Column:
    """Length in code points."""
    return F.length(c)
