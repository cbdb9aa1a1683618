"""Tokenizers as column functions: a native one on words, and any supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
VOCABULARY = 1 << 17


def hashed_id(word: Column) -> Column:
    """A token id from the word alone."""
    return F.pmod(F.xxhash64(word), F.lit(VOCABULARY)).cast("int")


def words(text: Column) -> Column:
    """Words between blanks. Plain replaces and a split are faster here than a word pattern."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(BLANKS[0]))
    return F.array_remove(F.split(text, BLANKS[0], -1), "")


class WordTokenizer:
    """Words between blanks, as native expressions."""

    #: Whether it pays to hand over all texts of a row in one call.
    in_python = False

    def __init__(self, token_id: Callable[[Column], Column] = hashed_id):
        self.token_id = token_id

    def ids(self, text: Column) -> Column:
        return F.transform(words(text), self.token_id)

    def ids_each(self, texts: Column) -> Column:
        return F.transform(texts, self.ids)

    def count(self, text: Column) -> Column:
        return F.size(words(text))


class SuppliedTokenizer:
    """The caller's tokenizer, loaded once per Python worker and fed in Arrow batches.

    `load` returns a function from a text to its token ids.
    """

    in_python = True

    def __init__(self, load: Callable[[], Callable[[str], list[int]]]):
        @F.pandas_udf("array<int>")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for batch in batches:
                yield batch.map(encode, na_action="ignore")

        @F.pandas_udf("array<array<int>>")
        def ids_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for batch in batches:
                yield batch.map(
                    lambda texts: [None if t is None else encode(t) for t in texts], na_action="ignore"
                )

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for batch in batches:
                yield batch.map(lambda text: len(encode(text)), na_action="ignore")

        self.ids, self.ids_each, self.count = ids, ids_each, count
