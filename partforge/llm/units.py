"""Token ids of whole texts through the ids of their units.

Both tokenizers here split a text before they merge, and never across the start of a
unit: a unit is a stretch without blanks, with the one blank or line break before it.
So the library encodes every different unit once, and a text's ids are its units' ids
in a row. Texts with blanks in any other arrangement are encoded whole, and so are those
that hold the string of a special token, which the library cuts out before it splits.

A tokenizer that lower-cases and keeps runs of letters apart from all else (`LETTERS_APART`) needs fewer units: texts
of Latin-1 are lower-cased first, a comma or full stop behind a letter or digit is a unit of its own, and new
units of letters alone go to the library's model without the rules that would leave them as they are.
With these rules and with the plain byte-level ones, new units of ASCII letters and the signs behind them go to that
model as their two words.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain, compress, filterfalse, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_UNITS = 800_000
MOST_CHARS = 32_000_000  # of the remembered units together
TOGETHER = 1 << 16  # units of texts whose ids are put together at once
BLANK_BYTES = "ĠĊ"  # fixed: how a byte-level vocabulary writes a blank and a line break
BETWEEN = "\0"

# Fixed: the rules of a file by which a run of letters is one word whatever stands around it, in lower case.
LOWERED = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
LETTERS_APART = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MARKS = (",", ".")
LOWER = bytes(range(256)).decode("latin-1").lower().replace("\n", " ").encode("latin-1")  # and blanks for line breaks
WORD = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]+)")  # no apostrophe: letters behind one may belong to it
ALONE = re.compile(r"\n?\S+")
PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def merges_only(model: dict) -> bool:
    """Whether the model of a file does nothing but merge."""
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")
    return model["type"] == "BPE" and not any(model.get(k) for k in odd)


def plain_bytes(path: str) -> bool:
    """Whether a file has the plain byte-level rules and nothing else."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules["model"]
    plain = merges_only(model) and not model.get("end_of_word_suffix")
    return plain and rules["normalizer"] is None and rules["pre_tokenizer"] == PLAIN_BYTES


def word_end(path: str) -> str:
    """What the last id of every word ends with in the vocabulary of a file of those rules, else nothing."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules["model"]
    plain = merges_only(model)
    split = (rules["pre_tokenizer"] or {}).get("pretokenizers") == LETTERS_APART
    added = all(not x["content"].isalpha() and not set(MARKS) & set(x["content"]) for x in rules["added_tokens"])
    lowered = (rules["normalizer"] or {}).get("normalizers") == LOWERED
    return (model.get("end_of_word_suffix") or "") if plain and split and added and lowered else ""


def is_latin(text: str) -> bool:
    """Whether lower case is letter by letter, and nothing is composed or decomposed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs `values[starts[i] : starts[i] + lengths[i]]`, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return values.take(at)


Ids = tuple[np.ndarray, np.ndarray]


def in_place(first: np.ndarray, one: Ids, two: Ids) -> Ids:
    """Ids and lengths of units, those in `first` from `one` and the others from `two`."""
    ids, lengths = (np.concatenate([one[i], two[i]]) for i in (0, 1))
    order = np.argsort(np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)]))
    starts = np.cumsum(lengths) - lengths
    return gather(ids, starts[order], lengths[order]), lengths[order]


class Numbers(dict):
    """Numbers units as they are first met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number

    def numbers(self, units: list[str]) -> np.ndarray:
        """Those of different units."""
        found = np.fromiter(map(self.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        new = list(map(units.__getitem__, missing.tolist()))
        found[missing] = np.arange(len(self), len(self) + len(new))
        self.update(zip(new, found[missing].tolist(), strict=True))
        self.new += new
        return found


class UnitMemo:
    """Encodes texts through remembered units, at most `MOST_UNITS` of them.

    `blanks_matter` is true for a byte-level tokenizer, whose ids depend on the blank
    before a word, and false for one that drops white space.
    """

    letters_alone = False  # whether a unit of letters is known to stand alone

    def __init__(self, blanks_matter: bool):
        self.blanks_matter = blanks_matter
        self.forget()

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text as a whole."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.learned = self.used = self.chars = 0
        self.odd: set[int] = set()

    def learn(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the next numbers."""
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < self.learned + len(lengths) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.learned + 1 : self.learned + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.learned += len(lengths)
        self.used += len(ids)

    def each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has."""
        found = self.encode_each([self.written(u) for u in units])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def learn_each(self, units: list[str]) -> None:
        self.learn(*self.each(units))

    def learn_all(self, units: list[str]) -> None:
        """Remember new units."""
        self.learn_each(units)

    def written(self, unit: str) -> str:
        """A unit as it stands in the text, behind another."""
        return f" {unit}" if self.blanks_matter and unit[:1] != "\n" else unit

    def spaced(self, text: str) -> str:
        """A text with its units between blanks."""
        return text.replace("\n", " \n" if self.blanks_matter else " ")

    def apart(self, texts: list[str]) -> pa.Array:
        """Spaced texts, with blanks between all units."""
        return pa.array(texts, pa.large_string())

    def numbered(self, texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
        """The first units of spaced texts, if they count apart, and the numbers of the others, each looked up once."""
        units = pc.split_pattern(texts, " ")
        bounds, flat, firsts = units.offsets.to_numpy(), units.values, []
        if self.blanks_matter:  # nothing stands before the first unit, so it is not remembered
            firsts = flat.take(pa.array(bounds[:-1])).to_pylist()
            others = np.ones(len(flat), bool)
            others[bounds[:-1]] = False
            flat, bounds = flat.filter(pa.array(others)), bounds - np.arange(len(bounds))
        found = flat.dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # one object a unit, no scalar before it
        return firsts, np.split(self.known.numbers(different)[found.indices.to_numpy()], bounds[1:-1])

    def stands_alone(self, unit: str) -> bool:
        if not self.blanks_matter:
            return BETWEEN not in unit
        return unit[-1:].strip() != "" and len(unit.split()) == 1 and (unit[0] == "\n" or not unit[0].isspace())

    def not_alone(self, units: list[str]) -> list[str]:
        """Those of the units that do not stand alone."""
        return [u for u in units if not self.stands_alone(u)]

    def cut_wrong(self, at: list[np.ndarray]) -> list[int]:
        """Of texts by their units' numbers, those whose marks must not be cut off."""
        return []

    def learn_new(self) -> None:
        new, self.known.new = self.known.new, []
        self.chars += sum(map(len, new))
        odd = set(self.not_alone(list(filterfalse(str.isalpha, new)) if self.letters_alone else new))
        self.odd.update(self.known[u] for u in odd)
        self.learn_all(["" if u in odd else u for u in new] if odd else new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_UNITS or self.chars > MOST_CHARS:
            self.forget()
        if not texts:
            return []
        firsts, at = self.numbered(self.apart([self.spaced(x) for x in texts]))
        self.learn_new()
        again = self.cut_wrong(at)
        if again:
            uncut = UnitMemo.apart(self, [UnitMemo.spaced(self, texts[i]) for i in again])
            for i, units in zip(again, self.numbered(uncut)[1], strict=True):
                at[i] = units
            self.learn_new()
        whole = [bool(self.odd) and not self.odd.isdisjoint(x.tolist()) for x in at]
        if not self.blanks_matter:
            return [self.whole(x) if w else s for x, s, w in zip(texts, self.joined_each(at), whole, strict=True)]
        whole = [w or not self.stands_alone(x) for w, x in zip(whole, firsts, strict=True)]
        heads = self.encode_each(firsts)
        return [
            self.whole(x) if w else np.concatenate([np.array(head, np.uint32), self.joined(s)])
            for x, head, s, w in zip(texts, heads, at, whole, strict=True)
        ]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encode_each([text])[0], np.uint32)

    def joined_each(self, at: list[np.ndarray]) -> list[np.ndarray]:
        """Those of every text, short ones together."""
        found, held, size = [], [], 0
        for i, units in enumerate(at):
            held.append(units)
            size += len(units)
            if size >= TOGETHER or i == len(at) - 1:
                flat = np.concatenate(held)
                starts, ends = self.starts.take(flat), np.cumsum([len(x) for x in held])
                lengths = self.starts.take(flat + 1) - starts
                before = np.append(0, np.cumsum(lengths))
                found += np.split(gather(self.ids, starts, lengths), before[ends[:-1]])
                held, size = [], 0
        return found

    def joined(self, at: np.ndarray) -> np.ndarray:
        return gather(self.ids, self.starts[at], self.starts[at + 1] - self.starts[at])


class UnitEncoder(UnitMemo):
    """The ids that a file of the tokenizers library gives, special tokens' strings in a text being special tokens."""

    def __init__(self, path: str, blanks_matter: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.word_end = "" if blanks_matter else word_end(path)
        super().__init__(blanks_matter)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_blank = any(c.isspace() for x in self.added for c in x)
        vocabulary = self.tokenizer.get_vocab()
        opens = [i for t, i in vocabulary.items() if t[0] in BLANK_BYTES] if blanks_matter else []
        opens = opens or self.encode_each([BETWEEN])[0]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[opens] = True
        self.words_apart = bool(self.word_end) or (blanks_matter and plain_bytes(path))
        self.model = self.tokenizer.model
        signs = all(any(c.isascii() and not c.isalpha() for c in x) for x in self.added)
        self.letters_alone = bool(self.word_end) or (self.words_apart and signs)
        if self.word_end:
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            second = {chr(b): as_bytes(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
            self.bytes_as = {b: c for b, c in second.items() if b != c}  # how a vocabulary writes them

    def forget(self) -> None:
        super().forget()
        self.signs: dict[str, list[int]] = {}
        self.cut = np.zeros(1 << 12, bool)  # whether a mark behind the unit of a number is a word of its own
        if self.word_end:
            self.marks = [self.known[x] for x in MARKS]

    def spaced(self, text: str) -> str:
        if not self.word_end:
            return super().spaced(text)
        try:
            return text.encode("latin-1").translate(LOWER).decode("latin-1")
        except UnicodeEncodeError:
            return super().spaced(text)

    def apart(self, texts: list[str]) -> pa.Array:
        spaced = super().apart(texts)
        for mark in MARKS if self.word_end else ():
            spaced = pc.replace_substring(spaced, f"{mark} ", f" {mark} ")
        return spaced

    def cut_wrong(self, at: list[np.ndarray]) -> list[int]:
        if not self.word_end:
            return []
        flat, sizes = np.concatenate(at), np.array([len(x) for x in at])
        ends = np.cumsum(sizes)
        spots = np.flatnonzero(flat <= max(self.marks))  # numbered first
        texts = np.searchsorted(ends, spots, "right")
        alone = ~self.cut[flat[spots - 1]] | (spots == (ends - sizes)[texts])
        return np.unique(texts[alone]).tolist()

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def stands_alone(self, unit: str) -> bool:
        lower = unit.lower()  # one may be looked for in lower-cased text
        return not any(x in lower for x in self.added) and super().stands_alone(unit)

    def not_alone(self, units: list[str]) -> list[str]:
        if not self.blanks_matter:
            return super().not_alone(units)
        lower = BETWEEN.join(units).lower()
        if any(x in lower for x in self.added):
            return super().not_alone(units)
        return super().not_alone([u for u in units if not ALONE.fullmatch(u)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.added_blank:
            return super().encode(texts)
        return [self.whole(x) for x in texts]  # one may reach over several units

    def learn_all(self, units: list[str]) -> None:
        if not self.words_apart:
            self.learn(*self.together(units))
            return
        held, sizes, rest = array("I"), array("q"), []  # no list a word, which the garbage collector would look through
        tokenize, lead = self.model.tokenize, "" if self.word_end else BLANK_BYTES[0]
        for unit in units:
            if not unit.isalpha():
                ids = self.of_word(unit)
            elif unit.isascii():
                ids = [x.id for x in tokenize(lead + unit if lead else unit.lower())]
            else:
                ids = None
            if ids is None:
                rest.append(unit)
                sizes.append(-1)
            else:
                held.extend(ids)
                sizes.append(len(ids))
        sizes, ids = np.array(sizes, np.int64), np.array(held, np.uint32)
        known = sizes >= 0
        sizes = sizes[known]
        if self.word_end:
            while len(self.cut) < self.learned + len(units):
                self.cut = np.concatenate([self.cut, np.zeros_like(self.cut)])
            spot = self.learned + np.arange(len(units))
            self.cut[spot[known]] = np.fromiter(map(str.isalpha, compress(units, known.tolist())), bool, len(sizes))
            others, self.cut[spot[~known]] = self.of_others(rest)
        else:
            others = self.together(rest)
        self.learn(*in_place(known, (ids, sizes), others))

    def of_word(self, unit: str) -> list[int] | None:
        """The ids of ASCII letters and the signs behind them, if a unit is that."""
        found = WORD.fullmatch(unit)
        if not found:
            return None
        letters, signs = found.groups()
        if signs not in self.signs:
            if len(self.signs) > 1 << 12:
                self.signs.clear()
            self.signs[signs] = [x.id for x in self.model.tokenize(signs)]
        return self.of_run(letters) + self.signs[signs]

    def of_run(self, letters: str) -> list[int]:
        """The ids of a word of ASCII letters."""
        word = letters.lower() if self.word_end else f"{BLANK_BYTES[0]}{letters}"
        return [x.id for x in self.model.tokenize(word)]

    def of_others(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The ids of units, how many each has, and whether a mark behind it is a word of its own."""
        plain = np.fromiter(map(str.isalpha, units), bool, len(units))
        letters = list(compress(units, plain.tolist()))
        if not is_latin("".join(letters)):
            plain = np.fromiter((u.isalpha() and is_latin(u) for u in units), bool, len(units))
            letters = list(compress(units, plain.tolist()))
        others = list(compress(units, (~plain).tolist()))
        cut = plain.copy()
        cut[~plain] = [is_latin(u) and (u[-1:].isalpha() or "0" <= u[-1:] <= "9") for u in others]
        return in_place(plain, self.of_letters(letters), self.together(others)), cut

    def of_letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of Latin-1 letters, and how many each has."""
        words = " ".join(units).lower().encode().decode("latin-1")
        for byte, char in self.bytes_as.items():
            words = words.replace(byte, char)
        held, sizes, tokenize = array("I"), array("q"), self.model.tokenize
        for word in words.split(" ") if units else []:
            ids = [x.id for x in tokenize(word)]
            held.extend(ids)
            sizes.append(len(ids))
        return np.array(held, np.uint32), np.array(sizes, np.int64)

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all units: their ids are cut apart where an id opens a unit, or stands between two."""
        if self.blanks_matter:
            text = "".join([u if u[:1] == "\n" else f" {u}" for u in units])
        else:
            text = f" {BETWEEN} ".join(["", *units])
        ids = np.array(self.encode_each([text])[0] if units else [], np.uint32)
        opens = self.opens[ids]
        at = np.flatnonzero(opens)
        if not units or len(at) != len(units) or at[0]:
            return self.each(units)
        lengths = np.diff(at, append=len(ids))
        return (ids, lengths) if self.blanks_matter else (ids[~opens], lengths - 1)


@lru_cache(maxsize=2)
def unit_encoder(path: str, blanks_matter: bool) -> UnitEncoder:
    """One encoder a worker."""
    return UnitEncoder(path, blanks_matter)
