"""Exact deduplication: a Bloom filter of repeated hashes decides which rows need a shuffle.

Pass 1 counts, per slot of a counting filter, the hashes that fall on it, and keeps
the slots hit at least twice as a bit set. Pass 2 looks every row up: a row with a
slot that no other row hit is unique and goes straight through; only the others are
shuffled by their hash and compared exactly. The bit set has at most `MAX_SLOTS`
bits, which bounds what is broadcast; beyond about a tenth of that many rows more
unique rows take the way through the shuffle, and the result stays the same.

Null text counts as empty text. Of equal texts the row with the largest doc_id stays;
null ids are smaller than any other, and of repeated rows with the same id one stays.
An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import free_name, lower_ascii, staged

MAX_SLOTS = 1 << 26
SLOTS_PER_ROW = 16
PROBES = 2
SALTS = 32


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def slot_count(rows: int, most: int = MAX_SLOTS) -> int:
    wanted = max(1 << 12, SLOTS_PER_ROW * rows)
    return min(most, 1 << (wanted - 1).bit_length())


def slot(key: Column, probe: int, slots: int) -> Column:
    return F.xxhash64(key, F.lit(probe)).bitwiseAND(F.lit(slots - 1))


def repeated_slots(hashes: DataFrame, key: str, slots: int) -> DataFrame:
    """The slots that at least two rows hit, as words of 64 bits: (word, bits), `slots / 64` rows at most."""
    probes = F.array_distinct(F.array(*[slot(F.col(key), i, slots) for i in range(PROBES)]))
    return (
        hashes.select(F.explode(probes).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select((F.shiftright("slot", 6)).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def present_slots(keys: DataFrame, key: str, slots: int) -> DataFrame:
    """The slots of all keys, as words of 64 bits: a Bloom filter of `slots / 64` rows at most."""
    probes = F.array(*[slot(F.col(key), i, slots) for i in range(PROBES)])
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keys.select(F.explode(probes).alias("slot")).select(F.shiftright("slot", 6).alias("word"), bit.alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, flag: str, most: int = MAX_SLOTS) -> DataFrame:
    """`rows` with a boolean that is false only where no row of `keys` has the same key: only the others need a join."""
    slots = slot_count(keys.count(), most)
    return with_flag(rows, key, present_slots(keys, key, slots), slots, flag)


def with_flag(rows: DataFrame, key: str, words: DataFrame, slots: int, flag: str) -> DataFrame:
    """`rows` with a boolean: false only where no other row has the same key."""
    columns, hits = rows.columns, []
    for i in range(PROBES):
        word, bits = f"{flag}_word{i}", f"{flag}_bits{i}"
        at = slot(F.col(key), i, slots)
        small = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        rows = rows.join(small, F.shiftright(at, 6) == F.col(word), "left")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        hits.append(F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit) != 0)
    both = hits[0]
    for hit in hits[1:]:
        both = both & hit
    return rows.select(*columns, both.alias(flag))


class RepeatFilter:
    """The repeated hashes of a table: its staged hashes and the bounded bit set."""

    def __init__(self, docs: DataFrame, most: int = MAX_SLOTS):
        self.hashes = staged(docs.select("doc_id", text_hash(F.col("text")).alias("text_sha256")), "hashes")
        self.slots = slot_count(self.hashes.count(), most)
        self.words = staged(repeated_slots(self.hashes, "text_sha256", self.slots), "repeated")

    def flag(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        return with_flag(rows, key, self.words, self.slots, flag)

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """The possibly repeated (text_sha256, doc_id, copies), and per text keep_id and group_size."""
        maybe = self.flag(self.hashes, "text_sha256", "maybe").where("maybe")
        ids = maybe.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        groups = ids.groupBy("text_sha256").agg(
            F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
        )
        return ids, groups


def dedup_decisions(docs: DataFrame, most: int = MAX_SLOTS) -> DataFrame:
    """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    found = RepeatFilter(docs, most)
    ids, groups = found.groups()
    alone = found.flag(found.hashes, "text_sha256", "maybe").where(~F.col("maybe"))
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    salted = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    several = (
        ids.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["text_sha256", "salt"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
        )
    )
    return alone.unionByName(several)


def exact_dedup(docs: DataFrame, most: int = MAX_SLOTS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    sha, maybe, keep = (free_name(docs, x) for x in ("__text_sha256", "__maybe_repeated", "__keep_id"))
    found = RepeatFilter(docs, most)
    rows = found.flag(docs.withColumn(sha, text_hash(F.col("text"))), sha, maybe)
    _, groups = found.groups()
    keepers = groups.select(F.col("text_sha256").alias(f"{sha}_kept"), F.col("keep_id").alias(keep))
    several = (
        rows.where(maybe)
        .join(keepers, (F.col(sha) == F.col(f"{sha}_kept")) & F.col("doc_id").eqNullSafe(F.col(keep)))
        .dropDuplicates([sha])
    )
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(several.select(*docs.columns))
