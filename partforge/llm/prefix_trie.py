"""Trie of the prefixes of all conversations, counted in tables of minimal perfect hashes.

A node is a sequence of turns with which some conversation starts; the root is the empty one.
Prefixes are named without walking a conversation in one task: a turn at a place has a digest,
and the lanes of the digests, summed up along the conversation by `running_totals`, name the
prefix. Rows with equal names are counted before they move, so a prefix that a third of
all conversations share is one row a task.

1. A node is heavy if more than `most` rows of conversations pass it or lie below; the others are light. `most`
   follows from the number of rows.
   Light subtrees whose parent is heavy are pieces: none has more than `most` nodes, and nothing leaves a piece
   but its root's sums.
2. Pieces are dealt out as shards. A shard's distinct names get a minimal perfect hash: levels of
   bit vectors in which only names without a collision keep their place; a name's slot is the rank of
   its bit. The name stored at a slot verifies each lookup, so that a parent that is not in the shard is
   told from one that is. Counts are scattered into flat arrays by slot, and sums go up through the
   array of parents' slots, deepest nodes first.
3. Heavy nodes, at most a `most`-th of the rows at any depth, take the sums of their pieces. Each belongs
   to its smallest conversation, and those of one conversation stand in a line; the lines, of which
   there are no more than heavy nodes without a heavy child, hang on each other and are summed in one
   small table; sums along a line are running totals from its end.

Null roles and texts count as empty, a null turn comes first, and turns with one number stand in the
order of their digests. Rows with a null conv_id belong to no conversation. Repeated rows are turns
of their own. An empty table gives the root alone if there is a conversation without turns, else nothing.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import slices, staged
from partforge.operators.ordering import RUN_BITS, id_cells, running_totals

LEAST = 1 << 12  # rows that may always pass or lie below a light node; in larger tables
LINES = 1 << 20  # the rows divided by this, so that there are no more heavy lines
SHARD = 1 << 16  # nodes of a shard, and at most one piece more
LANES = 6
PIECE_BITS = 10  # ids in a piece of a list
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct names (rows of two 64-bit integers), without a gap."""

    def __init__(self, names: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, taken = names, 0
        while len(left):
            at = self.place(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.names = np.zeros_like(names)
        self.names[self.slots(names, verify=False)] = names

    @staticmethod
    def place(names: np.ndarray, level: int, room: int) -> np.ndarray:
        x = names[:, 0] + (names[:, 1] ^ np.uint64(level + 1)) * M1
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return ((x ^ (x >> np.uint64(31))) % np.uint64(room)).astype(np.int64)

    def slots(self, names: np.ndarray, verify: bool = True) -> np.ndarray:
        """The slot of each name, -1 for one that is not in the table."""
        found, open_ = np.full(len(names), -1, np.int64), np.arange(len(names))
        for level, (alone, rank) in enumerate(self.levels):
            at = self.place(names[open_], level, len(alone))
            hit = alone[at]
            found[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        if verify:
            known = found >= 0
            known[known] = (self.names[found[known]] == names[known]).all(axis=1)
            found[~known] = -1
        return found


def upwards(parent: np.ndarray, depth: np.ndarray, sums: np.ndarray) -> None:
    """Add every slot's sums to its parent's, deepest first."""
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for rows in np.split(order, ends):
        rows = rows[parent[rows] >= 0]
        np.add.at(sums, parent[rows], sums[rows])


def names_of(column: pa.Array) -> np.ndarray:
    """Names of 16 bytes as two integers each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


SUMMED = "name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
ROOT_SUMS = ", parent binary, top boolean"


def shard_sums(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces of a task, shard by shard.

    Rows are (piece, name, parent, conv_id, depth, n_convs, bytes), partly counted and ordered by piece.
    """
    held, size, last = [], 0, None

    def summed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        names, parents = names_of(table["name"]), names_of(table["parent"])
        table_of = PerfectHash(np.unique(names, axis=0))
        slot, n = table_of.slots(names), len(table_of.names)
        column = lambda c: table[c].to_numpy()
        counts, conv = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        np.add.at(counts, slot, column("n_convs"))
        np.minimum.at(conv, slot, column("conv_id"))
        depth, size_of, parent, at = (np.zeros(n, np.int64) for _ in range(4))
        depth[slot], size_of[slot], parent[slot] = column("depth"), column("bytes"), table_of.slots(parents)
        at[slot] = np.arange(len(slot))
        below = parent >= 0
        children = np.bincount(parent[below], minlength=n)
        sums = np.stack([(children == 0).astype(np.int64), (counts - 1) * size_of], axis=1)
        upwards(parent, depth, sums)
        parent_conv = pa.array(conv[parent], mask=~below)
        made = [
            table["name"].take(at), conv, depth, parent_conv, counts, children, sums[:, 0], sums[:, 1],
            table["parent"].take(at), ~below,
        ]
        made = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in made]
        fields = [x.split()[0] for x in (SUMMED + ROOT_SUMS).split(", ")]
        return pa.RecordBatch.from_arrays(made, fields)

    for batch in slices(batches, 1 << 13):
        pieces = batch.column(0).to_pylist()
        start = 0
        for i, piece in enumerate(pieces):
            if piece != last and size + i - start >= least:
                held.append(batch.slice(start, i - start))
                yield from summed_slices(summed())
                held, size, start = [], 0, i
            last = piece
        held.append(batch.slice(start))
        size += len(pieces) - start
    if size:
        yield from summed_slices(summed())


def summed_slices(made: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices([made], 1 << 13)


def name_of(depth: Column, lanes: list[Column]) -> Column:
    """16 bytes that name a prefix."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(",", depth, *lanes), 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (the place of a turn, from 1), digest and bytes of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).alias("bytes"),
    )
    turns = staged(turns, "turns")
    order = [F.col("turn"), F.col("digest")]
    placed = running_totals(turns, ["conv_id"], id_cells("turn", RUN_BITS), order, {"at": F.lit(1).cast("long")})
    return placed.drop("turn")


def rebuilt_turns(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with another's turns: (conv_id, size), and their turns with `size`.

    Conversation c starts with the first h turns of c - c % `every`, h being the CRC-32 of c modulo
    `most`, and goes on with its own turns after the first h.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turns = staged(turns, "placed")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    there = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    sizes = own.join(there, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    size = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    sizes = staged(sizes.select("conv_id", "base", "h", "k", size.alias("size")), "sizes")
    first = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "base")  # no key with many rows
    lent = first.join(sizes, "base").where("at <= h").select("conv_id", "at", "digest", "bytes", "size")
    kept = turns.where(F.col("at") > head).join(sizes, "conv_id")
    kept = kept.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "digest", "bytes", "size")
    return sizes.select("conv_id", "size"), staged(lent.unionByName(kept), "rebuilt")


def named_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent, bytes, size of every turn (conv_id, at, digest, bytes, size)."""
    spot = F.sha2(F.concat_ws(":", "at", "digest"), 256)
    lanes = {f"lane{i}": F.conv(F.substring("spot", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)}
    spots = turns.withColumn("spot", spot).withColumns(lanes).drop("digest", "spot")
    own = {f"own{i}": F.col(f"lane{i}") for i in range(LANES)}
    summed = running_totals(
        spots.withColumns(own), ["conv_id"], id_cells("at", RUN_BITS), [F.col("at")], {n: F.col(n) for n in lanes}
    )
    through = [F.col(f"lane{i}") for i in range(LANES)]
    before = [F.col(f"lane{i}") - F.col(f"own{i}") for i in range(LANES)]
    return summed.select(
        "conv_id", F.col("at").alias("depth"), name_of(F.col("at"), through).alias("name"),
        name_of(F.col("at") - 1, before).alias("parent"), "bytes", "size",
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the SHA-256 of the ascending conv_ids of a name, with commas between.

    Ids come in ranges that are joined up first; what one task hashes for a name is a stream of these.
    """
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")
    cells = ends.groupBy("name", F.shiftright("conv_id", PIECE_BITS).alias("cell")).agg(ids.alias("ids"))

    def hashed(batches):
        last, digest, made = None, None, []
        for batch in slices(batches, 1024):
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != last:
                    if last is not None:
                        made.append((last, digest.hexdigest()))
                    last, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield result(made)
            made = []
        if last is not None:
            yield result([(last, digest.hexdigest())])

    def result(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
            ["name", "ends_sha256"],
        )

    ordered = cells.repartition("name").sortWithinPartitions("name", "cell").select("name", "ids")
    return ordered.mapInArrow(hashed, "name binary, ends_sha256 string")


def line_sums(lines: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): what lines hand to the node they hang on, with all that hangs on them.

    A line hangs on one of a smaller conv_id, so that one pass from the largest on adds all up.
    """

    def summed(batches):
        rows = [b.to_pydict() for b in batches]
        conv, parent, depth, leaves, saved = (
            np.array([x for r in rows for x in r[c]], np.int64)
            for c in ("conv_id", "hangs_on", "depth", "n_leaves", "saved_tokens")
        )
        order = np.argsort(conv)
        conv, parent, depth = conv[order], parent[order], depth[order]
        sums = np.stack([leaves[order], saved[order]], axis=1)
        slot = np.searchsorted(conv, parent)
        for i in range(len(conv) - 1, -1, -1):
            sums[slot[i]] += sums[i] * (parent[i] != conv[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(parent), pa.array(depth), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
            ["conv_id", "depth", "n_leaves", "saved_tokens"],
        ).filter(pa.array(parent != conv))

    schema = "conv_id long, depth long, n_leaves long, saved_tokens long"
    return lines.repartition(1).mapInArrow(summed, schema)


def trie(sizes: DataFrame, turns: DataFrame, most: int | None = None, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, size) with turns (conv_id, at, digest, bytes, size).

    Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    total = sizes.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    most = most or max(LEAST, total // LINES)
    top = name_of(F.lit(0), [F.lit(0)] * LANES)
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), top.alias("name"),
                        F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("bytes"), "size")
    rows = staged(named_prefixes(turns).unionByName(root), "prefixes")
    ends = end_digests(rows.where("depth = size").select("name", "conv_id"))
    nodes = rows.groupBy("name", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
    )
    nodes = staged(nodes, "nodes")
    heavy, light = nodes.where(F.col("weight") > most), nodes.where(F.col("weight") <= most)

    # heavy nodes are the first of a conversation's path, so a light node's piece is the next one's
    passed = rows.where("depth > 0").join(heavy.select("name"), "name", "left_semi")
    cut = passed.groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    first = F.lit(int(total > most))  # the root's weight is the total
    cut = sizes.join(cut, "conv_id", "left").select("conv_id", F.coalesce("cut", first).alias("depth"))
    pieces = rows.join(cut, ["conv_id", "depth"]).select("conv_id", F.col("name").alias("piece"))
    dealt = light.join(pieces, "conv_id").select(
        "piece", "name", "parent", "conv_id", "depth", "n_convs", F.col("bytes").cast("long").alias("bytes")
    )
    dealt = dealt.withColumn("parent", F.coalesce("parent", F.lit(b"\0" * 16)))  # the root's parent
    sums = dealt.repartition("piece").sortWithinPartitions("piece").mapInArrow(
        lambda batches: shard_sums(batches, shard), SUMMED + ROOT_SUMS
    )
    sums = staged(sums, "sums")

    # heavy nodes, with what hangs on them
    tops = sums.where("top").select("parent", "n_leaves", "saved_tokens", F.lit(1).cast("long").alias("n_children"))
    more = heavy.where("parent is not null").select(
        "parent", *[F.lit(0).cast("long").alias(c) for c in ("n_leaves", "saved_tokens")],
        F.lit(1).cast("long").alias("n_children"),
    )
    told = tops.unionByName(more).groupBy(F.col("parent").alias("name")).agg(
        *[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]
    )
    none = F.lit(0).cast("long")
    own = (F.col("n_convs") - 1) * F.col("bytes")
    parts = heavy.join(told, "name", "left").select(
        "name", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", none).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.coalesce("saved_tokens", none) + own).alias("saved_tokens"),
    )
    parts = staged(parts, "heavy")
    owner = parts.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parts = staged(parts.join(owner, "parent", "left"), "lines")
    hangs = parts.where("parent_conv_id <> conv_id or parent_conv_id is null").select(
        "conv_id", F.coalesce("parent_conv_id", "conv_id").alias("hangs_on"), (F.col("depth") - 1).alias("depth")
    )
    lines = parts.groupBy("conv_id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    measures = ["n_leaves", "saved_tokens"]
    added = line_sums(lines.join(hangs, "conv_id")).groupBy("conv_id", "depth").agg(
        *[F.sum(c).alias(f"more_{c}") for c in measures]
    )
    full = parts.join(added, ["conv_id", "depth"], "left")
    back = -F.col("depth")
    full = staged(full.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", none) for c in measures}), "full")
    full = running_totals(full, ["conv_id"], id_cells(back, RUN_BITS), [back], {c: F.col(c) for c in measures})

    # the parents of pieces are heavy
    inner = sums.where("not top").drop("parent", "top")
    outer = sums.where("top").drop("parent_conv_id", "top").join(owner, "parent", "left").drop("parent")
    found = inner.unionByName(outer).unionByName(full.select(inner.columns))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    found = found.join(ends, "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return found.drop("name")


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are rebuilt from each other."""
    return trie(*rebuilt_turns(ordered_turns(conversations)))
