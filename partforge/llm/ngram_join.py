"""N-gram Jaccard self-join through R-trees over count vectors.

A document is the set of its word shingles, a point is how many shingles fall into each
of a fixed number of groups. The overlap of two sets is at most the sum of the smaller
coordinates of their points, and of a set and a box of points the sum with the box's
upper corner; so an R-tree over points finds every pair that may be similar enough, and
pairs that it lets through are verified on the sets.

Where points meet: two sets with a Jaccard similarity of at least t differ in at most D
shingles, D following from their sizes. Shingles are dealt into somewhat more than D cells, so
that at least one cell has the same shingles in both, and a set enters the node of each of its
cells. A set with more than D cells that are not empty has such a cell in common with every set
it is similar to, so it need not enter the nodes of its empty cells, in which unrelated sets
would meet. The few sets with fewer are dealt anew into twice as many cells, and so on, where they find
each other; only after the last deal do empty cells count. Sizes are in bands of a factor of two with a number of cells each; sets near the upper edge of a band also
enter the nodes of the next band.

1. Sets with equal shingles are one class; only classes go on.
2. In each node an R-tree links the classes whose bound is high enough. Of those links a
   spanning forest is kept, never all pairs. A node that is too large is linked as a whole.
   A fixed part of the nodes goes first; of the others only those follow in which
   classes meet that are not connected yet.
3. The connected parts of that graph hold every similar pair. What is similar to a part's first class
   is connected by that. Of the rest, an R-tree over finer points finds pairs with each other and with
   what is connected, and the sets verify them; pairs that are already connected
   need no check. A part that is too large is laid out by size and cut into blocks, and a class
   meets the blocks of the sizes that can be similar to its own.
4. Components of the verified links give the result.

The text is lower-cased in A-Z; a word is `[^\\x20\\x09-\\x0D]+`. With fewer words than a
shingle has, all of them are one shingle; without words or text the set is empty and
linked with nothing. Rows with a null doc_id are counted but linked with nothing. Repeated
rows are of one class. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partforge.llm.components import connected_components
from partforge.llm.exact_dedup import maybe_in
from partforge.llm.staging import free_name, slices, staged
from partforge.operators.ordering import running_totals

# Coordinates of a point in a node, for sets below a size: with many shingles to a coordinate any two sets seem alike.
# The sizes lie below powers of two, so that sets of a band and their partners from the band before have as many.
GROUPS = [(768, 64), (1536, 256), (6144, 1024), (1 << 62, 4096)]
FINE_GROUPS, FINEST = 256, 1024  # coordinates of a point in a part, for small and for large sets
NODE_MOST = 4096  # classes in a node that are held at once
BLOCK_SHINGLES = 1 << 20  # shingles in a block of a part
LEAST_WEIGHT = 128  # what a class counts at least, for its point
SPARE = 16  # one spare cell for so many
DEALS = 6
EARLY = 16  # one node in so many goes first
LEAF = 16
MOST_WORDS = 250_000
MOST_BYTES = 64_000_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    size = 0  # bytes of the words

    def __missing__(self, word: bytes) -> int:
        self.size += len(word)
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """Those of a worker, dropped when there are too many."""
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    known = word_hashes()
    if len(known) > MOST_WORDS or known.size > MOST_BYTES:
        known.clear()
        known.size = 0
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not len(found):
        return hashes
    size = min(words, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * M1 + hashes[i : len(found) - size + 1 + i])
    return np.unique(total)


def signature(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    return blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def counts(hashes: np.ndarray, groups: int) -> np.ndarray:
    """How many of the hashes fall into each group; with half as many groups, two of these are one."""
    return np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups).astype("<u4")


def differing(total: int, num: int, den: int) -> int:
    """The most shingles in which two sets of that size together differ at similarity num / den."""
    return total * (den - num) // (den + num)


def cell_count(size: int, num: int, den: int) -> int:
    """Cells of a band: more than the shingles in which sets of at most `size` differ, even without the empty ones."""
    most = differing(2 * size, num, den)
    return most + most // SPARE + 4


def cell_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The nodes that a set enters: one for each cell of its band, and of the next band if its partners may be there.

    Sets whose filled cells do not suffice enter those of another deal as well, in the end also the empty ones.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    band, keys, parts = n.bit_length(), [], mixed(hashes ^ M1)
    for at in (band, band + 1):
        if at > band and n * den < num << band:
            break
        largest = (1 << at) - 1  # of the sets that meet here
        most = differing(n + min(largest, n * den // num), num, den)
        for deal in range(DEALS):
            cells = cell_count(largest, num, den) << deal
            dealt = mixed(hashes + np.uint64(deal) * M2) if deal else hashes
            cell = (dealt % np.uint64(cells)).astype(np.int64)
            sums = np.zeros(cells, np.uint64)
            np.add.at(sums, cell, parts)
            found = mixed(sums + mixed(np.arange(cells, dtype=np.uint64) * M1 + np.uint64(at + 64 * deal)))
            filled = np.bincount(cell, minlength=cells) > 0
            keys.append(found[filled])
            if filled.sum() > most:
                break
        else:
            keys.append(found[~filled])
    return np.concatenate(keys).astype(np.int64)


def needed(sizes: np.ndarray | int, size: int, num: int, den: int) -> np.ndarray:
    """The least overlap of sets of these sizes with that similarity."""
    return -(-(np.asarray(sizes) + size) * num // (num + den))


class RTree:
    """A bulk-loaded R-tree over count vectors, searched by overlap."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.num, self.den = points, sizes, num, den
        self.leaves: list[np.ndarray] = []
        self.divide(np.arange(len(points)))
        self.order = np.concatenate(self.leaves)
        bounds = np.cumsum([0, *map(len, self.leaves)])
        low = np.minimum.reduceat(sizes[self.order], bounds[:-1])
        high = np.maximum.reduceat(points[self.order], bounds[:-1], axis=0)
        self.levels = [(bounds, low, high)]
        while len(low) > 1:  # boxes of boxes
            bounds = np.append(np.arange(0, len(low), LEAF), len(low))
            low, high = np.minimum.reduceat(low, bounds[:-1]), np.maximum.reduceat(high, bounds[:-1], axis=0)
            self.levels.append((bounds, low, high))

    def divide(self, rows: np.ndarray) -> None:
        """Halve at the widest coordinate until a leaf is small."""
        pending = [rows]
        while pending:
            rows = pending.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            part = self.points[rows]
            wide = np.argmax(part.max(axis=0).astype(np.int64) - part.min(axis=0))
            rows = rows[np.argsort(part[:, wide], kind="stable")]
            pending += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """The rows whose overlap with a set of this point and size may suffice."""
        boxes = np.zeros(1, np.int64)
        for bounds, low, high in reversed(self.levels):
            bound = np.minimum(high[boxes], point).sum(axis=1, dtype=np.int64)
            boxes = boxes[bound >= needed(low[boxes], size, self.num, self.den)]
            if not len(boxes):
                return boxes
            boxes = np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in boxes])
        rows = self.order[boxes]
        bound = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
        return rows[bound >= needed(self.sizes[rows], size, self.num, self.den)]


def forest(points: np.ndarray, sizes: np.ndarray, num: int, den: int,
           linked: Callable[[int, int], bool] | None = None,
           joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bound suffices and, if given, that `linked` confirms.

    The rows in `joined` are connected already.
    """
    tree, root, edges = RTree(points, sizes, num, den), np.arange(len(sizes)), []
    if joined is not None and len(joined):
        root[joined] = joined[0]
    for i in range(len(sizes)):
        found = tree.search(points[i], int(sizes[i]))
        found = found[(found > i) & (root[found] != root[i])]
        while len(found):
            j, found = int(found[0]), found[1:]
            if linked is None or linked(i, j):
                edges.append((i, j))
                root[root == root[j]] = root[i]
                found = found[root[found] != root[i]]
    return edges


def by_group(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal keys, as they come; a long group comes in several runs."""
    for batch in slices(batches, 2048):
        columns = [batch.column(k).to_pylist() for k in keys]
        start, rows = 0, list(zip(*columns, strict=True))
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], batch.slice(start, i - start)
                start = i


def stored(hashes: np.ndarray) -> bytes:
    """The point of a set: the bytes of a coordinate, and the coordinates, more of them for larger sets."""
    groups = next(g for most, g in GROUPS if len(hashes) < most)
    point = counts(hashes, groups)
    kind = np.uint8 if point.max() < 256 else np.dtype("<u4")
    return bytes([np.dtype(kind).itemsize]) + point.astype(kind).tobytes()


def vectors(column: list[bytes]) -> np.ndarray:
    """Stored points side by side, folded to the fewest coordinates that one of them has."""
    points = [np.frombuffer(x, np.uint8 if x[0] == 1 else "<u4", offset=1) for x in column]
    groups = min(map(len, points))
    return np.stack([x.reshape(-1, groups).sum(axis=0, dtype=np.uint32) for x in points])


EDGES = "a string, b string"


def edge_batch(edges: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.string()) for i in (0, 1)], ["a", "b"])


def bounded_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect, in each node `key`, the classes (node, n, point) whose bound suffices."""

    def linked(batches):
        current, held, first, edges = None, [], None, []

        def close():
            if first is None and held:
                names = [x for b in held for x in b.column("node").to_pylist()]
                if len(names) > 1:
                    points = vectors([x for b in held for x in b.column("point").to_pylist()])
                    sizes = np.concatenate([b.column("n").to_numpy() for b in held])
                    edges.extend((names[i], names[j]) for i, j in forest(points, sizes, num, den))

        for key, run in by_group(batches, ["key"]):
            if key != current:
                close()
                current, held, first = key, [], None
            held.append(run)
            if first is not None or sum(b.num_rows for b in held) > NODE_MOST:  # link the node as a whole
                first = first or held[0].column("node")[0].as_py()
                edges.extend((first, x) for b in held for x in b.column("node").to_pylist())
                held = []
            if len(edges) > 4096:
                yield edge_batch(edges)
                edges.clear()
        close()
        yield edge_batch(edges)

    ordered = members.repartition(F.col("key")).sortWithinPartitions("key", "n", "node")
    return ordered.mapInArrow(linked, EDGES)


def similarity(num: int, den: int) -> Callable[[np.ndarray, np.ndarray], bool]:
    def similar(one: np.ndarray, two: np.ndarray) -> bool:
        both = len(np.intersect1d(one, two, assume_unique=True))
        return den * both >= num * (len(one) + len(two) - both)

    return similar


def links_to_first(parts: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) of a part's first class, whose name is the part's, and the classes (part, node, spread, shingles) similar to it.

    Each group (part, spread) holds the first class; the others stream past it.
    """
    similar = similarity(num, den)

    def linked(batches):
        first, held = None, None
        for batch in slices(batches, 1024):
            edges = []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for part, node, raw in zip(*columns, strict=True):
                found = np.frombuffer(raw, "<u8")
                if node == part:
                    first, held = part, found
                elif part == first and similar(held, found):
                    edges.append((part, node))
            yield edge_batch(edges)

    ordered = parts.repartition("part", "spread").sortWithinPartitions("part", "spread", F.col("node") != F.col("part"))
    return ordered.mapInArrow(linked, EDGES)


def verified_links(parts: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect, in each pair of blocks of a part, the classes (node, loose, shingles) that are similar.

    Classes that are not `loose` are connected already.
    """
    similar = similarity(num, den)

    def linked(batches):
        current, names, sets, joined, edges = None, [], [], [], []

        def close():
            if len(names) < 2:
                return
            sizes = np.array([len(x) for x in sets])
            groups = min(FINEST, max(FINE_GROUPS, 1 << int(sizes.max() >> 3).bit_length()))
            points = np.stack([counts(x, groups) for x in sets])
            found = forest(points, sizes, num, den, lambda i, j: similar(sets[i], sets[j]), np.array(joined, np.int64))
            edges.extend((names[i], names[j]) for i, j in found)

        for key, run in by_group(batches, ["part", "one", "two"]):
            if key != current:
                close()
                current, names, sets, joined = key, [], [], []
            rows = (run.column(c).to_pylist() for c in ("node", "loose", "shingles"))
            for name, loose, raw in zip(*rows, strict=True):
                if not names or name != names[-1]:  # repeated rows stand side by side
                    if not loose:
                        joined.append(len(names))
                    names.append(name)
                    sets.append(np.frombuffer(raw, "<u8"))
            if len(edges) > 4096:
                yield edge_batch(edges)
                edges.clear()
        close()
        yield edge_batch(edges)

    ordered = parts.repartition("part", "one", "two").sortWithinPartitions("part", "one", "two", "node")
    return ordered.mapInArrow(linked, EDGES)


def with_sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n, node, point and keys of every row; a set that its task had before has no keys again."""

    def described(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            sizes, nodes, points, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, words)
                name = signature(hashes)
                again = name in seen or not len(hashes)
                seen.add(name)
                sizes.append(len(hashes))
                nodes.append(name.hex())
                points.append(None if again else stored(hashes))
                keys.append(None if again else cell_keys(hashes, num, den))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.string()),
                pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], ["doc_id", "n", "node", "point", "keys"])

    schema = "doc_id long, n long, node string, point binary, keys array<long>"
    return docs.select("doc_id", "text").mapInArrow(described, schema)


def in_blocks(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """part, node and the blocks `first` to `last` of the part that may hold a similar class; `own` is one of these.

    The classes (part, node, n) of a part are laid out by size, and every `block` shingles are one block. A class
    can be similar only to classes of a range of sizes, so it meets the blocks of that range.
    """
    n = F.col("n")
    ends = F.array(
        F.struct(F.ceil(n * num / den).cast("long").alias("size"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("before")),
        F.struct(n.alias("size"), F.lit(1).alias("kind"), F.greatest(n, F.lit(LEAST_WEIGHT)).cast("long").alias("before")),
        F.struct(F.floor(n * den / num).cast("long").alias("size"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("before")),
    )
    laid = members.select("part", "node", F.inline(ends)).withColumn("weight", F.col("before"))
    order = [F.col("size"), F.col("kind"), F.col("node")]
    laid = running_totals(laid, ["part"], [F.shiftright("size", 6)], order, {"before": F.col("before")})
    # the sum up to an end; before a class itself, and before the end of what stands in front of it
    at = F.floor(F.greatest(F.col("before") - F.when(F.col("kind") == 0, 0).otherwise(F.greatest("weight", F.lit(1))), F.lit(0)) / block)
    spots = [F.max(F.when(F.col("kind") == i, at)).cast("int").alias(c) for i, c in enumerate(("first", "own", "last"))]
    return laid.groupBy("part", "node").agg(*spots)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """The rows of `docs` (node, text, other columns) whose text has the set named, with its shingles for the text."""
    kept = [c for c in docs.columns if c != "text"]
    at, text = kept.index("node"), len(kept)
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("shingles", T.BinaryType())])

    def found(batches):
        for batch in slices(batches):
            sets = [shingles(x, words) for x in batch.column(text).to_pylist()]
            same = [signature(x).hex() == y for x, y in zip(sets, batch.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:text], pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())],
                [*kept, "shingles"],
            ).filter(pa.array(same, pa.bool_()))

    return docs.select(*kept, "text").mapInArrow(found, schema)


def set_of(node: Column) -> Column:
    """Half of a set's name, as a number; a mix-up only adds candidates."""
    return F.conv(F.substring(node, 1, 16), 16, -10).cast("long")


def meeting(entered: DataFrame, what: str) -> DataFrame:
    """The rows of the nodes `key` that hold more than one value of a column."""
    node = W.partitionBy("key")
    both = entered.withColumns({"low": F.min(what).over(node), "high": F.max(what).over(node)})
    return both.where("low < high").drop("low", "high")


def once(nodes: DataFrame) -> DataFrame:
    """(key, set) of the nodes, one for each different content."""
    content = nodes.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("x"),
        F.sum(F.xxhash64("set", F.lit(2)).cast("decimal(38,0)")).alias("s"),
    )
    return nodes.join(content.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key"), "key")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100,
                    block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text), for a similarity of num / den."""
    rows = staged(with_sets(docs, words, num, den), "sets")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("node", "n").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes, "classes")

    # nodes in which different classes meet
    entered = rows.select(F.explode("keys").alias("key"), set_of(F.col("node")).alias("set"))
    met = staged(meeting(entered, "set").select("key", "set").distinct(), "met")
    points = rows.where("keys is not null").select(set_of(F.col("node")).alias("set"), "node", "n", "point")

    def links(nodes: DataFrame) -> DataFrame:
        groups = staged(once(nodes), "nodes")
        held = points.join(groups.select("set").distinct(), "set", "left_semi").dropDuplicates(["set", "node"])
        return staged(bounded_links(groups.join(held, "set"), num, den), "links")

    # a part of the nodes first: what they connect need not meet again in all the others
    early = links(met.where(F.col("key").bitwiseAND(F.lit(EARLY - 1)) == 0))
    known = connected_components(early).groupBy(set_of(F.col("node")).alias("set")).agg(F.min("label").alias("label"))
    named = met.join(known, "set", "left").withColumn("label", F.coalesce("label", F.col("set").cast("string")))
    late = links(staged(meeting(named, "label").select("key", "set"), "late"))
    coarse = connected_components(early.unionByName(late))

    # the sets of the classes that may be similar to another
    members = coarse.join(classes, "node").select(F.col("label").alias("part"), "node", "n", "rep")
    members = staged(members, "members")
    def with_texts(wanted: DataFrame) -> DataFrame:
        some = staged(wanted, "wanted")
        return maybe_in(docs.select("doc_id", "text"), some, "doc_id", "maybe").where("maybe").join(some, "doc_id")

    # a large part is mostly copies of one text: what is similar to its first class is connected
    blocks = members.groupBy("part").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    spread = F.when(F.col("node") == F.col("part"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    all_texts = with_texts(members.join(blocks, "part").select("part", "node", "blocks", F.col("rep").alias("doc_id")))
    spread_out = sets_of(all_texts.drop("doc_id", "maybe"), words).select("part", "node", F.explode(spread).alias("spread"), "shingles")
    star = staged(links_to_first(spread_out, num, den).distinct(), "star")

    # the others meet each other and what is connected, by blocks
    joined = star.select(F.col("a").alias("part"), F.col("b").alias("node")).unionByName(
        members.select("part", F.col("part").alias("node")).distinct()
    )
    loose = members.join(joined, ["part", "node"], "left_anti").select("part", "node")
    left = members.join(loose.select("part").distinct(), "part", "left_semi")
    placed = in_blocks(left, num, den, block).join(loose.withColumn("loose", F.lit(True)), ["part", "node"], "left")
    placed = staged(placed.withColumn("loose", F.coalesce("loose", F.lit(False))), "placed")
    where_loose = placed.where("loose").select("part", F.col("own").alias("other")).distinct().withColumn("there", F.lit(True))
    meets = placed.select("part", "node", "loose", "own", F.explode(F.sequence("first", "last")).alias("other"))
    meets = meets.join(where_loose, ["part", "other"], "left").where("loose or there")
    meets = meets.groupBy("part", "node", "loose", "own").agg(F.collect_set("other").alias("others"))
    some_texts = with_texts(meets.join(members.select("part", "node", F.col("rep").alias("doc_id")), ["part", "node"]))
    parts = (
        sets_of(some_texts.drop("doc_id", "maybe"), words)
        .select("part", "node", "loose", "shingles", "own", F.explode("others").alias("other"))
        .select("part", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
                "node", "loose", "shingles")
    )
    final = staged(connected_components(verified_links(parts, num, den).unionByName(star)), "linked")

    named = final.join(classes, "node")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    linked = final.join(least, "label").select("node", "component")
    named = staged(
        classes.join(linked, "node", "left").select("node", F.coalesce("component", "rep").alias("component_id")),
        "components",
    )
    plain = rows.select("doc_id", "n", "node")
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    alone = plain.where(~some).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = plain.where(some).join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` without those that are linked to a smaller doc_id, with all their columns."""
    found = near_duplicates(docs, words, num, den)
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    flag = free_name(docs, "__maybe_gone")
    rows = maybe_in(docs, gone, "doc_id", flag)
    some = rows.where(F.col(flag)).join(gone, "doc_id", "left_anti")
    return rows.where(~F.col(flag)).select(*docs.columns).unionByName(some.select(*docs.columns))
