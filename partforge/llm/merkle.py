"""Merkle manifest of a table: a digest a row, a tree a group, a tree over the groups, and a proof a row.

A row's digest is the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count,
`:` and its value. The rows of a group stand in the order of their key; as long as there is
more than one node, every `fanout` consecutive ones become the digest of their hex digests
in a row. What remains is the group's subroot, and the subroots, in the order of the group
(null first, then bytewise), likewise give the root.

Several levels are climbed at a time. A slot pivot spreads the `fanout ** levels` nodes of a
block into columns by conditional aggregates, and the levels above are digests of columns
put together. A node's siblings are the columns of its run without its own slot. On the way
back each block takes the path of its parent, by a join on the unique key of the block, so
that neither a large group nor the root is a key on which many rows meet. Blocks are tables
in the shared folder, each a `fanout ** levels`-th of the one below.

Rows with a null key come first in their group. Rows with one key stand in the order of their
digests; repeated rows are leaves of their own. A table of one row has that leaf as its root,
an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import staged
from partforge.operators.ordering import id_cells, running_totals

FANOUT = 2
LEVELS = 4  # levels in a block
PATH = "array<struct<before string, after string>>"


def field(value: Column) -> Column:
    """A value as it goes into a row's digest."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def run_before(cells: Column, own: Column, fanout: int) -> Column:
    """The nodes of a run before its node `own`, in a row."""
    start = own - F.pmod(own, F.lit(fanout))
    return F.array_join(F.slice(cells, start + 1, own - start), "")


def run_after(cells: Column, own: Column, fanout: int) -> Column:
    """The nodes of a run after its node `own`, in a row."""
    left = F.lit(fanout - 1) - F.pmod(own, F.lit(fanout))
    return F.array_join(F.slice(cells, own + 2, left), "")


def digest_of_run(nodes: Column, fanout: int) -> Callable[[Column], Column]:
    """What a run of nodes becomes, by its number."""
    return lambda run: F.sha2(F.array_join(F.slice(nodes, run * fanout + 1, F.lit(fanout)), ""), 256)


def climbed(spread: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Blocks (tree, idx, c0, c1, ...) with the digests of each level, `depth`, how many levels they climb, and `digest`.

    A block that is the whole tree stops at one node; only first blocks can be that.
    """
    last = spread.groupBy("tree").agg(F.max("idx").alias("last"))
    first = spread.where("idx = 0").join(last, "tree")
    nodes = F.array_compact(F.array(*[f"c{i}.digest" for i in range(fanout**levels)]))  # a block fills from the left
    held = F.size(nodes)
    steps = reduce(lambda e, d: F.when(held <= fanout**d, d).otherwise(e), range(levels - 1, -1, -1), F.lit(levels))
    first = first.withColumn("depth", F.when(F.col("last") == 0, steps).otherwise(levels)).drop("last")
    made = first.unionByName(spread.where("idx > 0").withColumn("depth", F.lit(levels))).withColumn("level0", nodes)
    for at in range(1, levels + 1):
        below = F.col(f"level{at - 1}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
        made = made.withColumn(f"level{at}", F.transform(runs, digest_of_run(below, fanout)))
    tops = F.array(*[F.get(f"level{i}", F.lit(0)) for i in range(levels + 1)])
    return made.withColumn("digest", F.get(tops, F.col("depth")))


def grown(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The blocks of all trees over `nodes` (tree, idx, digest, other columns), from the leaves up."""
    width, blocks = fanout**levels, []
    while True:
        rest = [c for c in nodes.columns if c not in ("tree", "idx", "digest")]
        slot, child = F.pmod("idx", F.lit(width)), F.struct("digest", *rest)
        spread = nodes.groupBy("tree", F.expr(f"idx div {width}").alias("idx")).agg(
            *[F.max(F.when(slot == i, child)).alias(f"c{i}") for i in range(width)]
        )
        spread = staged(spread, "blocks")
        blocks.append(climbed(spread, fanout, levels))
        if not spread.agg(F.max("idx")).first()[0]:
            return blocks
        nodes = blocks[-1].select("tree", "idx", "digest")


def descended(blocks: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves with their paths and the other columns of their trees.

    `tops` are (tree, path, other columns), the path being what follows a tree's own root.
    """
    width = fanout**levels
    held = tops.withColumn("idx", F.lit(0).cast("long"))
    others = [c for c in tops.columns if c not in ("tree", "path")]
    for block in reversed(blocks):
        nodes = F.array(*[f"c{i}" for i in range(width)])
        at = block.join(held, ["tree", "idx"]).select("*", F.posexplode(nodes).alias("slot", "node"))
        steps = []
        for level in range(levels):
            own = F.expr(f"slot div {fanout**level}").cast("int")
            cells = F.col(f"level{level}")
            steps.append(F.struct(run_before(cells, own, fanout).alias("before"), run_after(cells, own, fanout).alias("after")))
        path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("depth")), F.col("path"))
        held = at.where("node is not null").select(
            "tree", (F.col("idx") * width + F.col("slot")).alias("idx"), path.alias("path"), *others, "node"
        )
        if block is not blocks[0]:
            held = held.drop("node")
    return held.select("tree", "idx", "node.*", "path", *others)


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`rows` (key, group, leaf, other columns) with subroot, root and path.

    `leaf` is a row's digest. The path has a step a level up to the root: the siblings before
    and after, in a row.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))  # null first
    leaves = staged(rows.withColumn("tree", tree), "leaves")
    one = {"idx": F.lit(1).cast("long")}
    placed = running_totals(leaves, ["tree"], id_cells("key"), [F.col("key"), F.col("leaf")], one)
    nodes = placed.select("tree", (F.col("idx") - 1).alias("idx"), F.col("leaf").alias("digest"),
                          F.struct(*rows.columns).alias("row"))
    blocks = grown(nodes, fanout, levels)

    subroots = blocks[-1].select(F.col("tree").alias("member"), "digest")
    order = F.col("member")
    ranked = running_totals(subroots, [], [F.left(order, F.lit(2)), F.left(order, F.lit(4))], [order], one)
    above = grown(
        ranked.select(F.lit("").alias("tree"), (F.col("idx") - 1).alias("idx"), "digest", "member"), fanout, levels
    )
    root = above[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = descended(above, root, fanout, levels)
    tops = tops.select(F.col("member").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return descended(blocks, tops, fanout, levels).select("row.*", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings on a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def checked_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and for each the root that a tampered or else its own leaf folds to.

    Where 7 divides the CRC-32 of doc_id, the tampered row has one character more in n_chars.
    """
    told = F.col("n_chars").cast("decimal(20,0)")
    rest = [F.col(c) for c in ("doc_id", "source", "lang")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & told.isNotNull()
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("lang").alias("group"),
        row_digest(*rest, told, F.col("text")).alias("leaf"),
        F.when(tampered, row_digest(*rest, told + 1, F.col("text"))).alias("tampered"),
    )
    proved = manifest(rows).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
