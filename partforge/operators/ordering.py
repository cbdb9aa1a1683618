"""Running totals, numbering, shuffling and batching without a global sort.

A rank or running sum over a whole table, or over one run that holds most of
it, must not end in one task. `running_totals` cuts the order into cells, sums
each cell, and hands every cell the sum of the cells before it as one extra
row. The rows themselves move once, keyed by cell.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells of a unique integer key are ranges of 2 ** bits values, coarse and fine.
CELL_BITS = (20, 10)
# Within runs, most of which are small, one level of wide cells costs less.
RUN_BITS = (16,)
# Hexadecimal digits of an md5 key that name a cell: 16 ** 4 cells per epoch.
CELL_DIGITS = 4


def id_cells(row_id: Column | str, bits: tuple[int, ...] = CELL_BITS) -> list[Column]:
    """Cells of a unique integer key.

    A finest cell holds at most 2 ** bits[-1] rows. The coarse cells keep the
    sums of the finer ones from piling up in one place.
    """
    return [F.shiftright(row_id, b) for b in bits]


@dataclass(frozen=True)
class Split:
    """Cells, from coarse to fine, for the rows of a finest cell that has more than `most` of them."""

    most: int
    cells: list[Column]


def running_totals(
    df: DataFrame,
    group: list[str],
    cells: list[Column],
    order: list[Column],
    measures: dict[str, Column],
    split: Split | None = None,
) -> DataFrame:
    """Add inclusive running sums of `measures` within `group`, in `order`.

    `cells` are columns from coarse to fine that rise with `order`. They bound
    what one task sorts: the rows of a finest cell, and the finer cells of a
    coarser one. With `split`, cells may be wide enough for rows that are far apart, and only
    those that turn out full are cut further.
    """
    keys = [f"_cell{i}" for i in range(len(cells))]
    ranks = [f"_order{i}" for i in range(len(order))]
    staged = df.withColumns(
        dict(zip(keys, cells)) | dict(zip(ranks, order)) | measures
    )
    names = list(measures)
    if not split:
        return _totals(staged, group, keys, ranks, names).drop(*keys, *ranks)
    finer = [f"_finer{i}" for i in range(len(split.cells))]
    staged = staged.withColumns(dict(zip(finer, split.cells)))
    return _split_totals(staged, group, keys, ranks, names, finer, split.most).drop(*keys, *ranks, *finer)


def _before(sums: DataFrame, group: list[str], keys: list[str], names: list[str]) -> DataFrame:
    """The sums of all cells before each cell, from the cells' own `sums`; other columns stay."""
    own = {f"_own_{n}": F.col(n) for n in names}
    through = _totals(sums.withColumns(own), group, keys[:-1], keys[-1:], names)
    return through.withColumns({n: F.col(n) - F.col(f"_own_{n}") for n in names}).drop(*own)


def _split_totals(
    staged: DataFrame,
    group: list[str],
    keys: list[str],
    order: list[str],
    names: list[str],
    finer: list[str],
    most: int,
) -> DataFrame:
    """As `_totals`; the rows of full cells are summed up within their cell, and take what is before it by a join."""
    within = [*group, *keys]
    sums = staged.groupBy(*within).agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("_rows"))
    before = _before(sums, group, keys, names)
    full = before.where(F.col("_rows") > most).select(
        *[F.col(c).alias(f"_full_{c}") for c in within], *[F.col(n).alias(f"_before_{n}") for n in names]
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_full_{c}")) for c in within])
    # A full cell has more than `most` rows, so there are few of them next to the rows.
    told = staged.join(F.broadcast(full.withColumn("_full", F.lit(True))), same, "left")
    extra = [c for c in told.columns if c not in staged.columns]
    rows = told.where(F.col("_full").isNull()).drop(*extra).withColumn("_carry", F.lit(False))
    carried = before.where(F.col("_rows") <= most).drop("_rows").withColumn("_carry", F.lit(True))
    rows = rows.unionByName(carried, allowMissingColumns=True)
    plain = _window_sums(rows, within, ["-carry", *order], names).filter(~F.col("_carry")).drop("_carry")
    cut = _totals(told.where(F.col("_full")), within, finer, order, names)
    cut = cut.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in names})
    return plain.unionByName(cut.drop(*extra))


def _totals(
    staged: DataFrame, group: list[str], keys: list[str], order: list[str], names: list[str]
) -> DataFrame:
    if not keys:
        return _window_sums(staged, group, order, names)
    sums = staged.groupBy(*group, *keys).agg(*[F.sum(n).alias(n) for n in names])
    before = _before(sums, group, keys, names).withColumn("_carry", F.lit(True))
    rows = staged.withColumn("_carry", F.lit(False)).unionByName(before, allowMissingColumns=True)
    summed = _window_sums(rows, [*group, *keys], ["-carry", *order], names)
    return summed.filter(~F.col("_carry")).drop("_carry")


def _window_sums(
    df: DataFrame, group: list[str], order: list[str], names: list[str]
) -> DataFrame:
    by = [F.col("_carry").desc() if o == "-carry" else F.col(o).asc() for o in order]
    so_far = (
        Window.partitionBy(*group)
        .orderBy(*by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({n: F.sum(n).over(so_far) for n in names})


def number_outputs(
    df: DataFrame, run: str = "run", row_id: str = "row_id", name: str = "ordinal"
) -> DataFrame:
    """Add the 1-based position of each row in its run."""
    return running_totals(
        df, [run], id_cells(row_id, RUN_BITS), [F.col(row_id)], {name: F.lit(1).cast("bigint")}
    )


def epochs(df: DataFrame, n: int) -> DataFrame:
    """Every row once per epoch, 1 to n."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffle_key(row_id: Column | str, seed: int, epoch: Column | str = "epoch") -> Column:
    """Sort key that puts rows into a new seeded order in each epoch."""
    return F.md5(F.concat_ws("-", F.lit(seed), epoch, row_id))


def shuffle_epochs(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Add `rank`, the 1-based place of a row in the seeded order of its epoch."""
    key = shuffle_key(row_id, seed)
    return running_totals(
        df,
        ["epoch"],
        [F.left(key, F.lit(CELL_DIGITS))],
        [key, F.col(row_id)],
        {"rank": F.lit(1).cast("bigint")},
    )


def assign_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """Add `batch`, from 0: consecutive ranks in chunks; the last batch of an epoch may be short."""
    return df.withColumn("batch", F.floor((F.col("rank") - 1) / batch_size))


def checkpoint_steps(steps: DataFrame, every: int) -> DataFrame:
    """Steps after which a checkpoint is saved."""
    return steps.filter(F.col("step") % every == 0)
