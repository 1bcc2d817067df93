"""Row order without a task per group: positions, ranks, blocks and running sums.

A window partitioned by subject puts all rows of a subject into one task, which does not
work when one subject holds a third of the data. Here the rows are range-partitioned on
(keys, order) instead, which splits large groups, and every row gets its position in the
whole sorted table. Blocks of a fixed number of consecutive positions are then the unit
of work, whatever the group sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.operators.skew import HOT_ROWS, lookup_join
from kinecohort.sources.shared import materialize

POSITION = "_pos"
BLOCK = "_block"
HALO = "_halo"
BLOCK_ROWS = 16_384

# monotonically_increasing_id() keeps the partition number above bit 33.
_PARTITION_SHIFT = 33


def positioned(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their 0-based position in the table sorted by ``order``.

    ``order`` must be unique per row for the positions to be repeatable. The sorted copy
    is written to the shared folder: positions must not be evaluated twice with two
    different samples of range bounds.
    """
    by = [col(c) for c in order]
    # No partition number: adaptive execution may join neighbouring small ranges.
    laid_out = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    laid_out = materialize(laid_out, "sorted").withColumn(
        "_part", F.shiftright("_row", _PARTITION_SHIFT)
    )
    # One row per range partition: small whatever the data, so one window and a broadcast do.
    starts = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_start"),
        )
    )
    offset = F.col("_row").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        laid_out.join(F.broadcast(starts), "_part")
        .select(*[col(c) for c in df.columns], (F.col("_start") + offset).alias(POSITION))
    )


def block_of(rows: int) -> Column:
    return F.floor(F.col(POSITION) / F.lit(rows))


def blocks(
    df: DataFrame, order: Sequence[str], halo: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows in blocks of consecutive positions, each led by the last ``halo`` rows before it.

    Adds ``_pos``, ``_block`` and ``_halo`` (true on the repeated rows). A frame of up to
    ``halo`` preceding rows can be evaluated over (``_block``, keys) ordered by ``_pos``;
    the repeated rows are dropped afterwards.
    """
    rows = max(block_rows, halo)
    return in_blocks(positioned(df, order), halo, rows)


def in_blocks(positions: DataFrame, halo: int, rows: int) -> DataFrame:
    home = F.struct(block_of(rows).alias("b"), F.lit(False).alias("h"))
    ahead = F.struct((block_of(rows) + 1).alias("b"), F.lit(True).alias("h"))
    near_end = F.col(POSITION) % rows >= rows - halo
    copies = F.explode(F.when(near_end, F.array(home, ahead)).otherwise(F.array(home)))
    return positions.withColumn("_copy", copies).select(
        *[col(c) for c in positions.columns], F.col("_copy.b").alias(BLOCK), F.col("_copy.h").alias(HALO)
    )


def in_block_window(keys: Sequence[str]):
    return Window.partitionBy(BLOCK, *[col(k) for k in keys]).orderBy(POSITION)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rank", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based rank of each row within its key group; also ``<name>_size`` and ``<name>_start``."""
    positions = positioned(df, [*keys, *order])
    groups = positions.groupBy(*[col(k) for k in keys]).agg(
        F.min(POSITION).alias(f"{name}_start"),
        F.count(F.lit(1)).alias(f"{name}_size"),
        F.count(F.lit(1)).alias("_weight"),
    )
    joined = lookup_join(
        positions, groups, keys, "_weight", null_safe=True, hot_rows=hot_rows, spread_by=[POSITION]
    )
    return joined.withColumn(name, F.col(POSITION) - F.col(f"{name}_start")).drop(POSITION)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: str,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of ``amount`` over the rows before this one in its key group (0 on the first).

    Keys must not be null.
    """
    positions = positioned(df, [*keys, *order]).withColumn(BLOCK, block_of(block_rows))
    by = [col(k) for k in keys]
    before = Window.partitionBy(BLOCK, *by).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
    inside = positions.withColumn("_inside", F.coalesce(F.sum(col(amount)).over(before), F.lit(0)))
    carried = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        positions.groupBy(BLOCK, *by)
        .agg(F.sum(col(amount)).alias("_total"))
        .withColumn("_carry", F.coalesce(F.sum("_total").over(carried), F.lit(0)))
        .drop("_total")
    )
    return (
        inside.join(totals, [BLOCK, *keys])
        .withColumn(name, F.col("_inside") + F.col("_carry"))
        .select(*[col(c) for c in df.columns], name)
    )
