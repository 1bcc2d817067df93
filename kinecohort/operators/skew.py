"""Joining rows to a one-row-per-key table when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.sources.shared import materialize

# A key with at least this many rows is too much for one task. There are at most
# (all rows / HOT_ROWS) such keys, which bounds what is broadcast for them.
HOT_ROWS = 20_000_000
SPREAD = 4096


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    how: str = "left",
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Add the columns of ``table`` (unique per key) to ``rows``.

    ``weight`` names the column of ``table`` that holds the number of rows of the key.
    Hot keys are looked up in a broadcast of bounded size and their rows are spread by
    content over the partitions of the second join; all other keys go through that
    join, for which Catalyst picks the strategy. With ``null_safe`` null keys match
    null keys, otherwise they match nothing (and are spread too). Rows are spread by the
    hash of ``spread_by``, best a column that is unique per row; by default of all columns.

    The table is written first (unless it is ``written`` already): it is read twice, and
    the size of its files lets Catalyst broadcast a small one instead of shuffling the
    rows, which the estimate for an unfinished aggregate would not.
    """
    if not written:
        table = materialize(table, "lookup")
    values = [c for c in table.columns if c not in on and c != weight]
    packed = table.select(
        *[col(k).alias(f"_key{i}") for i, k in enumerate(on)],
        F.struct(*[col(v) for v in values]).alias("_v"),
        col(weight).alias("_w"),
    )
    keys = [(col(k), F.col(f"_key{i}")) for i, k in enumerate(on)]
    same_key = reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in keys])
    content = [col(c) for c in rows.columns]

    hot = packed.filter(F.col("_w") >= hot_rows).withColumnRenamed("_v", "_hot").drop("_w")
    scattered = F.col("_hot").isNotNull()
    if not null_safe:
        scattered = scattered | reduce(or_, [col(k).isNull() for k in on])
    place = F.xxhash64(*[col(c) for c in (spread_by or rows.columns)])
    spread = F.when(scattered, F.pmod(place, F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    marked = rows.join(F.broadcast(hot), same_key, "left").select(*content, "_hot", spread.alias("_spread"))

    cold = (
        packed.filter(F.col("_w") < hot_rows)
        .withColumnRenamed("_v", "_cold")
        .drop("_w")
        .withColumn("_home", F.lit(0).cast("long"))
    )
    joined = marked.join(cold, same_key & (F.col("_spread") == F.col("_home")), "left")
    out = joined.select(*content, F.coalesce("_hot", "_cold").alias("_v"))
    if how == "inner":
        out = out.filter(F.col("_v").isNotNull())
    elif how != "left":
        raise ValueError(f"unsupported join type: {how}")
    return out.select(*content, *[F.col(f"_v.`{v}`").alias(v) for v in values])
