"""Statistics per key group, fitted once and applied to rows as z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.operators.skew import HOT_ROWS, lookup_join

ROWS = "_group_rows"
# Keeps a z-score finite where a group has no spread.
Z_EPSILON = 1e-7


def fit_group_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key group: ``m<col>`` and ``s<col>`` (1 where undefined), and its size.

    A plain aggregate: partial sums are combined before the shuffle, so a group that holds
    most of the rows costs no more than the others.
    """
    stats = []
    for c in cols:
        stats.append(F.avg(col(c)).alias(f"m{c}"))
    for c in cols:
        stats.append(F.coalesce(F.stddev_samp(col(c)), F.lit(1.0)).alias(f"s{c}"))
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(ROWS), *stats)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def apply_group_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Left-join fitted statistics to rows; null keys match only if ``null_safe``."""
    return lookup_join(df, stats, keys, ROWS, null_safe=null_safe, hot_rows=hot_rows, written=written)


def z_score(c: str) -> Column:
    return (col(c) - col(f"m{c}")) / (col(f"s{c}") + F.lit(Z_EPSILON))


def group_zscore(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    stats: DataFrame | None = None,
    null_safe: bool | None = None,
    hot_rows: int = HOT_ROWS,
    written: bool = False,
) -> DataFrame:
    """Add ``t<col>``: distance from the group mean in group standard deviations.

    Without ``stats`` they are fitted on ``df`` itself and null keys form a group of their
    own. With ``stats`` (scoring) null keys get a null score, unless ``null_safe``;
    ``written`` says that they are read from storage.
    """
    if null_safe is None:
        null_safe = stats is None
    if stats is None:
        stats = fit_group_stats(df, keys, cols)
    joined = apply_group_stats(df, stats, keys, null_safe, hot_rows, written)
    return joined.select(*[col(c) for c in df.columns], *[z_score(c).alias(f"t{c}") for c in cols])
