"""Row and value rules for the subject table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import (
    col,
    mean_horizontal,
    null_count,
    round_whole,
    starting_with,
    threshold_label,
)


def zero_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(col(c) != 0, col(c)) for c in cols})


def drop_ids(df: DataFrame, ids: Sequence[str], id: str = "id") -> DataFrame:
    """Remove the listed subjects, and rows without a subject."""
    return df.filter(~col(id).isin(list(ids)))


def null_group_for_ids(df: DataFrame, ids: Sequence[str], prefix: str, id: str = "id") -> DataFrame:
    """Null every column with the prefix for the listed subjects (and for a null subject)."""
    group = starting_with(df, prefix)
    return df.withColumns({c: F.when(~col(id).isin(list(ids)), col(c)) for c in group})


def has_series(df: DataFrame, series: DataFrame, id: str = "id", name: str = "has_series") -> DataFrame:
    """Flag the subjects that occur in ``series`` (usable inside an OR, unlike a semi join)."""
    # distinct() combines map-side, so a subject with many samples costs one row per task.
    present = series.select(col(id)).filter(col(id).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(present, id, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def completeness_filter(
    df: DataFrame,
    series: DataFrame,
    relevant: Sequence[str],
    targets: Sequence[str],
    id: str = "id",
) -> DataFrame:
    """Keep the subjects worth training on.

    A row stays if it has a series, or if it has a relevant value and, in addition, all
    targets or at least two relevant values.
    """
    flagged = has_series(df, series, id, "_has_series")
    missing = null_count(relevant)
    any_value = missing < len(relevant)
    two_values = missing < len(relevant) - 1
    all_targets = reduce(and_, [col(t).isNotNull() for t in targets])
    keep = F.col("_has_series") | (any_value & (all_targets | two_values))
    return flagged.filter(keep).select(*[col(c) for c in df.columns])


def prorate_total(
    df: DataFrame, items: Sequence[str], total: str, rounding: str = "half_up"
) -> DataFrame:
    """Add the mean item to the total once per missing item, and round."""
    filled = col(total) + mean_horizontal(items) * null_count(items)
    return df.withColumn(total, round_whole(filled, rounding))


def relabel_by_cutoffs(
    df: DataFrame, total: str, label: str, cuts: Sequence[float]
) -> DataFrame:
    """Replace a present label by the class of the total; a null total gives the last class."""
    return df.withColumn(label, F.when(col(label).isNotNull(), threshold_label(col(total), cuts)))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def select_features(df: DataFrame, exclude: Sequence[str], id: str = "id") -> list[str]:
    """Names of the feature columns: all but the excluded ones and the key."""
    dropped = {*exclude, id}
    return [c for c in df.columns if c not in dropped]


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Project to a fitted feature list, in its order; a missing feature is an error."""
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"features missing from the scored data: {absent}")
    return df.select(*[col(c) for c in [*keep, *features]])
