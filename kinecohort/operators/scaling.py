"""Standardising columns with fitted means and deviations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col

# Keeps the result finite where a column is constant.
SCALE_EPSILON = 1e-10


@dataclass(frozen=True)
class Standardizer:
    """Fitted mean and sample standard deviation per column (None where undefined)."""

    means: dict[str, float | None]
    stds: dict[str, float | None]

    @property
    def cols(self) -> list[str]:
        return list(self.means)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (col(c) - F.lit(self.means[c]).cast("double"))
                / (F.lit(self.stds[c]).cast("double") + F.lit(SCALE_EPSILON))
                for c in self.cols
            }
        )


def fit_standardizer(df: DataFrame, cols: Sequence[str]) -> Standardizer:
    """One aggregate over all columns; what comes to the driver is two numbers per column."""
    row = df.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return Standardizer(
        {c: row[f"m{i}"] for i, c in enumerate(cols)}, {c: row[f"s{i}"] for i, c in enumerate(cols)}
    )


def standardize(
    df: DataFrame, cols: Sequence[str], scaler: Standardizer | None = None
) -> tuple[DataFrame, Standardizer]:
    scaler = scaler or fit_standardizer(df, cols)
    return scaler.transform(df), scaler
