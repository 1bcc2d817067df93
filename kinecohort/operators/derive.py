"""Derived features: indicators, products, ratios, bins, alternates, categories, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, floor_bin, ieee_div
from kinecohort.operators.order import ranked
from kinecohort.operators.skew import lookup_join
from kinecohort.sources.shared import materialize

MISSING = "Missing"
UNSEEN = -1.0
# Category tables up to this size become a literal map in the plan, larger ones a join.
MAP_CATEGORIES = 1_000
# Up to this many categories are numbered by one window per column, more by positions.
WINDOW_CATEGORIES = 1_000_000


def missing_indicator(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, col(source).isNull())


def product_features(df: DataFrame, products: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: col(a) * col(b) for name, (a, b) in products.items()})


def ratio_features(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Ratios with IEEE division: infinities and NaN where the denominator is zero."""
    return df.withColumns({name: ieee_div(col(a), col(b)) for name, (a, b) in ratios.items()})


def floor_bins(df: DataFrame, bins: Mapping[str, tuple[str, float]]) -> DataFrame:
    return df.withColumns({name: floor_bin(col(c), width) for name, (c, width) in bins.items()})


def half_sum_of_alternates(a: str, b: str) -> Column:
    """(a + b) / 2 with a missing one counted as 0; null if both are missing."""
    either = F.coalesce(col(a), col(b)).isNotNull()
    total = F.coalesce(col(a).cast("double"), F.lit(0.0)) + F.coalesce(col(b).cast("double"), F.lit(0.0))
    return F.when(either, total / 2)


def coalesce_alternates(df: DataFrame, first: str, second: str, into: str) -> DataFrame:
    return df.withColumn(into, F.coalesce(col(first), col(second)))


def fill_missing_category(df: DataFrame, cols: Sequence[str], value: str = MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), F.lit(value)) for c in cols})


@dataclass(frozen=True)
class OrdinalCodes:
    """Fitted categories: a table (column, category, code, n) with codes in sort order."""

    table: DataFrame
    cols: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the fitted columns by their codes; unseen categories get -1."""
        sample = self.table.limit(MAP_CATEGORIES + 1).collect()
        if len(sample) <= MAP_CATEGORIES:
            return self._by_map(df, sample)
        return self._by_join(df)

    def _by_map(self, df: DataFrame, rows) -> DataFrame:
        coded = {}
        for c in self.cols:
            pairs = [F.lit(x) for r in rows if r["column"] == c for x in (r["category"], float(r["code"]))]
            code = F.create_map(*pairs)[col(c)] if pairs else F.lit(None).cast("double")
            coded[c] = F.coalesce(code, F.lit(UNSEEN))
        return df.withColumns(coded)

    def _by_join(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            codes = self.table.filter(F.col("column") == c).select(
                F.col("category").alias(c), F.col("code").alias("_code"), F.col("n").alias("_w")
            )
            out = lookup_join(out, codes, [c], "_w")
            out = out.withColumn(c, F.coalesce(F.col("_code").cast("double"), F.lit(UNSEEN))).drop("_code")
        return out


def fit_ordinal(df: DataFrame, cols: Sequence[str]) -> OrdinalCodes:
    """Codes 0..k-1 per column in the sort order of its categories (nulls are no category)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("category")) for c in cols])
    )
    counts = (
        df.select(pairs.alias("p"))
        .select("p.*")
        .filter(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = materialize(counts, "categories")
    if counts.count() <= WINDOW_CATEGORIES:
        code = F.row_number().over(Window.partitionBy("column").orderBy("category")) - 1
        return OrdinalCodes(counts.withColumn("code", code), tuple(cols))
    coded = ranked(counts, ["column"], ["category"], "code").drop("code_start", "code_size")
    return OrdinalCodes(coded, tuple(cols))


def ordinal_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fit_ordinal(df, cols).transform(df)


def impute_linear_noise(
    df: DataFrame, target: str, source: str, factor: float, seed: int, per_row: bool = False
) -> DataFrame:
    """Fill nulls with ``factor * source`` plus standard normal noise.

    One draw serves all rows of a call; ``per_row`` draws for each row instead.
    """
    noise = F.randn(seed) if per_row else F.lit(float(np.random.default_rng(seed).standard_normal()))
    return df.withColumn(target, F.coalesce(col(target), col(source) * F.lit(float(factor)) + noise))
