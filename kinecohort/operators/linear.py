"""Least squares from moments: one scan gives the fits of all folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, threshold_label
from kinecohort.sources.shared import materialize


@dataclass(frozen=True)
class Moments:
    """Rows, means, and sums of products of deviations from them, of the features and (last) the label."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        return Moments(n, mean, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass(frozen=True)
class LinearFit:
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, names: Sequence[str]) -> Column:
        terms = [col(c) * F.lit(w) for c, w in zip(names, self.coefficients)]
        return reduce(add, terms, F.lit(self.intercept))


def moments(df: DataFrame, names: Sequence[str], label: str = "y", by: str | None = None) -> dict[object, Moments]:
    """Moments per value of ``by`` (or of all rows, under None) in one aggregate, centred as the rows are read.

    A row whose label or a feature is null or NaN is left out.
    """
    columns = [col(c).cast("double") for c in [*names, label]]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in columns])
    k = len(columns)
    plain = df.filter(whole).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], (col(by) if by else F.lit(None)).alias("k"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs]
    out = {}
    for r in plain.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)], *products).collect():
        scatter = np.zeros((k, k))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = r[f"s{i}_{j}"] * r["n"]
        out[r["k"]] = Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(k)]), scatter)
    return out


def solve(m: Moments) -> LinearFit:
    """Least squares with an intercept; of equally good ones, the shortest coefficients."""
    x = m.scatter[:-1, :-1]
    # Features of any unit: solved on standardised ones.
    unit = np.sqrt(np.where(np.diag(x) > 0, np.diag(x), 1.0))
    w = np.linalg.lstsq(x / np.outer(unit, unit), m.scatter[:-1, -1] / unit, rcond=1e-12)[0] / unit
    return LinearFit(tuple(float(v) for v in w), float(m.mean[-1] - w @ m.mean[:-1]))


def fit_linear(df: DataFrame, names: Sequence[str], label: str = "y") -> LinearFit:
    """Least squares on all rows; without any, zero."""
    found = moments(df, names, label)
    return solve(found[None]) if found else LinearFit((0.0,) * len(names), 0.0)


def linear_out_of_fold(
    folded: DataFrame, names: Sequence[str], cuts: Sequence[float], label: str = "y", fold: str = "fold"
) -> tuple[DataFrame, dict[object, LinearFit], LinearFit]:
    """Out-of-fold table (id, fold, y, raw, label), the fit that left out each fold, and the fit on all rows.

    ``folded`` (id, fold, y and the features) is read once for the moments of each fold, of which all fits are made: that without a fold
    is the sum of the other folds' moments. A second read scores every row by its own fold's fit, in one
    narrow step. With a single fold nothing is left to learn from, and the scores are zero.
    """
    each = moments(folded, names, label, fold)
    nothing = Moments(0.0, np.zeros(len(names) + 1), np.zeros((len(names) + 1,) * 2))

    def without(k: object) -> LinearFit:
        rest = reduce(add, [m for f, m in each.items() if f != k], nothing)
        return solve(rest) if rest.n else LinearFit((0.0,) * len(names), 0.0)

    fits = {k: without(k) for k in each}
    whole = solve(reduce(add, each.values(), nothing)) if each else LinearFit((0.0,) * len(names), 0.0)
    raw = F.lit(None).cast("double")
    for k, fit in fits.items():
        raw = F.when(col(fold).eqNullSafe(F.lit(k)), fit.predict(names)).otherwise(raw)
    oof = folded.select("id", col(fold).alias("fold"), col(label).alias("y"), raw.alias("raw"))
    return materialize(oof.withColumn("label", threshold_label(F.col("raw"), cuts)), "oof"), fits, whole
