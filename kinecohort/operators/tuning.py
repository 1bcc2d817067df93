"""Cut points of the greatest kappa over all places where scores can be cut, without a grid.

Kappa is one minus a ratio of two sums over rows. For a guess of the ratio, the difference numerator - guess * denominator is a sum
over rows too, so the best ascending cut points follow from dynamic programming over the sorted scores; its ratio is the next
guess, until none is lower (fractional programming). Scores are sorted and counted once; a pass has blocks of them at work in
parallel, each giving the least cost of entering it with one label and leaving it with another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col
from kinecohort.operators.order import POSITION, positioned
from kinecohort.operators.scoring import _on_scale
from kinecohort.sources.shared import materialize

#: Distinct scores of a block at least, and blocks at most: the driver gets labels x labels numbers of each.
BLOCK_SCORES = 1 << 16
BLOCKS = 4096
#: Guesses at most; each is better than the one before, and a handful is usual.
GUESSES = 60


@dataclass(frozen=True)
class Cuts:
    """Kappa (None if it is undefined for all cut points) and the ascending cut points; one that no score reaches is infinite."""

    kappa: float | None
    values: tuple[float, ...]


def _costs(counts: np.ndarray, ratio: float, mean: float) -> np.ndarray:
    """What each score (row) adds to the difference under each label (column). counts: rows per score and true label."""
    labels = counts.shape[1]
    y, p = np.arange(labels)[:, None], np.arange(labels)[None, :]
    return counts @ ((y - p) ** 2 - ratio * (p**2 - 2 * mean * p))


def _block(scores: np.ndarray, counts: np.ndarray, ratio: float, mean: float) -> list[tuple[int, int, float, list[float]]]:
    """enter, leave, least cost, and the scores from which the labels above `enter` hold."""
    upto = np.vstack([np.zeros(counts.shape[1]), np.cumsum(_costs(counts, ratio, mean), axis=0)])
    labels, m = counts.shape[1], len(scores)
    out = []
    for a in range(labels):
        best = upto[:m, a]  # of what lies before each score
        trail: list[np.ndarray] = []
        out.append((a, a, float(upto[m, a]), []))
        for b in range(a + 1, labels):
            gain = best - upto[:m, b]
            least = np.minimum.accumulate(gain)
            at = np.maximum.accumulate(np.where(np.append(True, gain[1:] < least[:-1]), np.arange(m), 0))
            trail.append(at)
            cuts, k = [], m - 1
            for own in reversed(trail):
                k = int(own[k])
                cuts.append(float(scores[k]))
            out.append((a, b, float(least[-1] + upto[m, b]), cuts[::-1]))
            best = least + upto[:m, b]
    return out


def _join(blocks: Sequence[list[tuple[int, int, float, list[float]]]], labels: int) -> list[float]:
    """The cut points of the cheapest way through all blocks, which starts with label 0 or, by cuts of the least score, above."""
    cost, cuts = [0.0] + [np.inf] * (labels - 1), [[] for _ in range(labels)]
    for block in blocks:
        then, through = [np.inf] * labels, [[] for _ in range(labels)]
        for a, b, c, own in block:
            if cost[a] + c < then[b]:
                then[b], through[b] = cost[a] + c, cuts[a] + own
        cost, cuts = then, through
    last = int(np.argmin(cost))
    return cuts[last] + [float("inf")] * (labels - 1 - last)


def _ratio(table: np.ndarray) -> Fraction | None:
    """Disagreement over what chance gives, of the counts per (true, predicted) label; None if chance gives none."""
    n = table.sum()
    apart = squares = 0
    for y, p in np.ndindex(*table.shape):
        apart += int(table[y, p]) * (y - p) ** 2
        squares += int(table[y, p]) * (y * y + p * p)
    ys = sum(int(k) * i for i, k in enumerate(table.sum(axis=1)))
    ps = sum(int(k) * i for i, k in enumerate(table.sum(axis=0)))
    chance = squares - Fraction(2 * ys * ps, int(n))
    return Fraction(apart) / chance if chance else None


def exact_thresholds(df: DataFrame, y: str, raw: str, labels: int = 4, block_scores: int = BLOCK_SCORES) -> Cuts:
    """The cut points of the greatest quadratic kappa among all.

    A row gets as many labels up as there are cut points up to its score; null and NaN get the highest label. Every label of the
    scale 0 .. labels-1 must occur among the true ones, or the scale of the kappa would depend on the cut points: otherwise, as for a
    label off the scale, an error. Among equal ones the result is repeatable. No rows: kappa is None, cut points infinite.
    """
    score = F.when(~F.isnan(col(raw)), col(raw).cast("double") + F.lit(0.0))
    rows = df.select(_on_scale(col(y), labels).alias("y"), score.alias("score"))
    cells = rows.groupBy("score").agg(*[F.count_if(F.col("y") == v).alias(f"n{v}") for v in range(labels)])
    cells = materialize(cells, "scores")
    names = [f"n{v}" for v in range(labels)]
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    unscored = [F.coalesce(F.sum(F.when(F.col("score").isNull(), F.col(n))), F.lit(0)).alias(f"u{n}") for n in names]
    row = cells.agg(F.count("score").alias("k"), *sums, *unscored).first()
    totals = np.array([row[n] for n in names], np.int64)
    none = np.array([row[f"u{n}"] for n in names], np.int64)
    never = (float("inf"),) * (labels - 1)
    if not totals.sum():
        return Cuts(None, never)
    if not totals.all():
        raise ValueError(f"labels without a row: {[v for v in range(labels) if not totals[v]]}")
    mean = float(Fraction(int(sum(v * int(k) for v, k in enumerate(totals))), int(totals.sum())))
    if not row["k"]:
        return Cuts(0.0, never)
    size = max(block_scores, -(-row["k"] // BLOCKS))
    placed = positioned(cells.filter("score IS NOT NULL"), ["score"]).withColumn("_b", F.floor(F.col(POSITION) / size))
    placed = materialize(placed.drop(POSITION), "sorted-scores")

    def tried(ratio: float) -> list[float]:
        def block(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("score")
            found = _block(own["score"].to_numpy(), own[names].to_numpy(np.float64), ratio, mean)
            return pd.DataFrame([(int(own["_b"].iloc[0]), *f) for f in found], columns=["block", "a", "b", "cost", "cuts"])

        out = placed.groupBy("_b").applyInPandas(block, "block long, a int, b int, cost double, cuts array<double>")
        each: dict[int, list] = {}
        for r in out.collect():
            each.setdefault(r["block"], []).append((r["a"], r["b"], r["cost"], r["cuts"]))
        return _join([sorted(each[k]) for k in sorted(each)], labels)

    def ratio_of(cuts: Sequence[float]) -> Fraction | None:
        above = sum([(F.col("score") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
        counts = cells.filter("score IS NOT NULL").groupBy(above.alias("p")).agg(*[F.sum(n).alias(n) for n in names])
        table = np.zeros((labels, labels), np.int64)
        for r in counts.collect():
            table[:, r["p"]] = [r[n] for n in names]
        table[:, -1] += none
        return _ratio(table)

    best, at = Fraction(1), None  # one label for all has a kappa of 0
    for _ in range(GUESSES):
        cuts = tried(float(best))
        found = ratio_of(cuts)
        if found is None or found >= best:
            break
        best, at = found, cuts
    return Cuts(float(1 - best), tuple(at) if at else never)
