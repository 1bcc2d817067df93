"""Search guided by its own trials: two densities, of the good trials and of the others, and next the point where their ratio is greatest."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, threshold_label
from kinecohort.operators.ensemble import Ensemble, cv_out_of_fold, fit_feature_vector
from kinecohort.operators.scoring import quadratic_kappa, refine_thresholds, stratified_folds
from kinecohort.plans import presets as P
from kinecohort.plans.search import CHOICES, RANGES
from kinecohort.plans.training import SCORE_RANGE

# The penalties' ranges (low, high, step), and how often rows are drawn anew. Boosting on
# histograms has them all.
PENALTIES = {"lambda_l1": (0, 100, 5), "lambda_l2": (0, 100, 5)}
SPACE_CHOICES = {**CHOICES, "bagging_freq": [1]}
SPACE_RANGES = {**RANGES, **PENALTIES}
#: Trials before the densities are used, share of the trials that count as good, and points that are weighed for each trial.
STARTUP = 4
GOOD = 0.15
POINTS = 24


@dataclass(frozen=True)
class _Numbers:
    """Mixture of normal densities, cut to the range: one around each seen value and a wide one for the whole range."""

    low: float
    high: float
    centres: np.ndarray
    widths: np.ndarray

    @staticmethod
    def around(values: Sequence[float], low: float, high: float) -> _Numbers:
        span = high - low or 1.0
        centres = np.append(np.sort(np.array(values, float)), (low + high) / 2)
        sides = np.concatenate([[low], centres[:-1], [high]])
        # As wide as the way to the farther neighbour, but no needle.
        gaps = np.maximum(np.diff(sides)[:-1], np.diff(sides)[1:]) if len(values) else np.zeros(0)
        widths = np.append(np.clip(gaps, span / min(100.0, len(values) + 2.0), span), span)
        return _Numbers(low, high, centres, widths)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        pick = rng.integers(len(self.centres), size=n)
        return np.clip(rng.normal(self.centres[pick], self.widths[pick]), self.low, self.high)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centres) / self.widths
        return np.log(np.mean(np.exp(-z * z / 2) / self.widths, axis=1) + 1e-300)


def _best_number(good: Sequence[float], rest: Sequence[float], low: float, high: float, rng: np.random.Generator) -> float:
    ours, others = _Numbers.around(good, low, high), _Numbers.around(rest, low, high)
    x = ours.draw(rng, POINTS)
    return float(x[np.argmax(ours.log_density(x) - others.log_density(x))])


def _best_choice(good: Sequence[Any], rest: Sequence[Any], options: Sequence[Any], rng: np.random.Generator) -> Any:
    share = lambda seen: np.array([1 + seen.count(o) for o in options], float) / (len(options) + len(seen))
    ours, others = share(list(good)), share(list(rest))
    drawn = rng.choice(len(options), size=POINTS, p=ours / ours.sum())
    return options[drawn[np.argmax((ours / others)[drawn])]]


def suggest(
    history: Sequence[tuple[Mapping[str, Any], float]],
    seed: int,
    choices: Mapping[str, Sequence[Any]],
    ranges: Mapping[str, tuple[float, float, float | None]],
    startup: int = STARTUP,
) -> dict[str, Any]:
    """Parameters of the next trial after those of history (parameters, value to maximise).

    The first ``startup`` are drawn evenly. An undefined value (None or NaN) ranks last. Repeatable by seed and history.
    """
    rng = np.random.default_rng([seed, len(history)])
    value = lambda h: -np.inf if h[1] is None or np.isnan(h[1]) else h[1]
    ranked = sorted(history, key=value, reverse=True)
    n = max(1, int(np.ceil(GOOD * len(ranked))))
    good, rest = [h[0] for h in ranked[:n]], [h[0] for h in ranked[n:]]
    even = len(history) < startup
    out: dict[str, Any] = {}
    for k, options in choices.items():
        out[k] = options[int(rng.integers(len(options)))] if even else _best_choice([p[k] for p in good], [p[k] for p in rest], list(options), rng)
    for k, (low, high, step) in ranges.items():
        x = float(rng.uniform(low, high)) if even else _best_number([p[k] for p in good], [p[k] for p in rest], low, high, rng)
        if step is not None:
            x = round(low + step * round((x - low) / step), 10)
        out[k] = min(max(x, low), high)
    return out


def maximise(
    score: Callable[[dict[str, Any]], float],
    trials: int,
    seed: int,
    choices: Mapping[str, Sequence[Any]],
    ranges: Mapping[str, tuple[float, float, float | None]],
) -> list[tuple[dict[str, Any], float]]:
    """Trials in order, each with its value."""
    history: list[tuple[dict[str, Any], float]] = []
    for _ in range(trials):
        params = suggest(history, seed, choices, ranges)
        history.append((params, score(params)))
    return history


def guided_search(
    df: DataFrame,
    features: Sequence[str],
    trials: int = 10,
    seed: int = 0,
    target: str = P.TARGET,
    init_cuts: Sequence[float] = P.SCORE_CUTS,
    model_class: str = "LGBMRegressor",
    fixed: Mapping[str, Any] | None = None,
    id: str = "id",
) -> DataFrame:
    """One row per trial: its parameters and the tuned kappa, all trials on the same folds.

    A trial waits for those before it; the folds of one are fitted at a time. ``fixed`` values take the place of searched ones.
    """
    vector = fit_feature_vector(df, features, keep_missing=True)
    data = vector.transform(df.withColumn("y", col(target).cast("int")), [id, "y"])
    folded = stratified_folds(data, "y", [id]).persist(StorageLevel.MEMORY_AND_DISK)

    def score(params: dict[str, Any]) -> float:
        member = {"name": "trial", "model_class": model_class, "params": {**params, **(fixed or {})}}
        spec = Ensemble((member,), engine="histogram")

        def fit(train: DataFrame):
            fitted = spec.fit(train)
            return lambda rows: fitted.predict(rows)

        oof = cv_out_of_fold(folded, fit, init_cuts).oof
        cuts = refine_thresholds(oof, "y", "raw", init_cuts, *SCORE_RANGE)
        return float(quadratic_kappa(oof.withColumn("label", threshold_label(F.col("raw"), cuts)), "y", "label").first()["kappa"])

    free = lambda space: {k: v for k, v in space.items() if k not in (fixed or {})}
    try:
        history = maximise(score, trials, seed, free(SPACE_CHOICES), free(SPACE_RANGES))
    finally:
        folded.unpersist()
    rows = [(i, s, {k: float(v) for k, v in {**p, **(fixed or {})}.items()}) for i, (p, s) in enumerate(history)]
    return df.sparkSession.createDataFrame(rows, "trial int, kappa double, params map<string,double>")
