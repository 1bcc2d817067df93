"""Random search over tree parameters, scored by the tuned out-of-fold kappa."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, threshold_label
from kinecohort.operators.ensemble import Ensemble, cv_out_of_fold, fit_feature_vector
from kinecohort.operators.scoring import quadratic_kappa, refine_thresholds, stratified_folds
from kinecohort.plans import presets as P
from kinecohort.plans.training import SCORE_RANGE

# The searched ranges (low, high, step; no step means continuous). Only
# parameters that the learners here have; penalties would be noise in the search.
CHOICES = {"n_estimators": [500, 1000, 2000]}
RANGES = {
    "learning_rate": (0.01, 0.3, None),
    "num_leaves": (20, 3000, 20),
    "max_depth": (3, 20, 1),
    "min_data_in_leaf": (15, 100, 5),
    "min_gain_to_split": (0.0, 15.0, None),
    "bagging_fraction": (0.5, 1.0, 0.1),
    "feature_fraction": (0.5, 1.0, 0.1),
}
TRIALS = 10


def draw_trials(
    trials: int, seed: int, choices: Mapping[str, Sequence] = CHOICES, ranges: Mapping[str, tuple] = RANGES
) -> list[dict[str, Any]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        params: dict[str, Any] = {k: v[int(rng.integers(len(v)))] for k, v in choices.items()}
        for k, (low, high, step) in ranges.items():
            if step is None:
                params[k] = float(rng.uniform(low, high))
            else:
                steps = int(round((high - low) / step))
                params[k] = round(low + step * int(rng.integers(steps + 1)), 10)
        out.append(params)
    return out


def param_search(
    df: DataFrame,
    features: Sequence[str],
    trials: int = TRIALS,
    seed: int = 0,
    target: str = P.TARGET,
    init_cuts: Sequence[float] = P.SCORE_CUTS,
    model_class: str = "LGBMRegressor",
    fixed: Mapping[str, Any] | None = None,
    parallelism: int = 1,
    id: str = "id",
) -> DataFrame:
    """One row per trial: its parameters and the tuned kappa, all trials on the same folds."""
    vector = fit_feature_vector(df, features)
    data = vector.transform(df.withColumn("y", col(target).cast("int")), [id, "y"])
    folded = stratified_folds(data, "y", [id]).persist(StorageLevel.MEMORY_AND_DISK)
    drawn = [{**p, **(fixed or {})} for p in draw_trials(trials, seed)]

    def score(params: dict[str, Any]) -> float:
        spec = Ensemble(({"name": "trial", "model_class": model_class, "params": params},))

        def fit(train: DataFrame):
            fitted = spec.fit(train)
            return lambda rows: fitted.predict(rows)

        oof = cv_out_of_fold(folded, fit, init_cuts).oof
        cuts = refine_thresholds(oof, "y", "raw", init_cuts, *SCORE_RANGE)
        tuned = oof.withColumn("label", threshold_label(F.col("raw"), cuts))
        return float(quadratic_kappa(tuned, "y", "label").first()["kappa"])

    # Trials wait for Spark jobs, so threads are enough to run several at a time.
    try:
        with ThreadPool(max(1, min(parallelism, trials))) as pool:
            scores = pool.map(score, drawn)
    finally:
        folded.unpersist()
    rows = [(i, s, {k: float(v) for k, v in p.items()}) for i, (p, s) in enumerate(zip(drawn, scores))]
    return df.sparkSession.createDataFrame(rows, "trial int, kappa double, params map<string,double>")


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest kappa (the first of equals): its parameters and value."""
    return trials.orderBy(F.desc_nulls_last("kappa"), "trial").limit(1)
