"""Two levels of models: ensembles on features, a linear one on their predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, threshold_label
from kinecohort.operators.ensemble import (
    Ensemble,
    FeatureVector,
    FittedEnsemble,
    cv_out_of_fold,
    fit_feature_vector,
    linear_prediction,
    stack_linear,
    stack_predictions,
)
from kinecohort.operators.linear import linear_out_of_fold
from kinecohort.operators.scoring import (
    FOLDS,
    accuracy,
    confusion_matrix,
    cv_summary,
    quadratic_kappa,
    refine_thresholds,
    stratified_folds,
)
from kinecohort.plans import presets as P
from kinecohort.plans.prepare import Prepared
from kinecohort.sources.artifacts import lineage_guard

SCORE_RANGE = (-0.5, 3.5)


def _require_label_scale(data: DataFrame, labels: int) -> None:
    low, high = data.agg(F.min("y"), F.max("y")).first()
    if low is None or low < 0 or high > labels - 1:
        raise ValueError(f"the target must be a label 0..{labels - 1}, found {low}..{high}")


def evaluate(oof: DataFrame, cuts: Sequence[float], init_cuts: Sequence[float]) -> dict[str, Any]:
    """Fold scores under the start cut points, and all rows under the tuned ones."""
    summary = cv_summary(oof.withColumn("label", threshold_label(F.col("raw"), init_cuts))).first()
    tuned = oof.withColumn("label", threshold_label(F.col("raw"), cuts))
    per_fold = accuracy(tuned, "y", "label", ["fold"])
    return {
        "fold_accuracy": per_fold,
        "cv_mean_kappa": summary["cv_mean_kappa"],
        "cv_std_kappa": summary["cv_std_kappa"],
        "oof_kappa": summary["oof_kappa"],
        "tuned_oof_kappa": quadratic_kappa(tuned, "y", "label").first()["kappa"],
        "tuned_oof_accuracy": accuracy(tuned, "y", "label").first()["accuracy"],
        "tuned_confusion": confusion_matrix(tuned, "y", "label"),
    }


@dataclass(frozen=True)
class Level1:
    """A fitted ensemble with the feature vector it reads."""

    name: str
    feature_set: str
    vector: FeatureVector
    model: FittedEnsemble
    # Only of a model trained in this session, not of a loaded one.
    oof: DataFrame | None = None
    metrics: dict[str, Any] = field(default_factory=dict)

    def predict(self, df: DataFrame, name: str = "raw", id: str = "id") -> DataFrame:
        return self.model.predict(self.vector.transform(df, [id]), name).select(col(id), name)


@dataclass(frozen=True)
class Level2:
    names: tuple[str, ...]
    model: LinearRegressionModel
    thresholds: tuple[float, ...]
    oof: DataFrame | None = None
    metrics: dict[str, Any] = field(default_factory=dict)

    def predict(self, stacked: DataFrame, id: str = "id") -> DataFrame:
        raw = linear_prediction(self.model, self.names)
        return stacked.select(col(id), raw.alias("raw")).withColumn(
            "label", threshold_label(F.col("raw"), self.thresholds)
        )


def train_level1(
    df: DataFrame,
    features: Sequence[str],
    params: Sequence[Mapping[str, Any]],
    target: str = P.TARGET,
    init_cuts: Sequence[float] = P.SCORE_CUTS,
    name: str = "model",
    feature_set: str = P.NORMAL,
    id: str = "id",
) -> Level1:
    """Cross-validate an ensemble, tune cut points for the report, refit on all rows."""
    vector = fit_feature_vector(df, features)
    data = vector.transform(df.withColumn("y", col(target).cast("int")), [id, "y"])
    _require_label_scale(data, len(init_cuts) + 1)
    folded = stratified_folds(data, "y", [id])
    spec = Ensemble(tuple(params))

    def fit(train: DataFrame):
        fitted = spec.fit(train)
        return lambda rows: fitted.predict(rows)

    cv = cv_out_of_fold(folded, fit, init_cuts, FOLDS)
    cuts = refine_thresholds(cv.oof, "y", "raw", init_cuts, *SCORE_RANGE)
    return Level1(name, feature_set, vector, spec.fit(folded), cv.oof, evaluate(cv.oof, cuts, init_cuts))


def train_level2(
    stacked: DataFrame,
    names: Sequence[str],
    target: str = "y",
    init_cuts: Sequence[float] = P.SCORE_CUTS,
    id: str = "id",
) -> Level2:
    """Cross-validate and fit a linear model on level-1 predictions; keeps the cut points."""
    data = stacked.select(col(id), col(target).cast("int").alias("y"), *[col(n) for n in names])
    _require_label_scale(data, len(init_cuts) + 1)
    folded = stratified_folds(data, "y", [id]).withColumnRenamed(id, "id")
    # The folds' moments give all fits, so rows are not read again for each fold.
    oof, _, _ = linear_out_of_fold(folded, names, init_cuts)
    cuts = refine_thresholds(oof, "y", "raw", init_cuts, *SCORE_RANGE)
    return Level2(tuple(names), stack_linear(folded, names), tuple(cuts), oof, evaluate(oof, cuts, init_cuts))


@dataclass(frozen=True)
class Trained:
    run_id: str
    level1: dict[str, Level1]
    level2: Level2


def train(
    prepared: Prepared, models: Mapping[str, Mapping[str, Any]] = P.MODELS, parallelism: int = 3
) -> Trained:
    """All level-1 models, then the stack of their out-of-fold predictions.

    Level-1 models do not depend on each other and mostly wait for Spark jobs, so several
    are trained at a time, each from a thread of its own.
    """

    def fit(item: tuple[str, Mapping[str, Any]]) -> tuple[str, Level1]:
        name, cfg = item
        frame, features = prepared.frames[cfg["fs"]], prepared.features(cfg["fs"])
        return name, train_level1(
            frame, features, cfg["params"], cfg["target_col"], cfg["init_thresholds"], name, cfg["fs"]
        )

    with ThreadPool(max(1, min(parallelism, len(models)))) as pool:
        level1 = dict(pool.map(fit, models.items()))
    stacked = stack_predictions({n: m.oof for n, m in level1.items()})
    truth = next(iter(level1.values())).oof.select("id", "y")
    level2 = train_level2(stacked.join(truth, "id"), list(level1))
    return Trained(prepared.run_id, level1, level2)


def batch_score(trained: Trained, prepared: Prepared) -> DataFrame:
    """Final labels (id, raw, label) of prepared rows; refuses rows of another run."""
    lineage_guard(trained.run_id, prepared.run_id)
    predictions = {n: m.predict(prepared.frames[m.feature_set]) for n, m in trained.level1.items()}
    return trained.level2.predict(stack_predictions(predictions))

