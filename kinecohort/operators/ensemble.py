"""Tree regressors by name, weighted votes of them, out-of-fold predictions and stacking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add, and_
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, finite_or_null, threshold_label
from kinecohort.operators.boosting import LIBRARIES, BoostedRegressor, settings_of
from kinecohort.operators.scoring import quadratic_kappa
from kinecohort.sources.shared import materialize

FEATURES = "features"
# The names a member of an ensemble can be asked for, and which Spark
# learner takes its place.
BOOSTED = ("LGBMRegressor", "XGBRegressor", "CatBoostRegressor")
FOREST = "RandomForestRegressor"
NESTED = "EnsembleModel"
# The parameter names of those libraries per MLlib parameter.
PARAMETERS = {
    "iterations": ("n_estimators", "iterations"),
    "stepSize": ("learning_rate",),
    "maxDepth": ("max_depth", "depth"),
    "subsamplingRate": ("subsample", "bagging_fraction"),
    "featureSubsetStrategy": ("colsample_bytree", "feature_fraction", "colsample_bylevel"),
    "minInstancesPerNode": ("min_data_in_leaf", "min_child_weight"),
    "minInfoGain": ("min_gain_to_split",),
    "maxLeaves": ("num_leaves",),
    "seed": ("random_state", "random_seed"),
}
# Parameters without a counterpart in MLlib, which are named but have no effect.
IGNORED = ("lambda_l1", "lambda_l2", "reg_alpha", "reg_lambda", "bagging_freq")
# What the libraries take by default.
DEFAULTS: dict[str, dict[str, Any]] = {
    "LGBMRegressor": {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "min_data_in_leaf": 20},
    "XGBRegressor": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "min_child_weight": 1},
    "CatBoostRegressor": {"iterations": 1000, "learning_rate": 0.03, "depth": 6},
    "RandomForestRegressor": {"n_estimators": 100, "colsample_bytree": 1.0},
}
MLLIB_MAX_DEPTH = 30


# --- features -----------------------------------------------------------------


@dataclass(frozen=True)
class FeatureVector:
    """Ordered feature columns and the value that stands for a missing one of each.

    The learners accept no NaN. Missing values get a value below all others, so that a
    split can tell them apart, as the boosting libraries do by a default direction.
    """

    names: tuple[str, ...]
    fills: tuple[float, ...]

    def column(self) -> Column:
        return array_to_vector(
            F.array(
                *[
                    F.coalesce(finite_or_null(col(c).cast("double")), F.lit(fill))
                    for c, fill in zip(self.names, self.fills)
                ]
            )
        )

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*[col(c) for c in keep], self.column().alias(FEATURES))


def fit_feature_vector(df: DataFrame, names: Sequence[str], keep_missing: bool = False) -> FeatureVector:
    """The fills of a table; with ``keep_missing``, NaN stays, for learners that find a side for it."""
    if keep_missing:
        return FeatureVector(tuple(names), (float("nan"),) * len(names))
    row = df.agg(*[F.min(finite_or_null(col(c).cast("double"))).alias(f"f{i}") for i, c in enumerate(names)]).first()
    lows = [row[f"f{i}"] for i in range(len(names))]
    return FeatureVector(tuple(names), tuple(0.0 if v is None else v - 1.0 for v in lows))


# --- one regressor --------------------------------------------------------------


def _given(params: Mapping[str, Any], name: str) -> Any:
    return next((params[k] for k in PARAMETERS[name] if k in params), None)


def ignored_parameters(params: Mapping[str, Any]) -> list[str]:
    """Given parameters that have no effect here."""
    return sorted(k for k in params if k in IGNORED)


def _resolved(model_class: str, params: Mapping[str, Any]) -> dict[str, Any]:
    """MLlib names and values: those given, else the library's defaults. Unknown names are an error."""
    if model_class not in DEFAULTS:
        raise ValueError(f"unknown model class: {model_class}")
    known = {k for names in PARAMETERS.values() for k in names}
    unknown = sorted(set(params) - known - set(IGNORED))
    if unknown:
        raise ValueError(f"unknown parameters of {model_class}: {unknown}")
    out = {}
    for name in PARAMETERS:
        given = _given(params, name)
        value = given if given is not None else _given(DEFAULTS[model_class], name)
        if value is not None:
            out[name] = value
    return out


def build_regressor(
    model_class: str,
    params: Mapping[str, Any],
    label: str = "y",
    prediction: str = "prediction",
    rows: int | None = None,
):
    """The MLlib learner for a member: its library's defaults, and over them the given parameters.

    ``rows`` is the number of training rows: a least gain is a sum over rows there and a mean
    over rows here. Leaves bound the depth of a tree that has no more of them. Without either, a tree
    is as deep as MLlib allows; a greater depth is an error.
    """
    given = _resolved(model_class, params)
    common: dict[str, Any] = {"featuresCol": FEATURES, "labelCol": label, "predictionCol": prediction}
    if "subsamplingRate" in given:
        common["subsamplingRate"] = float(given["subsamplingRate"])
    if "seed" in given:
        common["seed"] = int(given["seed"])
    if given.get("minInfoGain"):
        if not rows:
            raise ValueError("a least gain needs the number of training rows")
        common["minInfoGain"] = float(given["minInfoGain"]) / rows
    if "minInstancesPerNode" in given:
        common["minInstancesPerNode"] = max(1, round(given["minInstancesPerNode"]))
    depth = given.get("maxDepth")
    depth = None if depth is None or depth <= 0 else int(depth)
    if depth is not None and depth > MLLIB_MAX_DEPTH:
        raise ValueError(f"depth {depth} exceeds {MLLIB_MAX_DEPTH}, the most that MLlib grows")
    if "maxLeaves" in given:
        by_leaves = max(1, (int(given["maxLeaves"]) - 1).bit_length())
        depth = min(depth or MLLIB_MAX_DEPTH, by_leaves)
    common["maxDepth"] = depth or MLLIB_MAX_DEPTH
    share = given.get("featureSubsetStrategy")
    if share is not None:
        common["featureSubsetStrategy"] = "all" if float(share) >= 1 else str(float(share))
    if model_class in BOOSTED:
        return GBTRegressor(
            checkpointInterval=10, maxIter=int(given["iterations"]), stepSize=float(given["stepSize"]), **common
        )
    return RandomForestRegressor(checkpointInterval=10, numTrees=int(given["iterations"]), **common)


# --- weighted votes ---------------------------------------------------------------


def weighted_vote(predictions: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of prediction columns; equal weights by default."""
    weights = [1.0] * len(predictions) if weights is None else [float(w) for w in weights]
    return reduce(add, [p * F.lit(w) for p, w in zip(predictions, weights)]) / F.lit(sum(weights))


@dataclass(frozen=True)
class Member:
    name: str
    weight: float
    model: Any


@dataclass(frozen=True)
class FittedEnsemble:
    """Fitted members, possibly ensembles themselves."""

    members: tuple[Member, ...]

    def _with_predictions(self, df: DataFrame, path: str) -> tuple[DataFrame, Column]:
        columns = []
        for i, m in enumerate(self.members):
            name = f"{path}_{i}"
            if isinstance(m.model, FittedEnsemble):
                df, vote = m.model._with_predictions(df, name)
            else:
                df = m.model.copy({m.model.predictionCol: name}).transform(df)
                vote = F.col(name)
            columns.append(vote)
        return df, weighted_vote(columns, [m.weight for m in self.members])

    def predict(self, df: DataFrame, name: str = "raw") -> DataFrame:
        """Add the vote to rows that have the feature vector; a narrow transformation."""
        out, vote = self._with_predictions(df, "_member")
        return out.select(*[col(c) for c in df.columns], vote.alias(name))

    def member_predictions(self, df: DataFrame) -> DataFrame:
        out = df
        for m in self.members:
            if isinstance(m.model, FittedEnsemble):
                out = m.model.predict(out, m.name)
            else:
                out = m.model.copy({m.model.predictionCol: m.name}).transform(out)
        return out

    def importances(self) -> np.ndarray:
        """Mean of the members' importances, nested ensembles first averaged themselves."""
        each = [
            m.model.importances() if isinstance(m.model, FittedEnsemble) else m.model.featureImportances.toArray()
            for m in self.members
        ]
        return np.mean(each, axis=0)


@dataclass(frozen=True)
class Ensemble:
    """Specification: members as {name, model_class, params, weight?}; nested ones allowed.

    With engine="histogram" boosted members are those of ``boosting``, on which every parameter acts; forests stay MLlib's.
    """

    params: tuple[Mapping[str, Any], ...]
    engine: str = "mllib"

    def fit(self, df: DataFrame, label: str = "y") -> FittedEnsemble:
        """Fit on rows with a feature vector and a label."""
        if self.engine not in ("mllib", "histogram"):
            raise ValueError(f"unknown engine: {self.engine}")
        gains = self.engine == "mllib" and any("min_gain_to_split" in p["params"] for p in self.params)
        rows = df.count() if gains else None
        members = []
        for p in self.params:
            if p["model_class"] == NESTED:
                model: Any = Ensemble(tuple(p["params"]["params"]), self.engine).fit(df, label)
            elif self.engine == "histogram" and p["model_class"] in LIBRARIES:
                model = BoostedRegressor(settings_of(p["model_class"], p["params"]), FEATURES, label).fit(df)
            else:
                model = build_regressor(p["model_class"], p["params"], label, rows=rows).fit(df)
            members.append(Member(p["name"], float(p.get("weight", 1)), model))
        return FittedEnsemble(tuple(members))

    def to_params(self, name: str) -> dict[str, Any]:
        return {"name": name, "model_class": NESTED, "params": {"params": list(self.params)}}


def feature_importance(df: DataFrame, model: FittedEnsemble, names: Sequence[str]) -> DataFrame:
    """One row per feature; the numbers come from the model, not from the rows of ``df``."""
    pairs = [(n, float(v)) for n, v in zip(names, model.importances())]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")


# --- cross-validation ----------------------------------------------------------------


@dataclass
class CrossValidated:
    """Out-of-fold table (id, fold, y, raw, label) and the models of the folds."""

    oof: DataFrame
    models: list[Any] = field(default_factory=list)


def cv_out_of_fold(
    data: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    cuts: Sequence[float],
    folds: int = 5,
    parallelism: int = 5,
) -> CrossValidated:
    """For every fold fit on the others and predict it.

    ``data`` has id, fold, y and what the learner needs; ``fit`` returns a function that
    adds ``raw``. Up to ``parallelism`` folds are fitted at a time, from threads that wait
    for Spark. The result is a written table keyed by id: it is read many times later.
    """
    own_cache = data.storageLevel == StorageLevel.NONE
    cached = data.persist(StorageLevel.MEMORY_AND_DISK) if own_cache else data
    try:
        with ThreadPool(max(1, min(parallelism, folds))) as pool:
            models = pool.map(lambda k: fit(cached.filter(F.col("fold") != k)), range(folds))
        parts = [
            predict(cached.filter(F.col("fold") == k)).select("id", "fold", "y", "raw")
            for k, predict in enumerate(models)
        ]
        oof = reduce(DataFrame.unionByName, parts).withColumn("label", threshold_label(F.col("raw"), cuts))
        return CrossValidated(materialize(oof, "oof"), models)
    finally:
        if own_cache:
            cached.unpersist()


def fold_scores(oof: DataFrame) -> DataFrame:
    return quadratic_kappa(oof, "y", "label", ["fold"])


# --- stacking -------------------------------------------------------------------------


def stack_predictions(predictions: Mapping[str, DataFrame], value: str = "raw", id: str = "id") -> DataFrame:
    """One column per model, side by side, matched by id.

    All models must have predicted the same ids, each once: an id that is null, that a model
    lacks, or that it has twice, is an error when the rows are read.
    """
    each = [
        p.select(col(id), F.lit(i).alias("_model"), col(value).cast("double").alias("_value"))
        for i, p in enumerate(predictions.values())
    ]
    rows = reduce(DataFrame.unionByName, each).groupBy(col(id))
    counts = [F.count_if(F.col("_model") == i).alias(f"_n{i}") for i in range(len(each))]
    values = [F.max(F.when(F.col("_model") == i, F.col("_value"))).alias(n) for i, n in enumerate(predictions)]
    once = reduce(and_, [F.col(f"_n{i}") == 1 for i in range(len(each))]) & col(id).isNotNull()
    text = F.concat(F.lit("not predicted once by every model: id "), F.coalesce(col(id).cast("string"), F.lit("null")))
    stacked = rows.agg(*counts, *values).filter(F.when(once, True).otherwise(F.raise_error(text).cast("boolean")))
    return stacked.select(col(id), *[col(n) for n in predictions])


def stack_linear(df: DataFrame, names: Sequence[str], label: str = "y") -> LinearRegressionModel:
    """Least squares with intercept on the level-1 predictions."""
    vector = array_to_vector(F.array(*[col(c).cast("double") for c in names]))
    data = df.select(vector.alias(FEATURES), col(label).cast("double").alias("y"))
    return LinearRegression(featuresCol=FEATURES, labelCol="y", regParam=0.0, solver="normal").fit(data)


def linear_prediction(model: LinearRegressionModel, names: Sequence[str]) -> Column:
    terms = [col(c) * F.lit(float(w)) for c, w in zip(names, model.coefficients)]
    return reduce(add, terms) + F.lit(float(model.intercept))


