"""The guided search against even draws, and ensembles of boosted trees in it."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kinecohort.operators import ensemble as E
from kinecohort.operators.boosting import BoostedModel
from kinecohort.plans import parzen as Z

RANGES = {"a": (0.0, 10.0, None), "b": (-5.0, 5.0, 0.5), "c": (0, 100, 5)}
CHOICES = {"kind": ["x", "y", "z"]}


def known(p):
    return -((p["a"] - 7.3) ** 2) / 10 - (p["b"] + 2) ** 2 / 5 - (p["c"] - 60) ** 2 / 500 + 2 * (p["kind"] == "y")


def test_trials_are_led_to_the_best():
    led, even = [], []
    for seed in range(30):
        history = Z.maximise(known, 40, seed, CHOICES, RANGES)
        led.append(max(v for _, v in history))
        even.append(max(known(Z.suggest([({}, 0.0)] * i, seed, CHOICES, RANGES, startup=99)) for i in range(40)))
    assert np.mean(led) > np.mean(even) + 0.2 and np.mean(np.array(led) > even) > 0.7


def test_suggestions_keep_to_the_space_and_repeat():
    history = Z.maximise(known, 12, 5, CHOICES, RANGES)
    assert history == Z.maximise(known, 12, 5, CHOICES, RANGES)
    for p, _ in history:
        assert 0 <= p["a"] <= 10 and -5 <= p["b"] <= 5 and (p["b"] * 2) % 1 == 0 and p["c"] % 5 == 0 and p["kind"] in "xyz"
    assert set(Z.SPACE_CHOICES) | set(Z.SPACE_RANGES) >= {"lambda_l1", "lambda_l2", "bagging_freq"} and len({**Z.SPACE_CHOICES, **Z.SPACE_RANGES}) == 11
    undefined = [({"a": 1.0, "b": 0.0, "c": 5, "kind": "x"}, float("nan"))] * 5
    assert set(Z.suggest(undefined, 1, CHOICES, RANGES)) == {"a", "b", "c", "kind"}


def test_penalties_act_in_the_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = np.clip(np.round(x[:, 0] + 1.5), 0, 3).astype(int)
    rows = [(i, int(t), float(a), None if i % 9 == 0 else float(b)) for i, (t, (a, b)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, sii int, a double, b double")
    fixed = {"n_estimators": 2, "num_leaves": 4, "max_depth": 2, "min_data_in_leaf": 5, "bagging_fraction": 1.0, "feature_fraction": 1.0, "learning_rate": 0.5}
    fixed |= {"min_gain_to_split": 0.0}
    out = Z.guided_search(df, ["a", "b"], 2, 1, fixed={**fixed, "lambda_l1": 0, "lambda_l2": 0}).collect()
    assert [r.trial for r in out] == [0, 1] and all(0.5 < r.kappa <= 1 and len(r.params) == 11 for r in out)
    # A penalty beyond all gradients leaves every leaf at zero.
    none = Z.guided_search(df, ["a", "b"], 1, 1, fixed={**fixed, "lambda_l1": 100_000}).collect()
    assert none[0].kappa == pytest.approx(0, abs=0.1)


def test_ensembles_take_boosted_members(spark):
    rows = [(i, float(i % 10), i % 4) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a double, y int").withColumn("features", array_to_vector(F.array("a")))
    member = {"name": "m", "model_class": "LGBMRegressor", "params": {"n_estimators": 2, "min_data_in_leaf": 2, "lambda_l1": 1.0}}
    nested = E.Ensemble((member,)).to_params("both")
    fitted = E.Ensemble((member, nested), engine="histogram").fit(df)
    assert isinstance(fitted.members[0].model, BoostedModel) and sum(fitted.importances()) == pytest.approx(1)
    own = fitted.members[0].model.transform(df).select("prediction").collect()
    assert [r.raw for r in fitted.predict(df).collect()] == pytest.approx([r.prediction for r in own])
    with pytest.raises(ValueError):
        E.Ensemble((member,), engine="other").fit(df)
