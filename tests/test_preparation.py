"""From raw tables to labels on the smallest tables."""

import pytest

from checks.data import LAYOUT, series, subjects
from checks.scoring_queries import QUICK_MODELS
from kinecohort.functions.columns import col
from kinecohort.operators.series import series_features_v3
from kinecohort.plans import presets as P
from kinecohort.plans.prepare import (
    clean_train,
    feature_engineering,
    merge_series_features,
    prepare_test,
    prepare_train,
)
from kinecohort.plans.training import batch_score, train

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    encoder = {"encoding_dim": 3, "epochs": 2, "learning_rate": 0.01}
    return prepare_train(subjects(spark, SF_DIR), series(spark, SF_DIR), LAYOUT, encoder)


def test_features_are_those_of_the_joined_table(spark, prepared):
    s = series(spark, SF_DIR)
    merged = merge_series_features(clean_train(subjects(spark, SF_DIR), s), series_features_v3(s, LAYOUT))
    frame, features, _ = feature_engineering(merged)
    assert prepared.features(P.NORMAL) == features
    encoded = prepared.features(P.ENCODED)
    assert [c for c in encoded if c.startswith("column_")] == ["column_0", "column_1", "column_2"]
    assert not set(features) & set(P.EXCLUDED_FEATURES)
    some = [features[0], "X_q50", "tBIA-BIA_Fat", "PAQ_Total", "FGC-Season"]
    one = sorted(map(str, frame.select("id", *[col(c) for c in some]).collect()))
    assert one == sorted(map(str, prepared.frames[P.NORMAL].select("id", *[col(c) for c in some]).collect()))


def test_every_subject_gets_a_label(spark, prepared):
    models = {n: QUICK_MODELS[n] for n in ("autoencoder_ensemble", "naive_ensemble")}
    trained = train(prepared, models)
    people = subjects(spark, SF_DIR)
    scored = prepare_test(people, series(spark, SF_DIR), prepared.artifacts, LAYOUT)
    assert scored.frames[P.NORMAL].columns == ["id", *prepared.features(P.NORMAL)]
    labels = batch_score(trained, scored).collect()
    assert {r.id for r in labels} == {r.id for r in people.select("id").collect()}
    assert {r.label for r in labels} <= {0, 1, 2, 3}
