import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinecohort.operators import autoencoder as A
from kinecohort.operators import ensemble as E
from kinecohort.operators import group_stats as G
from kinecohort.operators import profile, scaling
from kinecohort.operators.derive import fit_ordinal
from kinecohort.operators.series import (
    SeriesLayout,
    daily_average,
    daily_average_summary,
    drop_single_day_series,
    series_features_v3,
)
from kinecohort.plans.models import load_models, save_models
from kinecohort.plans.prepare import Prepared
from kinecohort.plans import presets as P
from kinecohort.plans.search import best_trial, draw_trials
from kinecohort.plans.training import Level1, Level2, Trained, batch_score, train_level1, train_level2
from kinecohort.sources.artifacts import (
    Artifacts,
    FeatureArtifacts,
    LineageError,
    lineage_guard,
    load_artifacts,
    save_artifacts,
)

QUICK = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3, "random_state": 1}
BOOSTED = {"name": "b", "model_class": "LGBMRegressor", "params": QUICK}
FOREST = {"name": "f", "model_class": "RandomForestRegressor", "params": QUICK, "weight": 3}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b = rng.uniform(0, 3), rng.gauss(0, 1)
        rows.append((f"{i:04d}", min(3, int(a + 0.3 * abs(b))), a if i % 7 else None, b if i % 11 else float("nan")))
    return spark.createDataFrame(rows, "id string, sii int, a double, b double").persist()


# --- group statistics ------------------------------------------------------------


def test_group_of_one_and_null_keys(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 4.0), (None, 5.0), (None, 9.0)], "k string, v double")
    z = {(r.k, r.v): r.tv for r in G.group_zscore(df, ["k"], ["v"]).collect()}
    assert z[("x", 1.0)] == 0
    assert z[("y", 4.0)] == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    assert z[(None, 9.0)] == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    stats = G.fit_group_stats(df, ["k"], ["v"])
    scored = {(r.k, r.v): r.tv for r in G.group_zscore(df, ["k"], ["v"], stats).collect()}
    assert scored[(None, 9.0)] is None
    assert all(scored[k] == pytest.approx(z[k]) for k in z if k[0])
    safe = {(r.k, r.v): r.tv for r in G.group_zscore(df, ["k"], ["v"], stats, null_safe=True).collect()}
    assert safe == pytest.approx(z)


# --- scaling and encoding -----------------------------------------------------------


def test_standardize_reuses_fitted_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    out, fitted = scaling.standardize(df, ["x"])
    assert [r.x for r in out.collect()] == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])
    again, _ = scaling.standardize(spark.createDataFrame([(2.0,)], "x double"), ["x"], fitted)
    assert again.first().x == 0


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 2))
    x = np.abs(base @ rng.normal(size=(2, 5))) + 0.05 * rng.normal(size=(120, 5))
    rows = [(f"{i:03d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"x{i} double" for i in range(5))).repartition(4)


COLS = [f"x{i}" for i in range(5)]


def test_autoencoder_learns_and_repeats(matrix):
    one = A.fit_autoencoder(matrix, COLS, encoding_dim=3, epochs=40, learning_rate=0.02, seed=2)
    two = A.fit_autoencoder(matrix, COLS, encoding_dim=3, epochs=40, learning_rate=0.02, seed=2)
    assert one.losses[-1] < 0.6 * one.losses[0]
    assert one.losses == pytest.approx(two.losses, rel=1e-9)


def test_gradients_in_groups_equal_gradients_at_once(matrix, monkeypatch):
    direct = A.fit_autoencoder(matrix, COLS, 3, epochs=3, seed=2)
    monkeypatch.setattr(A, "DIRECT_PARTS", 0)
    assert A.fit_autoencoder(matrix, COLS, 3, epochs=3, seed=2).losses == pytest.approx(direct.losses, rel=1e-9)


def test_gradient_is_the_slope_of_the_error():
    rng = np.random.default_rng(1)
    x, model = rng.normal(size=(6, 4)), A.initial_autoencoder(4, 2, seed=3)
    flat = np.concatenate([p.ravel() for wb in zip(model.weights, model.biases) for p in wb])
    sums = A._gradient_sums(model, x)
    for i in range(0, len(flat), 7):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (A._gradient_sums(A._unflatten(up, 4, 2), x)[0] - A._gradient_sums(A._unflatten(down, 4, 2), x)[0]) / 2e-6
        assert sums[2 + i] == pytest.approx(slope, abs=1e-4)


def test_encoding_is_the_first_half_of_the_network(matrix):
    model = A.initial_autoencoder(5, 3, seed=1)
    got = {r.id: [r.column_0, r.column_1, r.column_2] for r in A.encode(matrix, COLS, model).collect()}
    for r in matrix.collect():
        x = np.array([r[c] for c in COLS])
        want = np.maximum(np.maximum(x @ model.weights[0] + model.biases[0], 0) @ model.weights[1] + model.biases[1], 0)
        assert got[r.id] == pytest.approx(want)


def test_missing_inputs_count_as_the_mean(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 0.0, 1.0)], "id string, x double, y double")
    model = A.initial_autoencoder(2, 2, seed=1)
    a, b = A.encode(df, ["x", "y"], model).orderBy("id").collect()
    assert a[1:] == b[1:]


# --- artifacts ------------------------------------------------------------------------


def test_artifacts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 4.0)], "k string, v double")
    fitted = FeatureArtifacts(G.fit_group_stats(df, ["k"], ["v"]), fit_ordinal(df, ["k"]), ("v", "tv"))
    encoder = A.initial_autoencoder(3, 2, seed=4)
    saved = Artifacts("run-1", {"Normal": fitted}, scaling.Standardizer({"v": 1.0}, {"v": None}), encoder)
    save_artifacts(saved, str(tmp_path / "a"))
    back = load_artifacts(spark, str(tmp_path / "a"))
    assert back.run_id == "run-1" and back.by_set["Normal"].features == ("v", "tv") and back.scaler == saved.scaler
    assert all((x == y).all() for x, y in zip(back.encoder.weights, encoder.weights))
    codes = {r.k: r.v for r in back.by_set["Normal"].codes.transform(df.select("k", F.lit(0).alias("v"))).collect()}
    assert codes == {0.0: 0, 1.0: 0}
    assert back.by_set["Normal"].group_stats.count() == 2


def test_lineage_guard():
    assert lineage_guard("a", "a") == "a"
    with pytest.raises(LineageError):
        lineage_guard("a", "b")


# --- models ---------------------------------------------------------------------------


def test_vote_is_weighted_and_nests(labelled):
    rows = labelled.withColumn("y", F.col("sii"))
    data = E.fit_feature_vector(rows, ["a", "b"]).transform(rows, ["id", "y"])
    nested = E.Ensemble((E.Ensemble((BOOSTED, FOREST)).to_params("both"), BOOSTED)).fit(data)
    inner = nested.members[0].model
    parts = inner.member_predictions(data).select("id", "b", "f").collect()
    votes = {r.id: r.raw for r in inner.predict(data).collect()}
    assert all(votes[r.id] == pytest.approx((r.b + 3 * r.f) / 4) for r in parts)
    outer = {r.id: r.raw for r in nested.predict(data).collect()}
    assert all(outer[r.id] == pytest.approx((votes[r.id] + r.b) / 2) for r in parts)
    own = [m.model.featureImportances.toArray() for m in inner.members]
    assert nested.importances() == pytest.approx((np.mean(own, axis=0) + own[0]) / 2)


def test_unknown_members_are_refused():
    with pytest.raises(ValueError, match="Perceptron"):
        E.build_regressor("Perceptron", {})


def test_parameters_reach_their_counterparts():
    params = {"iterations": 7, "depth": 4, "learning_rate": 0.2, "subsample": 0.5, "colsample_bylevel": 0.25, "random_seed": 9}
    model = E.build_regressor("CatBoostRegressor", params)
    got = (model.getMaxIter(), model.getMaxDepth(), model.getStepSize(), model.getSubsamplingRate())
    assert got == (7, 4, 0.2, 0.5) and model.getFeatureSubsetStrategy() == "0.25" and model.getSeed() == 9
    with pytest.raises(ValueError, match="depth 40"):
        E.build_regressor("LGBMRegressor", {"max_depth": 40})


def test_unknown_parameters_are_refused_and_ignored_ones_named():
    with pytest.raises(ValueError, match="learning_rat"):
        E.build_regressor("LGBMRegressor", {"learning_rat": 0.1})
    assert E.ignored_parameters({"lambda_l1": 1, "max_depth": 3}) == ["lambda_l1"]


def test_members_without_settings_differ_by_their_library():
    built = [E.build_regressor(m["model_class"], m["params"]) for m in P.NAIVE_ENSEMBLE["params"]]
    settings = {(m.getMaxIter(), m.getStepSize(), m.getMaxDepth(), m.getMinInstancesPerNode()) for m in built}
    assert len(settings) == 3


def test_least_gain_is_per_row(labelled):
    with pytest.raises(ValueError, match="training rows"):
        E.build_regressor("LGBMRegressor", {"min_gain_to_split": 7.0})
    assert E.build_regressor("LGBMRegressor", {"min_gain_to_split": 7.0}, rows=350).getMinInfoGain() == pytest.approx(0.02)
    data = E.fit_feature_vector(labelled, ["a", "b"]).transform(labelled.withColumn("y", F.col("sii")), ["id", "y"])
    params = {**QUICK, "min_gain_to_split": 7.0, "min_data_in_leaf": 1}
    fitted = E.Ensemble(({"name": "m", "model_class": "LGBMRegressor", "params": params},)).fit(data)
    rows = fitted.predict(data).agg(F.avg((F.col("raw") - F.col("y")) ** 2).alias("error"), F.var_pop("y").alias("spread")).first()
    assert rows.error < 0.7 * rows.spread


def test_two_levels(spark, labelled):
    level1 = train_level1(labelled, ["a", "b"], [BOOSTED])
    assert level1.oof.count() == 300 and level1.oof.select("id").distinct().count() == 300
    oof = level1.oof.collect()
    mean = np.mean([r.y for r in oof])
    assert np.mean([(r.raw - r.y) ** 2 for r in oof]) < 0.5 * np.mean([(mean - r.y) ** 2 for r in oof])
    assert level1.metrics["tuned_oof_kappa"] >= level1.metrics["oof_kappa"]
    stacked = level1.oof.select("id", "y", F.col("raw").alias("m"))
    level2 = train_level2(stacked, ["m"])
    slope, start = np.polyfit([r.raw for r in oof], [r.y for r in oof], 1)
    assert level2.model.coefficients[0] == pytest.approx(slope) and level2.model.intercept == pytest.approx(start)
    labels = level2.predict(stacked).collect()
    assert len(labels) == 300 and {r.label for r in labels} <= {0, 1, 2, 3}


def test_saved_models_score_alike(spark, labelled, tmp_path):
    rows = labelled.withColumn("y", F.col("sii"))
    vector = E.fit_feature_vector(rows, ["a", "b"])
    data = vector.transform(rows, ["id", "y"])
    nested = E.Ensemble((E.Ensemble((BOOSTED, FOREST)).to_params("both"), BOOSTED)).fit(data)
    level1 = Level1("one", "Normal", vector, nested)
    stacked = level1.predict(labelled, "one")
    model = E.stack_linear(stacked.join(rows.select("id", "y"), "id"), ["one"])
    trained = Trained("run-7", {"one": level1}, Level2(("one",), model, (0.4, 1.5, 2.4)))
    prepared = Prepared({"Normal": labelled}, {}, Artifacts("run-7", {}))
    want = {r.id: (r.raw, r.label) for r in batch_score(trained, prepared).collect()}
    save_models(spark, trained, str(tmp_path / "m"))
    loaded = load_models(spark, str(tmp_path / "m"))
    got = {r.id: (r.raw, r.label) for r in batch_score(loaded, prepared).collect()}
    assert len(got) == 300 and got == want
    with pytest.raises(LineageError):
        batch_score(loaded, Prepared({"Normal": labelled}, {}, Artifacts("run-8", {})))


def test_totals_as_targets_are_refused(labelled):
    with pytest.raises(ValueError, match="0..3"):
        train_level1(labelled.withColumn("sii", F.col("sii") * 20), ["a"], [BOOSTED])


def test_best_trial_is_the_first_of_the_best(spark):
    rows = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5), (3, None)], "trial int, kappa double")
    assert best_trial(rows).first().trial == 1


def test_trials_stay_in_their_ranges():
    trials = draw_trials(50, seed=3)
    assert trials == draw_trials(50, seed=3)
    assert all(0.01 <= t["learning_rate"] <= 0.3 and t["num_leaves"] % 20 == 0 and not E.ignored_parameters(t) and 3 <= t["max_depth"] <= 20 for t in trials)
    assert {t["bagging_fraction"] for t in trials} <= {0.5, 0.6, 0.7, 0.8, 0.9, 1.0}


# --- series and profiles ------------------------------------------------------------------


def test_single_day_series_are_dropped(spark):
    rows = [("a", 1.0, 2.0), ("b", 3.0, 3.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, relative_date_PCIAT_min double, relative_date_PCIAT_max double")
    assert [r.id for r in drop_single_day_series(df).collect()] == ["a"]


def test_v3_has_69_statistics_and_dotted_names(spark):
    rows = [
        ("a", k, float(k), 1.0, 2.0, float("nan") if k == 3 else 0.1 * k, 5.0, 10.0, 0.0, 10**9 * k, 1, 1, float(k // 10))
        for k in range(30)
    ]
    schema = (
        "id string, step long, X double, Y double, Z double, enmo double, light double, anglez double, "
        "`non-wear_flag` double, time_of_day long, weekday int, quarter int, relative_date_PCIAT double"
    )
    out = series_features_v3(spark.createDataFrame(rows, schema), SeriesLayout(window=5), dotted_names=True)
    assert len(out.columns) == 70 and "X_0.25" in out.columns
    assert {t for c, t in out.dtypes if c != "id"} == {"float"}
    row = out.first()
    # NaN is no maximum.
    assert row["enmo_max"] == pytest.approx(2.9) and row["X_0.5"] == 15.0


def test_one_day_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 1.0, 4.0, None)], "id string, relative_date_PCIAT double, enmo double, light double")
    row = daily_average_summary(daily_average(df)).first()
    assert row.daily_avg_enmo_mean == 3.0 and row.daily_avg_enmo_std is None and row.daily_avg_light_max == 3.0


def test_density_sums_to_one_and_cumulates(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(200)] + [(None,)], "x double")
    density = profile.kde_density(df, "x", -8, 8, steps=160, bandwidth=0.5).orderBy("value").collect()
    assert sum(r.density for r in density) * 0.1 == pytest.approx(1, abs=1e-3)
    total = profile.kde_density(df, "x", -8, 8, steps=160, bandwidth=0.5, cumulative=True).orderBy("value").collect()
    sums = np.cumsum([r.density for r in density]) * 0.1
    assert max(abs(r.density - s) for r, s in zip(total, sums)) < 0.05
    assert total[0].density == pytest.approx(0, abs=1e-6) and total[-1].density == pytest.approx(1, abs=1e-6)


def test_correlations_use_complete_pairs(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 5.0, 1.0), (4.0, None, 2.0), (5.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.column1, r.column2): r.value for r in profile.pairwise_corr(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got[("a", "a")] == pytest.approx(1)
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(np.corrcoef([1, 2, 3, 5], [2, 1, 5, 9])[0, 1])
    ranks = {(r.column1, r.column2): r.value for r in profile.pairwise_corr(df, ["a", "b", "c"], "spearman").collect()}
    assert ranks[("a", "c")] == pytest.approx(np.corrcoef([1, 2, 3, 4], [4, 1, 2.5, 2.5])[0, 1])
    assert len(ranks) == 9


def test_box_by_narrowing_equals_box_by_sorting(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("aab"), rng.expovariate(1)) for _ in range(500)], "g string, x double")
    one = {r.g: r for r in profile.box_stats(df, "x", "g").collect()}
    two = {r.g: r for r in profile.box_stats(df, "x", "g", small_rows=5).collect()}
    assert one == two


def test_shares_and_histogram(spark):
    df = spark.createDataFrame([("a", -0.5), ("a", 0.2), ("b", 0.9), (None, 1.0)], "g string, x double")
    shares = {r.g: (r["count"], r.percentage) for r in profile.value_shares(df, "g").collect()}
    assert shares == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}
    bins = {r.bin_start: r["count"] for r in profile.histogram(df, "x", 0.5).collect()}
    assert bins == {-0.5: 1, 0.0: 1, 0.5: 1, 1.0: 1}
    cross = {(r.g, r.x): r["count"] for r in profile.crosstab_counts(df, "g", "x", normalize_over_x=True).collect()}
    assert cross[("a", 0.2)] == 0.5 and cross[(None, 1.0)] == 1.0
