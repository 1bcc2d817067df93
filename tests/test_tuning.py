"""Exact cut points and one-scan fits against plain searches."""

import itertools
import math

import numpy as np
import pytest

from kinecohort.operators import ensemble as E
from kinecohort.operators import linear as L
from kinecohort.operators import scoring as M
from kinecohort.operators import tuning as T
from kinecohort.functions.columns import threshold_label
from pyspark.sql import functions as F


def kappa(y, p):
    n = len(y)
    apart = sum((a - b) ** 2 for a, b in zip(y, p))
    chance = sum((a - b) ** 2 for a in y for b in p) / n
    return 1 - apart / chance if chance else None


def label(score, cuts):
    return sum(score >= c for c in cuts) if score is not None and not math.isnan(score) else len(cuts)


def best_of_all(y, raw, labels):
    places = sorted({s for s in raw if s is not None and not math.isnan(s)}) + [math.inf]
    found = []
    for cuts in itertools.combinations_with_replacement(places, labels - 1):
        k = kappa(y, [label(s, cuts) for s in raw])
        if k is not None:
            found.append(k)
    return max(found)


@pytest.mark.parametrize("seed,labels,block", [(1, 4, 1 << 16), (2, 4, 3), (3, 3, 2), (4, 2, 5), (5, 4, 1)])
def test_no_cut_points_are_better(spark, seed, labels, block):
    rng = np.random.default_rng(seed)
    y = [*range(labels), *rng.integers(0, labels, 60).tolist()]
    raw = [None if rng.random() < 0.05 else math.nan if rng.random() < 0.05 else float(round(v + rng.normal(0, 0.9), 1)) for v in y]
    if seed == 4:
        raw = [-s if s is not None else s for s in raw]  # worse than chance
    df = spark.createDataFrame(list(zip(y, raw)), "y int, raw double")
    found = T.exact_thresholds(df, "y", "raw", labels, block)
    assert found.kappa == pytest.approx(best_of_all(y, raw, labels), abs=1e-12)
    assert list(found.values) == sorted(found.values)
    assert kappa(y, [label(s, found.values) for s in raw]) == pytest.approx(found.kappa, abs=1e-12)
    if labels == 4:
        own = M.quadratic_kappa(df.withColumn("p", threshold_label(F.col("raw"), [min(c, 1e300) for c in found.values])), "y", "p").first().kappa
        grid = M.tune_thresholds(df, "y", "raw", M.cut_grid(-2, 5, 0.25)).first().kappa
        assert own == pytest.approx(found.kappa, abs=1e-9) and found.kappa >= grid - 1e-12


def test_cut_points_of_odd_tables(spark):
    df = spark.createDataFrame([(i % 4, float(i % 4)) for i in range(40)], "y int, raw double")
    found = T.exact_thresholds(df, "y", "raw")
    assert found.kappa == 1 and found.values == (1.0, 2.0, 3.0)
    assert T.exact_thresholds(df.filter("y < 0"), "y", "raw") == T.Cuts(None, (math.inf,) * 3)
    assert T.exact_thresholds(df.withColumn("raw", F.lit(None).cast("double")), "y", "raw").kappa == 0
    assert T.exact_thresholds(df.withColumn("raw", F.lit(2.0)), "y", "raw").kappa == pytest.approx(0)
    with pytest.raises(ValueError):
        T.exact_thresholds(df.filter("y <> 2"), "y", "raw")
    with pytest.raises(Exception, match="off the scale"):
        T.exact_thresholds(df.withColumn("y", F.col("y") + 1), "y", "raw")


def test_fits_of_all_folds_from_one_scan(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 5]
    y = x @ [1.0, 2e-4, 300.0] + rng.normal(size=200)
    df = spark.createDataFrame([(i, i % 5, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, fold int, a double, b double, c double, y double")
    oof, fits, whole = L.linear_out_of_fold(df, ["a", "b", "c"], [0.5, 1.5, 2.5])
    got = {r.id: r.raw for r in oof.collect()}
    for k in range(5):
        train = np.arange(200) % 5 != k
        centred = np.c_[np.ones(train.sum()), x[train] - x[train].mean(axis=0)]
        w = np.linalg.lstsq(centred, y[train], rcond=None)[0]
        want = w[0] + (x[~train] - x[train].mean(axis=0)) @ w[1:]
        assert [got[i] for i in range(200) if i % 5 == k] == pytest.approx(want.tolist(), rel=1e-8)
    model = E.stack_linear(df, ["a", "b", "c"])
    assert whole.coefficients == pytest.approx(list(model.coefficients), rel=1e-5)
    assert L.fit_linear(df, ["a", "b", "c"]).intercept == pytest.approx(whole.intercept)
    assert len(fits) == 5 and oof.columns == ["id", "fold", "y", "raw", "label"]


def test_fits_without_rows_and_with_equal_columns(spark):
    df = spark.createDataFrame([(i, i % 2, float(i), float(i)) for i in range(10)], "id long, fold int, a double, y double")
    twice = df.withColumn("b", F.col("a"))
    oof, _, whole = L.linear_out_of_fold(twice, ["a", "b"], [0.5])
    assert whole.coefficients == pytest.approx((0.5, 0.5)) and all(r.raw == pytest.approx(r.y) for r in oof.collect())
    holes = df.withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a")))
    assert {r.id: r.raw for r in L.linear_out_of_fold(holes, ["a"], [0.5])[0].collect()}[3] is None
    assert L.linear_out_of_fold(df.filter("id < 0"), ["a"], [0.5])[0].count() == 0
    assert L.fit_linear(df.filter("id < 0"), ["a"]) == L.LinearFit((0.0,), 0.0)
