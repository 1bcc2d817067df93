import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinecohort.functions.columns import threshold_label
from kinecohort.operators import scoring as M


def kappa_by_matrix(y, p):
    labels = sorted(set(y) | set(p))
    k, n = len(labels), len(y)
    o = np.zeros((k, k))
    for a, b in zip(y, p):
        o[labels.index(a), labels.index(b)] += 1
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)])
    e = np.outer(o.sum(1), o.sum(0)) / n
    return 1 - (w * o).sum() / (w * e).sum() if (w * e).sum() else math.nan


def pairs(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, p int")


def test_kappa_equals_the_matrix_definition(spark):
    rng = random.Random(4)
    groups = {f"g{i}": [(rng.choice([0, 1, 3]), rng.choice([0, 1, 2, 3, 5])) for _ in range(rng.randint(2, 40))] for i in range(30)}
    df = pairs(spark, [(g, y, p) for g, v in groups.items() for y, p in v])
    got = {r.g: r.kappa for r in M.quadratic_kappa(df, "y", "p", ["g"]).collect()}
    for g, v in groups.items():
        assert got[g] == pytest.approx(kappa_by_matrix(*zip(*v)), abs=1e-12, nan_ok=True)
    turned = {r.g: r.kappa for r in M.quadratic_kappa(df, "p", "y", ["g"]).collect()}
    assert turned == pytest.approx(got, nan_ok=True)


def test_kappa_of_equal_and_constant_labels(spark):
    same = pairs(spark, [("a", 0, 0), ("a", 2, 2), ("b", 1, 1), ("b", 1, 1)])
    got = {r.g: r.kappa for r in M.quadratic_kappa(same, "y", "p", ["g"]).collect()}
    assert got["a"] == 1 and math.isnan(got["b"])


def deal(y, folds=5):
    """The published dealing of stratified folds, row by row."""
    seen = list(dict.fromkeys(y))
    line = sorted(seen.index(v) for v in y)
    out = [None] * len(y)
    for c in range(len(seen)):
        fill = [f for f in range(folds) for v in line[f::folds] if v == c]
        rows = [i for i, v in enumerate(y) if seen.index(v) == c]
        for i, f in zip(rows, fill):
            out[i] = f
    return out


@pytest.mark.parametrize("n,hot_rows", [(103, 10**9), (103, 20), (7, 10**9)])
def test_folds_follow_the_published_dealing(spark, n, hot_rows):
    rng = random.Random(n)
    y = [rng.choice([2, 0, 0, 0, 1, 3]) for _ in range(n)]
    df = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(y)], "id string, y int").repartition(4)
    got = {r.id: r.fold for r in M.stratified_folds(df, "y", ["id"], hot_rows=hot_rows).collect()}
    assert [got[f"{i:04d}"] for i in range(n)] == deal(y)
    sizes = Counter((v, f) for v, f in zip(y, deal(y)))
    for v in set(y):
        per_fold = [sizes[(v, f)] for f in range(5)]
        assert max(per_fold) - min(per_fold) <= 1


def noisy(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0, 0, 0, 1, 1, 2, 3])
        rows.append((i, y, y * 0.6 + rng.gauss(0.4, 0.3), rng.uniform(0, 3)))
    return spark.createDataFrame(rows, "id int, y int, raw double, other double")


def kappa_of(df, cuts, raw="raw"):
    rows = df.withColumn("l", threshold_label(F.col(raw), cuts)).select("y", "l").collect()
    return kappa_by_matrix([r.y for r in rows], [r.l for r in rows])


def test_tuned_cut_points_are_the_best_of_the_grid(spark):
    df = noisy(spark, 200)
    cuts = [0.3, 0.6, 0.9, 1.4, 1.8]
    row = M.tune_thresholds(df, "y", "raw", cuts).first()
    every = {
        (a, b, c): kappa_of(df, [a, b, c]) for a in cuts for b in cuts for c in cuts if a <= b <= c
    }
    assert row.kappa == pytest.approx(max(every.values()))
    assert every[(row.t0, row.t1, row.t2)] == pytest.approx(row.kappa)


def test_tuning_never_loses_to_the_start(spark):
    df = noisy(spark)
    start = [0.5, 1.5, 2.5]
    found = M.refine_thresholds(df, "y", "raw", start, -0.5, 3.5)
    assert kappa_of(df, found) >= kappa_of(df, start)
    assert kappa_of(df, found) > kappa_of(df, start) + 0.01


def test_absent_labels_count_by_place(spark):
    """Without label 1 anywhere, 2 is the second label."""
    rows = [(i, 0 if i < 5 else 2, 0.0 if i < 4 else 3.0 if i == 9 else 2.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, y int, raw double, other double")
    row = M.tune_thresholds(df, "y", "raw", [1.0, 2.5]).first()
    assert row.kappa == pytest.approx(kappa_of(df, [row.t0, row.t1, row.t2]))


def test_missing_scores_get_the_last_label(spark):
    rows = [(0, 0, 0.1, 0.0), (1, 3, float("nan"), 0.0), (2, 3, None, 0.0), (3, 1, 1.0, 0.0), (4, 2, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, y int, raw double, other double")
    assert M.tune_thresholds(df, "y", "raw", [0.5, 1.5, 2.5]).first().kappa == 1.0


def test_blend_finds_the_useful_score(spark):
    df = noisy(spark)
    weights = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]] + M.blend_weights(2, 5, seed=1)
    assert all(sum(w) == pytest.approx(1) for w in weights)
    cuts = M.cut_grid(0.25, 2.5, 0.25)
    tuned = M.tune_blend(df, "y", ["raw", "other"], weights, cuts)
    best = M.best_blend(tuned).first()
    assert tuned.count() == 8 and best.w0 > 0.6
    alone = M.tune_thresholds(df, "y", "raw", cuts).first().kappa
    assert {r.candidate: r.kappa for r in tuned.collect()}[0] == pytest.approx(alone)


def test_summary_and_matrix(spark):
    rows = [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("b", 0, 1), ("b", 1, 1), ("b", 2, 2)]
    df = pairs(spark, rows).withColumnRenamed("g", "fold").withColumnRenamed("p", "label")
    row = M.cv_summary(df).first()
    ks = [kappa_by_matrix([0, 1, 2], [0, 1, 1]), kappa_by_matrix([0, 1, 2], [1, 1, 2])]
    assert row.cv_mean_kappa == pytest.approx(np.mean(ks)) and row.cv_std_kappa == pytest.approx(np.std(ks))
    assert row.oof_kappa == pytest.approx(kappa_by_matrix([r[1] for r in rows], [r[2] for r in rows]))
    cells = {(r.y_true, r.y_pred): r.n for r in M.confusion_matrix(df, "y", "label").collect()}
    assert cells == Counter((r[1], r[2]) for r in rows)
    assert M.accuracy(df, "y", "label").first().accuracy == pytest.approx(4 / 6)
