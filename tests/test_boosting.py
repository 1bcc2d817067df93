"""Boosted trees against searches over all rows."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from kinecohort.operators import boosting as B


def rows_of(rng, n=160, width=3, kinds=6):
    x = rng.integers(0, kinds, (n, width)).astype(float)
    x[rng.random((n, width)) < 0.15] = math.nan
    y = np.nan_to_num(x[:, 0], nan=5) * 1.5 - 2 * (np.nan_to_num(x[:, 1], nan=-1) > 2) + rng.normal(0, 0.3, n)
    return x, y


def frame(spark, x, y):
    data = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, x array<double>, y double").withColumn("features", array_to_vector("x"))


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def score(g, s):
    return soft(g.sum(), s.l1) ** 2 / (len(g) + s.l2) if len(g) else 0.0


def candidates(x):
    for f in range(x.shape[1]):
        for cut in sorted(set(x[~np.isnan(x[:, f]), f]))[:-1] or []:
            for missing_left in (False, True):
                yield f, cut, missing_left


def goes_left(x, f, cut, missing_left):
    return np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)


def plain_tree(x, g, s, leaves, depth=None):
    """Values per row of a tree grown best leaf first, each split found by trying all."""
    def best(rows):
        found = []
        for f, cut, side in candidates(x):
            left = rows[goes_left(x[rows], f, cut, side)]
            right = np.setdiff1d(rows, left)
            if min(len(left), len(right)) >= s.min_rows:
                found.append((score(g[left], s) + score(g[right], s) - score(g[rows], s), left, right))
        return max(found, key=lambda t: t[0], default=None)

    parts = [(np.arange(len(x)), 0)]
    while len(parts) < leaves:
        each = [(best(rows), rows, d) for rows, d in parts]
        each = [(b, rows, d) for b, rows, d in each if b and b[0] > max(s.min_gain, 1e-12) and (depth is None or d < depth)]
        if not each:
            break
        (_, left, right), rows, d = max(each, key=lambda t: t[0][0])
        parts = [p for p in parts if p[0] is not rows] + [(left, d + 1), (right, d + 1)]
    out = np.zeros(len(x))
    for rows, _ in parts:
        out[rows] = -s.rate * soft(g[rows].sum(), s.l1) / (len(rows) + s.l2)
    return out


@pytest.mark.parametrize("l1,l2,leaves,depth,min_rows", [(0, 0, 5, None, 1), (4.0, 2.5, 8, None, 5), (1.0, 0, 8, 2, 3)])
def test_trees_are_those_of_a_search_over_all_splits(spark, l1, l2, leaves, depth, min_rows):
    x, y = rows_of(np.random.default_rng(leaves + int(l1)))
    s = B.Settings(trees=3, rate=0.5, leaves=leaves, depth=depth, min_rows=min_rows, l1=l1, l2=l2)
    model = B.BoostedRegressor(s).fit(frame(spark, x, y))
    raw = np.full(len(y), y.mean())
    for _ in range(3):
        raw = raw + plain_tree(x, raw - y, s, leaves, depth)
    got = {r.id: r.prediction for r in model.transform(frame(spark, x, y)).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(raw.tolist(), abs=1e-9)
    again = B.BoostedModel.from_json(model.to_json())
    assert {r.id: r.prediction for r in again.transform(frame(spark, x, y)).collect()} == got
    assert sum(model.featureImportances) == pytest.approx(1)


def test_levels_grow_all_their_leaves(spark):
    x, y = rows_of(np.random.default_rng(3))
    s = B.settings_of("XGBRegressor", {"n_estimators": 1, "max_depth": 2, "reg_lambda": 1.0, "learning_rate": 1.0, "reg_alpha": 0.5})
    assert (s.growth, s.depth, s.l1, s.l2) == ("level", 2, 0.5, 1.0)
    model = B.BoostedRegressor(s).fit(frame(spark, x, y))
    want = y.mean() + plain_tree(x, y.mean() - y, s, 4, 2)
    got = {r.id: r.prediction for r in model.transform(frame(spark, x, y)).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)


def test_symmetric_trees_split_whole_levels(spark):
    x, y = rows_of(np.random.default_rng(4), 90, 2, 4)
    s = B.settings_of("CatBoostRegressor", {"iterations": 2, "depth": 3, "learning_rate": 0.7, "reg_lambda": 1.5})
    model = B.BoostedRegressor(s).fit(frame(spark, x, y))
    raw = np.full(len(y), y.mean())
    for _ in range(2):
        g, leaf = raw - y, np.zeros(len(y), int)
        for _ in range(3):
            def gain(c):
                left = goes_left(x, *c)
                return sum(score(g[(leaf == k) & left], s) + score(g[(leaf == k) & ~left], s) - score(g[leaf == k], s) for k in set(leaf))

            gains = [(gain(c), c) for c in candidates(x)]
            best = max(v for v, _ in gains)
            c = next(c for v, c in gains if v >= best - 1e-9)
            leaf = leaf * 2 + ~goes_left(x, *c)
        for k in set(leaf):
            raw[leaf == k] -= s.rate * soft(g[leaf == k].sum(), s.l1) / ((leaf == k).sum() + s.l2)
    df = frame(spark, x, y)
    got = {r.id: (r.prediction, r.plain) for r in model.transform(df).withColumn("plain", model.plain(F.col("x"))).collect()}
    assert [got[i][0] for i in range(len(y))] == pytest.approx(raw.tolist(), abs=1e-9)
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in got.values())


def test_bagging_draws_every_so_many_trees(spark):
    keys = np.arange(20_000, dtype=np.int64)
    draws = [B.drawn(keys, 7, d, 0.4) for d in range(3)]
    assert all(abs(d.mean() - 0.4) < 0.02 for d in draws)
    assert abs((draws[0] & draws[1]).mean() - 0.16) < 0.02 and (B.drawn(keys, 7, 1, 0.4) == draws[1]).all()
    x, y = rows_of(np.random.default_rng(5))
    df = frame(spark, x, y)
    fit = lambda **k: B.BoostedRegressor(B.Settings(trees=3, leaves=4, min_rows=2, seed=1, **k), key="id").fit(df)
    whole, bagged, often = fit(), fit(bagging=0.5, bagging_freq=3), fit(bagging=0.5, bagging_freq=1)
    assert all(sum(t.rows[1:3]) == 160 for t in whole.trees)
    assert len({sum(t.rows[1:3]) for t in bagged.trees}) == 1 and 40 < sum(bagged.trees[0].rows[1:3]) < 120
    assert len({sum(t.rows[1:3]) for t in often.trees}) > 1
    assert fit(bagging=0.5, bagging_freq=3).to_json() == bagged.to_json()


def test_every_parameter_acts(spark):
    x, y = rows_of(np.random.default_rng(6))
    df = frame(spark, x, y)
    base = {"n_estimators": 2, "num_leaves": 6, "min_data_in_leaf": 3, "random_state": 1}
    plain = B.BoostedRegressor(B.settings_of("LGBMRegressor", base)).fit(df).trees
    least = min(g for t in plain for g in t.gain if g > 0)
    texts = {str(plain)}
    for more in ({"lambda_l1": 3.0}, {"reg_lambda": 9.0}, {"min_gain_to_split": least * 1.01}, {"bagging_fraction": 0.5, "bagging_freq": 1}, {"feature_fraction": 0.3}, {"max_depth": 1}):
        texts.add(str(B.BoostedRegressor(B.settings_of("LGBMRegressor", {**base, **more})).fit(df).trees))
    assert len(texts) == 7
    with pytest.raises(ValueError):
        B.settings_of("LGBMRegressor", {"no_such": 1})


def test_edges_and_no_rows(spark):
    x = np.array([[float(i % 700), 3.0, math.nan] for i in range(2100)])
    y = x[:, 0]
    model = B.BoostedRegressor(B.Settings(trees=1, leaves=3, min_rows=1)).fit(frame(spark, x, y))
    assert len(model.edges[0]) <= 254 and model.edges[1] == () and model.edges[2] == ()
    empty = B.BoostedRegressor(B.Settings(trees=1)).fit(frame(spark, x, y).filter("id < 0"))
    assert empty.trees == () and [r.prediction for r in empty.transform(frame(spark, x[:2], y[:2])).collect()] == [0.0, 0.0]
    same = B.BoostedRegressor(B.Settings(trees=5, min_rows=1)).fit(frame(spark, x[:5] * 0, y[:5]))
    assert same.trees == () and same.start == pytest.approx(2.0)


def test_more_trees_than_are_kept_in_memory(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 2)
    x, y = rows_of(np.random.default_rng(8))
    s = B.Settings(trees=5, rate=0.4, leaves=3, min_rows=4)
    model = B.BoostedRegressor(s).fit(frame(spark, x, y))
    raw = np.full(len(y), y.mean())
    for _ in range(5):
        raw = raw + plain_tree(x, raw - y, s, 3)
    got = {r.id: r.prediction for r in model.transform(frame(spark, x, y)).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(raw.tolist(), abs=1e-9)


def test_passes_read_runs_of_rows_and_only_the_depths_that_can_be_split(spark, monkeypatch, tmp_path):
    """A level's leaves of the greatest depth need no pass, a record holds many rows, and what was written for the fit goes."""
    looks, sums = [], B._Pass.sums

    def counted(look, tree, nodes, features):
        looks.append((look.rows.count(), len(nodes)))
        return sums(look, tree, nodes, features)

    monkeypatch.setattr(B._Pass, "sums", counted)
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "RUN_ROWS", (16, 16))
    monkeypatch.setattr(B, "fresh_path", lambda _, label: str(tmp_path / f"{label}-{len(looks)}"))
    x, y = rows_of(np.random.default_rng(9))
    s = B.settings_of("XGBRegressor", {"n_estimators": 3, "max_depth": 2, "subsample": 0.7})
    df = frame(spark, x, y).coalesce(1)
    model = B.BoostedRegressor(s, key="id").fit(df)
    assert looks == [(10, 1), (10, 2)] * 3
    assert not any(tmp_path.iterdir())
    key = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    key, raw = np.array([key[i] for i in range(len(y))]), np.full(len(y), y.mean())
    for number, tree in enumerate(model.trees):
        assert sum(tree.rows[1:3]) == B.drawn(key, s.seed, number, 0.7).sum()
        raw += tree.predict(B._to_bins(x.T, model.edges))
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(raw.tolist(), abs=1e-12)


def test_sparse_vectors_are_those_of_their_dense_form(spark):
    x, y = rows_of(np.random.default_rng(10))
    x[:, 2] = 0.0
    df = frame(spark, x, y)
    rows = [(i, SparseVector(3, [j for j in range(3) if v[j] != 0], [float(u) for u in v if u != 0]), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    sparse = spark.createDataFrame(rows, ["id", "features", "y"])
    s = B.Settings(trees=2, leaves=4, min_rows=2)
    dense, same = (B.BoostedRegressor(s).fit(d.coalesce(1)) for d in (df, sparse))
    assert dense.to_json() == same.to_json()
    got, want = ({r.id: r.prediction for r in dense.transform(d).collect()} for d in (sparse, df))
    assert got == want
