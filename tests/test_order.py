import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinecohort.operators.order import ranked, running_sum
from kinecohort.operators.quantiles import quantiles
from kinecohort.operators.series import SeriesLayout, rolling_std, time_gap
from kinecohort.operators.skew import lookup_join


def skewed_rows(n=3000, seed=1):
    """A third of the rows in one group, the rest in many small ones."""
    rng = random.Random(seed)
    ids = ["hot" if rng.random() < 0.4 else f"s{rng.randrange(40):02d}" for _ in range(n)]
    return [(i, k, round(rng.gauss(0, 50), 1)) for k, i in enumerate(ids)]


def by_id(rows):
    out = {}
    for i, step, x in rows:
        out.setdefault(i, []).append((step, x))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_rank_restarts_in_every_group(spark, hot_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id string, step long, x double").repartition(5)
    got = {(r.id, r.step): r._rank for r in ranked(df, ["id"], ["step"], hot_rows=hot_rows).collect()}
    want = {(i, s): k for i, v in by_id(rows).items() for k, (s, _) in enumerate(v)}
    assert got == want


def test_running_sum_over_blocks(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id string, step long, x double")
    out = running_sum(df, ["id"], ["step"], "x", "before", block_rows=64).collect()
    for i, v in by_id(rows).items():
        total = 0.0
        got = {r.step: r.before for r in out if r.id == i}
        for s, x in v:
            assert got[s] == pytest.approx(total, abs=1e-6)
            total += x


@pytest.mark.parametrize("window,block", [(10, 64), (10, 5), (25, 4096), (2, 2)])
def test_rolling_std_equals_sliding_frame(spark, window, block):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id string, step long, x double")
    layout = SeriesLayout(window=window, block_rows=block)
    out = rolling_std(df, F.col("x"), "r", layout).collect()
    assert len(out) == len(rows)
    got = {(r.id, r.step): r.r for r in out}
    for i, v in by_id(rows).items():
        xs = [x for _, x in v]
        for k, (s, _) in enumerate(v):
            want = np.std(xs[k - window + 1 : k + 1], ddof=1) if k + 1 >= window else 0.0
            assert got[(i, s)] == pytest.approx(want, abs=1e-9)


def test_rolling_std_of_a_flat_stretch_is_zero_after_large_values(spark):
    rows = [("a", k, 1e6 * math.sin(k) if k < 50 else 0.1) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, step long, x double")
    out = rolling_std(df, F.col("x"), "r", SeriesLayout(window=20, block_rows=64)).collect()
    assert max(r.r for r in out if r.step >= 70) < 1e-15


def test_rolling_std_needs_a_full_window_of_values(spark):
    rows = [("a", k, None if k == 12 else float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, step long, x double")
    got = {r.step: r.r for r in rolling_std(df, F.col("x"), "r", SeriesLayout(window=5)).collect()}
    assert [s for s, v in got.items() if v == 0] != []
    assert all((got[s] == 0) == (s < 4 or 12 <= s <= 16) for s in got)


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_first_gap_and_gaps_across_blocks(spark, block):
    rows = [("a", k, float(k // 10), (k % 10) * 60 * 10**9) for k in range(40)]
    rows += [("b", 1000 + k, -1.0, k * 7 * 10**9) for k in range(3)]
    df = spark.createDataFrame(rows, "id string, step long, relative_date_PCIAT double, time_of_day long")
    got = {(r.id, r.step): r.time_diff for r in time_gap(df, SeriesLayout(block_rows=block)).collect()}
    assert got[("a", 0)] == 5 and got[("b", 1000)] == 5
    assert got[("a", 1)] == 60 and got[("a", 10)] == 86400 - 540 and got[("b", 1002)] == 7


def element(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1) + 0.5)]


@pytest.mark.parametrize("small_rows,hot_rows", [(10**6, 10**9), (200, 10**9), (10, 10**9), (10, 100)])
def test_nearest_quantiles_on_both_routes(spark, small_rows, hot_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id string, step long, x double").withColumn("y", F.lit(3.0))
    out = quantiles(df, ["id"], ["x", "y", "step"], small_rows=small_rows, hot_rows=hot_rows)
    got = {r.id: r for r in out.collect()}
    groups = by_id(rows)
    assert got.keys() == groups.keys()
    for i, v in groups.items():
        for q in (25, 50, 75):
            assert got[i][f"x_q{q}"] == element([x for _, x in v], q / 100)
            assert got[i][f"step_q{q}"] == element([s for s, _ in v], q / 100)
            assert got[i][f"y_q{q}"] == 3.0


@pytest.mark.parametrize("small_rows", [10**6, 1])
def test_linear_quantiles_and_nulls(spark, small_rows):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", None), ("a", float("nan")), ("b", None), ("b", None)]
    df = spark.createDataFrame(rows, "id string, x double")
    got = {r.id: r for r in quantiles(df, ["id"], ["x"], method="linear", small_rows=small_rows).collect()}
    assert (got["a"].x_q25, got["a"].x_q50, got["a"].x_q75) == (1.75, 2.5, 3.25)
    assert got["b"].x_q50 is None


def test_nearest_of_four(spark):
    df = spark.createDataFrame([("a", float(k)) for k in (1, 2, 3, 4)], "id string, x double")
    row = quantiles(df, ["id"], ["x"]).first()
    assert (row.x_q25, row.x_q50, row.x_q75) == (2, 3, 3)


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_lookup_join_null_keys(spark, null_safe, hot_rows):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, "c"), (5, None), (6, "x")], "r long, key string")
    table = spark.createDataFrame([("k", 3, 10), ("c", 1, 20), (None, 1, 30)], "key string, w long, v long")
    got = {r.r: r.v for r in lookup_join(rows, table, ["key"], "w", null_safe=null_safe, hot_rows=hot_rows).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 20, 5: 30 if null_safe else None, 6: None}
    inner = lookup_join(rows, table, ["key"], "w", how="inner", null_safe=null_safe, hot_rows=hot_rows)
    assert inner.count() == (5 if null_safe else 4)
