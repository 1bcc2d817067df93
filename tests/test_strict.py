"""Rows that would vanish, values that are not numbers, and distributions that equal-width bins cannot part."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinecohort.operators import ensemble as E
from kinecohort.operators import profile
from kinecohort.operators import quantiles as Q
from kinecohort.operators import scoring as M
from kinecohort.sources.tables import read_table

NAN = float("nan")


def test_cells_of_another_type_are_errors(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n\na,1\nb,abc\nc,\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_table(spark, str(tmp_path / "t.csv"), "id string, n int").collect()
    rows = read_table(spark, str(tmp_path / "t.csv"), "id string, n int", mode="PERMISSIVE").collect()
    assert [r.n for r in rows] == [1, None, None]


@pytest.mark.parametrize("second", [[("a", 1.0)], [("a", 1.0), ("b", 2.0), ("b", 3.0)], [("a", 1.0), (None, 2.0)]])
def test_stacking_refuses_ids_not_predicted_once(spark, second):
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, raw double")
    other = spark.createDataFrame(second, "id string, raw double")
    with pytest.raises(Exception, match="not predicted once"):
        E.stack_predictions({"x": first, "y": other}).collect()
    assert E.stack_predictions({"x": first, "y": first}).count() == 2


@pytest.mark.parametrize("label", [None, 7.0, -1.0, 1.5, NAN])
def test_labels_off_the_scale_are_errors(spark, label):
    rows = spark.createDataFrame([(0.0, 0.1), (1.0, 1.1), (label, 2.0)], "y double, raw double")
    with pytest.raises(Exception, match="off the scale"):
        M.tune_thresholds(rows, "y", "raw", [0.5, 1.5, 2.5]).collect()
    with pytest.raises(Exception, match="off the scale"):
        M.tune_blend(rows, "y", ["raw"], [[1.0]], [0.5, 1.5, 2.5]).collect()


def test_scores_are_not_labels(spark):
    rows = spark.range(3000).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("label"))
    with pytest.raises(Exception, match="more than 1000 labels"):
        M.quadratic_kappa(rows, "y", "label").collect()


def test_a_null_group_has_a_density(spark):
    rows = spark.createDataFrame([(g, float(i)) for g in ("a", None) for i in range(20)] + [("a", NAN)], "g string, x double")
    got = profile.kde_density(rows, "x", steps=4, group="g").collect()
    assert len(got) == 10 and not any(math.isnan(r.density) for r in got)
    each = {g: [r.density for r in sorted(got, key=lambda r: r.value) if r.g == g] for g in ("a", None)}
    assert each["a"] == pytest.approx(each[None])


def test_nan_is_in_no_bin(spark):
    rows = spark.createDataFrame([(1.0,), (30.0,), (NAN,), (None,)], "x double")
    assert {r["bin_start"]: r["count"] for r in profile.histogram(rows, "x", 25).collect()} == {0.0: 1, 25.0: 1}
    box = profile.box_stats(rows.withColumn("g", F.lit(1)), "x", "g").first()
    assert box.outliers == 0 and box.median == 15.5


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    n = 6000
    mixed = np.where(rng.random(n) < 0.5, 0.0, -np.exp(300 * rng.random(n) - 150))
    normal = np.concatenate([rng.normal(size=n - 6), [np.inf, -np.inf, NAN, 0, 1e308, -1e308]])
    data = pd.DataFrame({"k": rng.integers(0, 2, n), "a": np.exp(60 * rng.random(n)), "b": normal, "c": mixed})
    return spark.createDataFrame(data)


def test_narrowing_ends_for_any_distribution(wide, monkeypatch):
    probs = (0.0, 0.25, 0.5, 1.0)
    seen = []
    count = Q.largest_interval
    monkeypatch.setattr(Q, "largest_interval", lambda state: seen.append(count(state)) or seen[-1])
    monkeypatch.setattr(Q, "LAST_VALUES", 40)
    narrowed = Q.quantiles(wide, ["k"], ["a", "b", "c"], probs, small_rows=10).orderBy("k").collect()
    sorted_ = Q.quantiles(wide, ["k"], ["a", "b", "c"], probs).orderBy("k").collect()
    assert [r.asDict() for r in narrowed] == [{c: s[c] for c in n.asDict()} for n, s in zip(narrowed, sorted_)]
    assert seen[-1] <= 40 < seen[0]
