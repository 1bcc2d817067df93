"""Whitening against whole matrices on the driver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinecohort.llm import whitening
from kinecohort.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(vectors, weights=None, components=4):
    """n, sums, deviations, whitened up to sign, shares."""
    x = np.array(vectors, np.int64)
    w = np.ones(len(x), np.int64) if weights is None else np.array(weights)
    n, sums = int(w.sum()), (x * w[:, None]).sum(axis=0)
    centred = x - sums / n
    values, own = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    values, own = values[::-1][:components], own[:, ::-1][:, :components]
    shares = values / (np.trace((centred * w[:, None]).T @ centred) / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ own / np.sqrt(values), shares


def test_every_embedding_of_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x = {r.vec_id: tuple(math.floor(256 * float(c)) for c in r.embedding) for r in rows}
    fitted = sorted(set(x.values()))
    n, deviations, white, shares = plain(fitted)
    place = {v: i for i, v in enumerate(fitted)}
    got = QUERIES["op12_whitening"](spark, SF_DIR).collect()
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        i, c = place[x[r.vec_id]], r.component - 1
        signs.setdefault(c, np.sign(white[i, c] * r.whitened))
        assert (r.n, r.deviation) == (n, deviations[i])
        assert r.whitened * signs[c] == pytest.approx(white[i, c], abs=1e-9)
        assert r.explained == pytest.approx(shares[c], rel=1e-9) and abs(r.identity_error) < 1e-9


@pytest.mark.parametrize("weigh", ["one", "copies"])
def test_a_vector_that_most_rows_have(spark, weigh):
    rng = np.random.default_rng(1)
    some = rng.normal(size=(40, 6)).round(2)
    rows = [(i, some[0 if i % 3 else i % 40].tolist()) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=3, weigh=weigh).collect()
    counts = {}
    for i, v in rows:
        v = tuple(np.floor(256 * np.array(v)).astype(int).tolist())
        counts.setdefault(v, []).append(i)
    n, deviations, white, shares = plain(list(counts), [len(c) if weigh == "copies" else 1 for c in counts.values()], 3)
    of = {i: k for k, ids in enumerate(counts.values()) for i in ids}
    assert len(got) == 900
    for r in got:
        assert (r.n, r.deviation) == (n, deviations[of[r.vec_id]])
        assert abs(r.whitened) == pytest.approx(abs(white[of[r.vec_id], r.component - 1]), abs=1e-9)
        assert r.explained == pytest.approx(shares[r.component - 1]) and r.identity_error < 1e-9


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5, 1.0], "x"), (1, [0.5, 1.0], "x"), (None, [0.25, -1.0], "x"), (2, None, "x"), (3, [None, 1.0], "x"), (4, [inf, 1.0], "x"),
        (5, [nan, 1.0], "x"), (6, [0.0, 3.0], "x"), (7, [-0.001, 2.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").withColumn("copies", F.lit("clash"))
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 6, 7) for c in (1, 2))
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    one = whitening.whiten(df.filter("vec_id = 6")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2
    assert whitening.whiten(df.filter("vec_id = 99")).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], "vec_id long, embedding array<double>")
    by = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(flat).collect()}
    assert by[0, 2] is None and by[0, 3] is None and abs(by[4, 1]) == pytest.approx(math.sqrt(2)) and len(by) == 15
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_deviations_beyond_small_numbers():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening._deviations(x[1:], 3, np.array([1, 2], object), False) == [8**2 + 10**2]
    with pytest.raises(OverflowError):
        whitening._deviations(x, 5, np.array([0, 0], object), False)
