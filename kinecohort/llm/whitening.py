"""Whitening of embeddings: identical vectors are one vector with a multiplicity, fitted and transformed once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import pick
from kinecohort.operators.skew import lookup_join
from kinecohort.sources.shared import materialize

#: Steps of the grid that entries are put on.
SCALE = 256
#: Entries on the grid stay below this in size, so that differences from a mean are exact in doubles.
LARGEST = 1 << 50
#: Eigenvalues up to this share of the trace are rounding: such a direction has no variance to divide by.
NO_VARIANCE = 1e-13


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & finite


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """x and copies (rows that have it), each x once. Copies are counted before the shuffle, so they may be any share."""
    return materialize(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _weights(batch: pa.RecordBatch, weigh: str) -> np.ndarray:
    return batch.column("copies").to_numpy() if weigh == "copies" else np.ones(batch.num_rows, np.int64)


def scatter(vectors: DataFrame, column: str, weigh: str, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sum over the vectors of weight times the outer product of the centred vector with itself.

    The centre is whole + rest; what is exact in whole numbers is subtracted first. Each task multiplies its batches and
    gives one matrix, whose rows are then added up by place; the driver gets one matrix.
    """
    d = len(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                centred = (_matrix(batch, column) - whole).astype(np.float64) - rest
                total += (centred * _weights(batch, weigh)[:, None]).T @ centred
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select(column, "copies").mapInArrow(run, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


@dataclass(frozen=True)
class Whitening:
    """n (weight in all), sums per dimension, and the leading components: eigenvectors (columns) and eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and what is left of it."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """What a component's projection is divided by; NaN where it has no variance."""
        with np.errstate(invalid="ignore"):
            return np.where(self.values > NO_VARIANCE * self.trace, np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, components: int, weigh: str = "one") -> Whitening | None:
    """Mean and covariance (divisor n, centred first) of the distinct vectors, each with weight one or, with
    weigh="copies", as often as it occurs; None if there are none."""
    if weigh not in ("one", "copies"):
        raise ValueError(f"unknown weights: {weigh}")
    weight = F.col("copies") if weigh == "copies" else F.lit(1).cast("long")
    largest = F.array_max(F.transform("x", lambda c: F.abs(c)))
    n, least, most, high = vectors.agg(F.sum(weight), F.min(F.size("x")), F.max(F.size("x")), F.max(largest)).first()
    if not n or not most:
        return None
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries")
    if high >= LARGEST:
        raise ValueError(f"entries up to {high} steps of 1/{SCALE}; below {LARGEST} is exact here")
    placed = vectors.select(weight.alias("w"), F.posexplode("x").alias("i", "c"))
    sums = {r["i"]: int(r["s"]) for r in placed.groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)") * F.col("c")).alias("s")).collect()}
    model = Whitening(int(n), tuple(sums[i] for i in range(most)), np.zeros((most, 0)), np.zeros(0), 0.0)
    covariance = scatter(vectors, "x", weigh, *model.centre) / n
    values, own = np.linalg.eigh((covariance + covariance.T) / 2)
    values, own = values[::-1][:components], own[:, ::-1][:, :components]
    # A sign of our own: the largest entry is positive.
    own = own * np.sign(own[np.abs(own).argmax(axis=0), np.arange(own.shape[1])])
    return Whitening(model.n, model.sums, own, np.maximum(values, 0.0), float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, small: bool) -> list[int]:
    """Sum over the dimensions of (n * x - sums) squared, in whole numbers."""
    if small:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    out = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    if out and max(out) >= 1 << 63:
        raise OverflowError("a deviation is beyond 64 bits")
    return out


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """x, copies, deviation and whitened (an entry per component, null without variance) of every distinct vector."""
    whole, rest = model.centre
    sums, n, own, scales = np.array(model.sums, object), model.n, model.vectors, model.scales

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x")
            span = int(np.abs(x).max(initial=0)) * n + int(max(abs(s) for s in sums))
            small = span**2 * len(sums) < 1 << 62
            deviation = _deviations(x, n, sums.astype(np.int64) if small else sums, small)
            white = ((x - whole).astype(np.float64) - rest) @ own / scales
            made = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel(), from_pandas=True)
            )
            yield pa.record_batch(
                [batch.column("x"), batch.column("copies"), pa.array(deviation, pa.int64()), made], ["x", "copies", "deviation", "whitened"]
            )

    return vectors.mapInArrow(run, "x array<long>, copies long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Whitening, weigh: str = "one") -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over components with variance."""
    has = np.flatnonzero(~np.isnan(model.scales))
    if not len(has):
        return None
    picked = white.select("copies", F.array(*[F.col("whitened")[int(i)] for i in has]).alias("z"))
    weight = F.col("copies") if weigh == "copies" else F.lit(1)
    means = picked.agg(*[F.sum(weight * F.col("z")[i]) / model.n for i in range(len(has))]).first()
    found = scatter(picked, "z", weigh, np.zeros(len(has)), np.array(means, float)) / model.n
    return float(np.abs(found - np.eye(len(has))).max())


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 4, weigh: str = "one") -> DataFrame:
    """Row and component (1 upwards, by falling eigenvalue): id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has an entry that is null or not finite are dropped. Entries are put on a grid of 1/256
    (floor). Rows of one vector share its values, which are computed once and joined back; a vector that a third of the rows have
    is one row of the fit. Null and repeated ids are kept. A component without variance has null in `whitened`; if
    none has any, identity_error is null. Vectors of different lengths are an error; an empty table gives no rows, and so does one of
    empty vectors.
    """
    given = pick(rows, id, vector).filter(usable(F.col(vector))).select(F.col(id), on_grid(F.col(vector)).alias("x"))
    given = materialize(given, "grid")
    vectors = distinct_vectors(given)
    model = fit(vectors, components, weigh)
    kind = given.schema[id].dataType.simpleString()
    if model is None:
        schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    white = materialize(transform(vectors, model), "white")
    error = identity_error(white, model, weigh)
    joined = lookup_join(given, white, ["x"], "copies", written=True, spread_by=[id, "x"])
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]
    return joined.select(
        F.col(id),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        F.col(id),
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.array(*[F.lit(e).cast("double") for e in explained])[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
