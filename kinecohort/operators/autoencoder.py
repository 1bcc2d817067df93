"""Compressing numeric columns with a small dense autoencoder.

Layers d -> 2k -> k -> 2k -> d, each followed by a ReLU (the output too, so negative
standardised values cannot be reproduced). Training is full-batch: every epoch is one
Spark job in which each task sums the gradients of its own rows; the driver sees only
sums as large as the model and takes the Adam step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, finite_or_null
from kinecohort.operators.scaling import Standardizer, fit_standardizer

# Up to this many partial sums go to the driver as they are; more are summed in groups.
DIRECT_PARTS = 64
ENCODER_LAYERS = 2


@dataclass(frozen=True)
class AutoEncoder:
    """Weights and biases of the four layers, in order."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    losses: tuple[float, ...] = ()

    @property
    def encoding_dim(self) -> int:
        return self.biases[ENCODER_LAYERS - 1].shape[0]

    def forward(self, x: np.ndarray, layers: int) -> np.ndarray:
        for w, b in zip(self.weights[:layers], self.biases[:layers]):
            x = np.maximum(x @ w + b, 0.0)
        return x


def _shapes(input_dim: int, encoding_dim: int) -> list[tuple[int, int]]:
    widths = [input_dim, 2 * encoding_dim, encoding_dim, 2 * encoding_dim, input_dim]
    return list(zip(widths, widths[1:]))


def initial_autoencoder(input_dim: int, encoding_dim: int, seed: int) -> AutoEncoder:
    """Uniform in +-1/sqrt(fan in), the usual start of dense layers."""
    rng = np.random.default_rng(seed)
    weights, biases = [], []
    for fan_in, fan_out in _shapes(input_dim, encoding_dim):
        bound = 1 / math.sqrt(fan_in)
        weights.append(rng.uniform(-bound, bound, (fan_in, fan_out)))
        biases.append(rng.uniform(-bound, bound, fan_out))
    return AutoEncoder(tuple(weights), tuple(biases))


def _gradient_sums(model: AutoEncoder, x: np.ndarray) -> np.ndarray:
    """[squared error, rows, gradient of the squared error, flattened layer by layer]."""
    outputs = [x]
    for w, b in zip(model.weights, model.biases):
        outputs.append(np.maximum(outputs[-1] @ w + b, 0.0))
    error = outputs[-1] - x
    delta = 2 * error * (outputs[-1] > 0)
    parts: list[np.ndarray] = []
    for i in reversed(range(len(model.weights))):
        parts.append(delta.sum(axis=0))
        parts.append((outputs[i].T @ delta).ravel())
        delta = (delta @ model.weights[i].T) * (outputs[i] > 0)
    return np.concatenate([[float((error**2).sum()), float(len(x))], *reversed(parts)])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _epoch_sums(data: DataFrame, model: AutoEncoder, width: int, parts: int) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                sums = _gradient_sums(model, _matrix(batch, width))
                total = sums if total is None else total + sums
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": [total.tobytes()]})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = sum(np.frombuffer(s) for s in pdf["sums"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [total.tobytes()]})

    sums = data.mapInArrow(partial, "part int, sums binary")
    if parts > DIRECT_PARTS:
        groups = math.isqrt(parts) + 1
        sums = sums.groupBy(F.col("part") % groups).applyInPandas(add_up, "part int, sums binary")
    # In order of the parts, so that a repeated fit adds in the same order.
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    return sum(np.frombuffer(bytes(r["sums"])) for r in rows)


def _vector_column(df: DataFrame, cols: Sequence[str]):
    """Inputs as one array; missing standardised values count as 0, the column mean."""
    return F.array(*[F.coalesce(finite_or_null(col(c).cast("double")), F.lit(0.0)) for c in cols])


def fit_autoencoder(
    df: DataFrame,
    cols: Sequence[str],
    encoding_dim: int = 30,
    epochs: int = 100,
    learning_rate: float = 0.001,
    seed: int = 0,
) -> AutoEncoder:
    """Minimise the mean squared reconstruction error by full-batch Adam."""
    width = len(cols)
    model = initial_autoencoder(width, encoding_dim, seed)
    data = df.select(_vector_column(df, cols).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    # Also fills the cache.
    part_ids = data.select(F.spark_partition_id().alias("p"))
    parts = (part_ids.agg(F.max("p")).first()[0] or 0) + 1
    flat = np.concatenate([p.ravel() for wb in zip(model.weights, model.biases) for p in wb])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    # The usual decay rates and epsilon of Adam.
    beta1, beta2, epsilon = 0.9, 0.999, 1e-8
    losses = []
    try:
        for epoch in range(1, epochs + 1):
            sums = _epoch_sums(data, model, width, parts)
            values = sums[1] * width
            losses.append(float(sums[0] / values))
            gradient = sums[2:] / values
            first = beta1 * first + (1 - beta1) * gradient
            second = beta2 * second + (1 - beta2) * gradient**2
            step = (first / (1 - beta1**epoch)) / (np.sqrt(second / (1 - beta2**epoch)) + epsilon)
            flat = flat - learning_rate * step
            model = _unflatten(flat, width, encoding_dim)
    finally:
        data.unpersist()
    return AutoEncoder(model.weights, model.biases, tuple(losses))


def _unflatten(flat: np.ndarray, input_dim: int, encoding_dim: int) -> AutoEncoder:
    weights, biases, at = [], [], 0
    for fan_in, fan_out in _shapes(input_dim, encoding_dim):
        weights.append(flat[at : at + fan_in * fan_out].reshape(fan_in, fan_out))
        at += fan_in * fan_out
        biases.append(flat[at : at + fan_out])
        at += fan_out
    return AutoEncoder(tuple(weights), tuple(biases))


def encode(df: DataFrame, cols: Sequence[str], model: AutoEncoder, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Output of the middle layer as ``column_0`` .. ``column_<k-1>`` next to the kept columns."""

    @F.pandas_udf("array<double>")
    def middle(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            if len(x):
                yield pd.Series(list(model.forward(np.stack(x.to_numpy()), ENCODER_LAYERS)), index=x.index)
            else:
                yield pd.Series([], dtype=object)

    encoded = df.select(*[col(c) for c in keep], middle(_vector_column(df, cols)).alias("_code"))
    return encoded.select(
        *[col(c) for c in keep],
        *[F.col("_code")[i].alias(f"column_{i}") for i in range(model.encoding_dim)],
    )


def autoencode_features(
    df: DataFrame,
    id: str = "id",
    model: AutoEncoder | None = None,
    scaler: Standardizer | None = None,
    encoding_dim: int = 30,
    epochs: int = 100,
    learning_rate: float = 0.001,
    seed: int = 0,
) -> tuple[DataFrame, AutoEncoder, Standardizer]:
    """Standardise all columns but the id and encode them; fits only what is not passed in."""
    cols = scaler.cols if scaler else [c for c in df.columns if c != id]
    scaler = scaler or fit_standardizer(df, cols)
    scaled = scaler.transform(df)
    model = model or fit_autoencoder(scaled, cols, encoding_dim, epochs, learning_rate, seed)
    return encode(scaled, cols, model, [id]), model, scaler
