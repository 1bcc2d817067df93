"""Fitted artifacts on storage: tables as parquet, small values as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinecohort.operators.autoencoder import AutoEncoder
from kinecohort.operators.derive import OrdinalCodes
from kinecohort.operators.scaling import Standardizer


class LineageError(ValueError):
    """Model and scored data come from different preparation runs."""


def new_run_id() -> str:
    return uuid4().hex


def lineage_guard(trained_on: str, prepared_with: str) -> str:
    """The common run id; an error if the two differ."""
    if trained_on != prepared_with:
        raise LineageError(f"model was trained on run {trained_on}, data prepared with run {prepared_with}")
    return trained_on


@dataclass(frozen=True)
class FeatureArtifacts:
    """What feature engineering fits on the training rows."""

    group_stats: DataFrame
    codes: OrdinalCodes
    features: tuple[str, ...]


@dataclass(frozen=True)
class Artifacts:
    """All fitted values of one preparation run."""

    run_id: str
    by_set: dict[str, FeatureArtifacts]
    scaler: Standardizer | None = None
    encoder: AutoEncoder | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    # One line, written above.
    return json.loads(spark.read.text(path).first()[0])


def save_artifacts(artifacts: Artifacts, path: str) -> None:
    spark = None
    for name, a in artifacts.by_set.items():
        spark = a.group_stats.sparkSession
        a.group_stats.write.parquet(f"{path}/{name}/group_stats")
        a.codes.table.write.parquet(f"{path}/{name}/codes")
    if spark is None:
        raise ValueError("nothing to save")
    encoder = artifacts.encoder
    write_json(
        spark,
        f"{path}/meta",
        {
            "run_id": artifacts.run_id,
            "sets": {
                n: {"features": list(a.features), "coded": list(a.codes.cols)} for n, a in artifacts.by_set.items()
            },
            "scaler": artifacts.scaler and {"means": artifacts.scaler.means, "stds": artifacts.scaler.stds},
            "encoder": encoder
            and {"weights": [w.tolist() for w in encoder.weights], "biases": [b.tolist() for b in encoder.biases]},
            "extra": artifacts.extra,
        },
    )


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    meta = read_json(spark, f"{path}/meta")
    sets = {
        n: FeatureArtifacts(
            spark.read.parquet(f"{path}/{n}/group_stats"),
            OrdinalCodes(spark.read.parquet(f"{path}/{n}/codes"), tuple(s["coded"])),
            tuple(s["features"]),
        )
        for n, s in meta["sets"].items()
    }
    scaler = meta["scaler"] and Standardizer(meta["scaler"]["means"], meta["scaler"]["stds"])
    encoder = meta["encoder"] and AutoEncoder(
        tuple(np.array(w) for w in meta["encoder"]["weights"]),
        tuple(np.array(b) for b in meta["encoder"]["biases"]),
    )
    return Artifacts(meta["run_id"], sets, scaler, encoder, meta["extra"])
