"""Trained models on storage, so that another job can score with them."""

from __future__ import annotations

from typing import Any

from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import SparkSession

from kinecohort.operators.boosting import BoostedModel
from kinecohort.operators.ensemble import FeatureVector, FittedEnsemble, Member
from kinecohort.plans.training import Level1, Level2, Trained
from kinecohort.sources.artifacts import read_json, write_json

_READERS = {c.__name__: c for c in (GBTRegressionModel, RandomForestRegressionModel)}


def _save_ensemble(model: FittedEnsemble, path: str) -> list[dict[str, Any]]:
    """Write the members' models; returns how they belong together."""
    out = []
    for i, m in enumerate(model.members):
        entry: dict[str, Any] = {"name": m.name, "weight": m.weight}
        if isinstance(m.model, FittedEnsemble):
            entry["members"] = _save_ensemble(m.model, f"{path}/{i}")
        elif isinstance(m.model, BoostedModel):
            entry["trees"] = m.model.to_json()
        else:
            entry["class"] = type(m.model).__name__
            m.model.write().save(f"{path}/{i}")
        out.append(entry)
    return out


def _load_ensemble(entries: list[dict[str, Any]], path: str) -> FittedEnsemble:
    members = []
    for i, e in enumerate(entries):
        if "members" in e:
            model: Any = _load_ensemble(e["members"], f"{path}/{i}")
        elif "trees" in e:
            model = BoostedModel.from_json(e["trees"])
        else:
            model = _READERS[e["class"]].load(f"{path}/{i}")
        members.append(Member(e["name"], e["weight"], model))
    return FittedEnsemble(tuple(members))


def save_models(spark: SparkSession, trained: Trained, path: str) -> None:
    level1 = {
        name: {
            "feature_set": m.feature_set,
            "names": list(m.vector.names),
            "fills": list(m.vector.fills),
            "members": _save_ensemble(m.model, f"{path}/level1/{name}"),
        }
        for name, m in trained.level1.items()
    }
    level2 = trained.level2
    level2.model.write().save(f"{path}/level2")
    meta = {
        "run_id": trained.run_id,
        "level1": level1,
        "level2": {"names": list(level2.names), "thresholds": list(level2.thresholds)},
    }
    write_json(spark, f"{path}/meta", meta)


def load_models(spark: SparkSession, path: str) -> Trained:
    meta = read_json(spark, f"{path}/meta")
    level1 = {
        name: Level1(
            name,
            m["feature_set"],
            FeatureVector(tuple(m["names"]), tuple(m["fills"])),
            _load_ensemble(m["members"], f"{path}/level1/{name}"),
        )
        for name, m in meta["level1"].items()
    }
    level2 = Level2(
        tuple(meta["level2"]["names"]),
        LinearRegressionModel.load(f"{path}/level2"),
        tuple(meta["level2"]["thresholds"]),
    )
    return Trained(meta["run_id"], level1, level2)
