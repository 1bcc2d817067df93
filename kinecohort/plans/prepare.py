"""From raw subjects and series to feature tables, fitted on training data and reused."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from kinecohort.functions.columns import col, ending_with, floor_bin, starting_with
from kinecohort.operators import cleaning, derive
from kinecohort.operators.autoencoder import autoencode_features
from kinecohort.operators.group_stats import fit_group_stats, group_zscore
from kinecohort.operators.series import LAYOUT, SeriesLayout, series_features_v3
from kinecohort.plans import presets as P
from kinecohort.sources.artifacts import Artifacts, FeatureArtifacts, new_run_id
from kinecohort.sources.shared import materialize


# --- cleaning -------------------------------------------------------------------


def relevant_and_targets(df: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that count as information on a subject, and the target columns."""
    targets = [*starting_with(df, "PCIAT"), P.TARGET]
    skipped = {*ending_with(df, "Season"), *targets, *P.NOT_RELEVANT}
    return [c for c in df.columns if c not in skipped], targets


def clean_train(df: DataFrame, series: DataFrame, rounding: str = "half_up") -> DataFrame:
    relevant, targets = relevant_and_targets(df)
    items = [c for c in starting_with(df, "PCIAT") if c not in (P.TOTAL, "PCIAT-Season")]
    return (
        df.transform(cleaning.zero_to_null, P.ZERO_MEANS_MISSING)
        .transform(cleaning.drop_ids, P.DROPPED_IDS)
        .transform(cleaning.null_group_for_ids, P.NO_BIA_IDS, "BIA")
        .transform(cleaning.completeness_filter, series, relevant, targets)
        .transform(cleaning.prorate_total, items, P.TOTAL, rounding)
        .transform(cleaning.relabel_by_cutoffs, P.TOTAL, P.TARGET, P.LABEL_CUTS)
    )


def clean_test(df: DataFrame) -> DataFrame:
    """Scored rows are never dropped."""
    return cleaning.zero_to_null(df, P.ZERO_MEANS_MISSING)


def merge_series_features(subjects: DataFrame, features: DataFrame, id: str = "id") -> DataFrame:
    """All subjects, with the statistics of their series where there is one (both unique by id)."""
    return subjects.join(features, id, "left")


# --- feature engineering ------------------------------------------------------------


def group_columns(df: DataFrame) -> list[str]:
    fgc = [c for c in starting_with(df, "FGC") if not c.endswith("Zone")]
    return [c for c in fgc + starting_with(df, "BIA") if c not in P.NO_GROUP_STATS]


def with_group_bins(df: DataFrame) -> DataFrame:
    return derive.floor_bins(df, P.GROUP_BINS)


def create_features(df: DataFrame) -> DataFrame:
    return (
        df.transform(derive.missing_indicator, P.WAIST, P.WAIST_MISSING)
        .transform(derive.product_features, P.PRODUCTS)
        .transform(derive.ratio_features, P.RATIOS)
    )


def transform_features(df: DataFrame, season_into: str = "published") -> DataFrame:
    """Bins, merged alternates and filled categories, before the category codes."""
    return (
        df.withColumns({n: floor_bin(col(c), w) for n, (c, w) in P.SCORE_BIN.items()})
        .withColumn("PAQ_Total", derive.half_sum_of_alternates(*P.ALTERNATE_TOTALS))
        .transform(derive.coalesce_alternates, *P.ALTERNATE_SEASONS, P.SEASON_INTO[season_into])
        .transform(derive.fill_missing_category, P.SEASONS)
    )


class FeatureEngineering(Estimator):
    """Fits group statistics (all rows) and category codes (labelled rows)."""

    def __init__(self, seed: int = 0, season_into: str = "published", null_safe: bool = False):
        super().__init__()
        self.seed, self.season_into, self.null_safe = seed, season_into, null_safe

    def fit_transform(self, df: DataFrame) -> tuple[FeatureModel, DataFrame]:
        """The model, and the labelled training rows with their features."""
        binned = with_group_bins(df)
        scored = group_columns(df)
        # Written once: the fitted table is used for the rows here and again for scoring.
        stats = materialize(fit_group_stats(binned, P.GROUP_KEYS, scored), "group-stats")
        z = group_zscore(binned, P.GROUP_KEYS, scored, stats, null_safe=True, written=True).drop(*P.GROUP_BINS)
        # Read for the codes and for the rows; also spares the optimizer from inferring
        # constraints on the target through every cleaning rule.
        labelled = cleaning.drop_null_target(materialize(z, "z-scores"), P.TARGET)
        ready = transform_features(create_features(labelled), self.season_into)
        codes = derive.fit_ordinal(ready, P.SEASONS)
        codes = derive.OrdinalCodes(materialize(codes.table, "codes"), codes.cols)
        out = codes.transform(ready).transform(self._impute)
        features = tuple(cleaning.select_features(out, P.EXCLUDED_FEATURES))
        artifacts = FeatureArtifacts(stats, codes, features)
        return FeatureModel(artifacts, self.seed, self.season_into, self.null_safe), out

    def _impute(self, df: DataFrame) -> DataFrame:
        return derive.impute_linear_noise(df, P.WAIST, P.WAIST_SOURCE, P.WAIST_FACTOR, self.seed)

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        return self.fit_transform(dataset)[0]


class FeatureModel(Model):
    """Scores rows with the statistics and codes of the training rows; drops none."""

    def __init__(
        self,
        artifacts: FeatureArtifacts,
        seed: int = 0,
        season_into: str = "published",
        null_safe: bool = False,
    ):
        super().__init__()
        self.artifacts, self.seed, self.season_into, self.null_safe = artifacts, seed, season_into, null_safe

    def _transform(self, dataset: DataFrame) -> DataFrame:
        a = self.artifacts
        z = group_zscore(
            with_group_bins(dataset), P.GROUP_KEYS, group_columns(dataset), a.group_stats, self.null_safe, written=True
        ).drop(*P.GROUP_BINS)
        coded = a.codes.transform(transform_features(create_features(z), self.season_into))
        return derive.impute_linear_noise(coded, P.WAIST, P.WAIST_SOURCE, P.WAIST_FACTOR, self.seed)

    def aligned(self, dataset: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
        return cleaning.align_features(self.transform(dataset), self.artifacts.features, keep)


# --- whole preparation -----------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Feature tables by set name, the models that made them, and the fitted values."""

    frames: dict[str, DataFrame]
    models: dict[str, FeatureModel]
    artifacts: Artifacts

    @property
    def run_id(self) -> str:
        return self.artifacts.run_id

    def features(self, name: str) -> list[str]:
        return list(self.artifacts.by_set[name].features)


def prepare_train(
    subjects: DataFrame,
    series: DataFrame,
    layout: SeriesLayout = LAYOUT,
    autoencoder: dict[str, Any] | None = None,
    seed: int = 0,
    season_into: str = "published",
) -> Prepared:
    """Clean, reduce and encode the series, join, and fit the features of both sets."""
    cleaned = materialize(clean_train(subjects, series), "cleaned")
    stats = materialize(series_features_v3(series, layout), "series-features")
    encoded, encoder, scaler = autoencode_features(stats, seed=seed, **(autoencoder or P.AUTOENCODER))
    # Group statistics and codes depend on subject columns alone, so they are fitted and
    # applied once, before the series columns of either set are joined.
    model, frame = FeatureEngineering(seed, season_into).fit_transform(cleaned)
    frame = materialize(frame, "features")
    frames, models, by_set = {}, {}, {}
    for name, features in ((P.NORMAL, stats), (P.ENCODED, encoded)):
        # Training reads a feature table once per fold and member.
        frames[name] = materialize(merge_series_features(frame, features), f"features-{name}")
        by_set[name] = replace(model.artifacts, features=_feature_order(cleaned, features, frame))
        models[name] = FeatureModel(by_set[name], seed, season_into)
    artifacts = Artifacts(new_run_id(), by_set, scaler, encoder, {"seed": seed, "season_into": season_into})
    return Prepared(frames, models, artifacts)


def _feature_order(subjects: DataFrame, features: DataFrame, derived: DataFrame) -> tuple[str, ...]:
    """Subject columns, series columns, derived columns, as if derived from the joined table."""
    known = {*subjects.columns, P.ID}
    ordered = [
        *subjects.columns,
        *[c for c in features.columns if c not in known],
        *[c for c in derived.columns if c not in known],
    ]
    dropped = {*P.EXCLUDED_FEATURES, P.ID}
    return tuple(c for c in ordered if c not in dropped)


def prepare_test(
    subjects: DataFrame, series: DataFrame, artifacts: Artifacts, layout: SeriesLayout = LAYOUT
) -> Prepared:
    """The same with fitted values only; keeps every subject and the training feature list."""
    cleaned = clean_test(subjects)
    stats = materialize(series_features_v3(series, layout), "series-features")
    encoded, _, _ = autoencode_features(stats, model=artifacts.encoder, scaler=artifacts.scaler)
    frames, models = {}, {}
    # Any set's fitted values will do for the subject columns: they are the same in all.
    model = FeatureModel(artifacts.by_set[P.NORMAL], artifacts.extra["seed"], artifacts.extra["season_into"])
    derived = materialize(model.transform(cleaned), "features-scored")
    for name, features in ((P.NORMAL, stats), (P.ENCODED, encoded)):
        fitted = artifacts.by_set[name]
        frames[name] = cleaning.align_features(merge_series_features(derived, features), fitted.features)
        models[name] = FeatureModel(fitted, artifacts.extra["seed"], artifacts.extra["season_into"])
    return Prepared(frames, models, artifacts)


def feature_engineering(
    df: DataFrame, model: FeatureModel | None = None, seed: int = 0
) -> tuple[DataFrame, list[str], FeatureModel]:
    """Frame, feature names and fitted model; fits when no model is given."""
    if model is None:
        model, out = FeatureEngineering(seed).fit_transform(df)
    else:
        out = model.transform(df)
    return out, list(model.artifacts.features), model
