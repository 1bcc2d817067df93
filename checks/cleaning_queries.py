"""Sources and cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import ITEMS, series, subject_columns, subjects
from checks.registry import names, over_both, over_series, over_subjects, query, tidy, tidy_sql
from kinecohort.functions.columns import cast_numeric_f32, col, mean_horizontal, null_count, threshold_label
from kinecohort.operators import cleaning, group_stats
from kinecohort.operators.derive import fit_ordinal
from kinecohort.plans import presets as P
from kinecohort.plans.prepare import clean_test, clean_train, relevant_and_targets
from kinecohort.sources import tables
from kinecohort.sources.artifacts import (
    Artifacts,
    FeatureArtifacts,
    lineage_guard,
    load_artifacts,
    new_run_id,
    save_artifacts,
)
from kinecohort.sources.shared import fresh_path

BIA = [c for c in subject_columns() if c.startswith("BIA")]
ALL = list(subject_columns())


def _relevant() -> list[str]:
    skipped = {*P.NOT_RELEVANT, "sii"}
    return [c for c in ALL if c not in skipped and not c.endswith("Season") and not c.startswith("PCIAT")]


RELEVANT = _relevant()
TARGETS = [c for c in ALL if c.startswith("PCIAT")] + ["sii"]


def missing_sql(cols) -> str:
    return "(" + " + ".join(f'(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END)' for c in cols) + ")"


# --- sources -----------------------------------------------------------------------

_FEW = ["id", "Basic_Demos-Enroll_Season", "Basic_Demos-Age", "Physical-BMI", "sii"]


@query("read_table", over_subjects(f"SELECT {names(_FEW)} FROM subjects", _FEW))
def read_table(spark, sf_dir):
    written = subjects(spark, sf_dir)
    path = fresh_path(spark, "subjects-csv")
    tables.write_table(written, path)
    return tables.read_table(spark, path, written.schema).select(*[col(c) for c in _FEW])


def _laid_out_series(spark, sf_dir):
    path = fresh_path(spark, "series")
    tables.write_series(series(spark, sf_dir), path)
    return tables.read_series(spark, path)


@query(
    "read_series",
    tidy_sql(over_series('SELECT id, step, enmo, light, "relative_date_PCIAT" FROM series'), ["enmo", "light", "relative_date_PCIAT"]),
)
def read_series(spark, sf_dir):
    return tidy(_laid_out_series(spark, sf_dir).select("id", "step", "enmo", "light", "relative_date_PCIAT"))


@query("series_inventory", over_series("SELECT id, count(*) AS n_rows, TRUE AS has_files FROM series GROUP BY id"))
def series_inventory(spark, sf_dir):
    found = tables.series_inventory(_laid_out_series(spark, sf_dir))
    return found.select("id", "n_rows", ((F.col("n_files") > 0) & (F.col("n_bytes") > 0)).alias("has_files"))


_STAT_KEYS = ["Basic_Demos-Age", "Basic_Demos-Sex"]
_STATS = ["BIA-BIA_Fat", "FGC-FGC_CU"]
_STATS_SQL = over_subjects(
    f"""SELECT {names(_STAT_KEYS)}, count(*) AS _group_rows,
    {", ".join(f'avg("{c}") AS "m{c}", coalesce(stddev_samp("{c}"), 1.0) AS "s{c}"' for c in _STATS)}
    FROM subjects GROUP BY {names(_STAT_KEYS)}"""
)
_CODES_SQL = over_subjects(
    """SELECT 'Physical-Season' AS "column", "Physical-Season" AS category, count(*) AS n,
    CAST(row_number() OVER (ORDER BY "Physical-Season") - 1 AS INT) AS code
    FROM subjects WHERE "Physical-Season" IS NOT NULL GROUP BY "Physical-Season" """,
    ["Physical-Season"],
)


def _saved(spark, sf_dir) -> tuple[str, str]:
    df = subjects(spark, sf_dir)
    fitted = FeatureArtifacts(
        group_stats.fit_group_stats(df, _STAT_KEYS, _STATS), fit_ordinal(df, ["Physical-Season"]), tuple(_STATS)
    )
    path, run = fresh_path(spark, "artifacts"), new_run_id()
    save_artifacts(Artifacts(run, {P.NORMAL: fitted}), path)
    return path, run


@query("save_artifacts", tidy_sql(_STATS_SQL, [f"{p}{c}" for c in _STATS for p in "ms"]))
def save_artifacts_query(spark, sf_dir):
    path, _ = _saved(spark, sf_dir)
    return tidy(load_artifacts(spark, path).by_set[P.NORMAL].group_stats)


@query("load_artifacts", _CODES_SQL)
def load_artifacts_query(spark, sf_dir):
    path, _ = _saved(spark, sf_dir)
    return load_artifacts(spark, path).by_set[P.NORMAL].codes.table.select("column", "category", "n", "code")


@query("lineage_guard", over_subjects("SELECT count(*) AS n_rows FROM subjects", ["id"]))
def lineage_guard_query(spark, sf_dir):
    path, run = _saved(spark, sf_dir)
    loaded = load_artifacts(spark, path)
    lineage_guard(run, loaded.run_id)
    return loaded.by_set[P.NORMAL].group_stats.agg(F.sum(group_stats.ROWS).alias("n_rows"))


@query(
    "write_predictions",
    """SELECT o_orderkey AS id, CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1
    WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS INT) AS label FROM orders""",
)
def write_predictions(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    labels = orders.select(
        F.col("o_orderkey").alias("id"), threshold_label(F.col("o_totalprice"), [1e5, 2e5, 3e5]).alias("label")
    )
    path = fresh_path(spark, "predictions")
    tables.write_predictions(labels, path)
    return spark.read.parquet(path)


@query("union_all", over_series("SELECT id, step FROM series"))
def union_all(spark, sf_dir):
    s = series(spark, sf_dir).select("id", "step", "weekday")
    return tables.union_all(*[s.filter(F.col("weekday") == d) for d in range(1, 8)]).select("id", "step")


# --- cleaning --------------------------------------------------------------------------

_ZERO = P.ZERO_MEANS_MISSING


@query(
    "zero_to_null",
    over_subjects(f"""SELECT id, {", ".join(f'NULLIF("{c}", 0) AS "{c}"' for c in _ZERO)} FROM subjects"""),
)
def zero_to_null(spark, sf_dir):
    return cleaning.zero_to_null(subjects(spark, sf_dir), _ZERO).select("id", *[col(c) for c in _ZERO])


_IN = ", ".join(f"'{i}'" for i in P.DROPPED_IDS)
_IN_BIA = ", ".join(f"'{i}'" for i in P.NO_BIA_IDS)


@query("drop_ids", over_subjects(f"""SELECT id, "Basic_Demos-Age" FROM subjects WHERE id NOT IN ({_IN})"""))
def drop_ids(spark, sf_dir):
    return cleaning.drop_ids(subjects(spark, sf_dir), P.DROPPED_IDS).select("id", col("Basic_Demos-Age"))


@query(
    "null_group_for_ids",
    over_subjects(
        f"""SELECT id, {", ".join(f'CASE WHEN id NOT IN ({_IN_BIA}) THEN "{c}" END AS "{c}"' for c in BIA)} FROM subjects"""
    ),
)
def null_group_for_ids(spark, sf_dir):
    return cleaning.null_group_for_ids(subjects(spark, sf_dir), P.NO_BIA_IDS, "BIA").select(
        "id", *[col(c) for c in BIA]
    )


_COMPLETE = f"""(s.id IS NOT NULL OR {missing_sql(RELEVANT)} < {len(RELEVANT)})
  AND (s.id IS NOT NULL OR {missing_sql(TARGETS)} = 0 OR {missing_sql(RELEVANT)} < {len(RELEVANT) - 1})"""
_WITH_SERIES = "subjects LEFT JOIN (SELECT DISTINCT id FROM series) s ON subjects.id = s.id"


@query(
    "completeness_filter",
    over_both(f"SELECT subjects.id FROM {_WITH_SERIES} WHERE {_COMPLETE}"),
)
def completeness_filter(spark, sf_dir):
    df = subjects(spark, sf_dir)
    relevant, targets = relevant_and_targets(df)
    return cleaning.completeness_filter(df, series(spark, sf_dir), relevant, targets).select("id")


@query("horizontal_null_count", over_subjects(f"SELECT id, CAST({missing_sql(ITEMS)} AS INT) AS n_missing FROM subjects"))
def horizontal_null_count(spark, sf_dir):
    return subjects(spark, sf_dir).select("id", null_count(ITEMS).alias("n_missing"))


_ITEM_SUM = "(" + " + ".join(f'coalesce("{c}", 0)' for c in ITEMS) + ")"
_ITEM_MEAN = f"CAST({_ITEM_SUM} AS DOUBLE) / NULLIF({len(ITEMS)} - {missing_sql(ITEMS)}, 0)"


@query("horizontal_mean", tidy_sql(over_subjects(f"SELECT id, {_ITEM_MEAN} AS item_mean FROM subjects"), ["item_mean"]))
def horizontal_mean(spark, sf_dir):
    return tidy(subjects(spark, sf_dir).select("id", mean_horizontal(ITEMS).alias("item_mean")))


_TOTAL = f'round("{P.TOTAL}" + {_ITEM_MEAN} * {missing_sql(ITEMS)})'


@query("prorate_total", over_subjects(f'SELECT id, {_TOTAL} AS "{P.TOTAL}" FROM subjects'))
def prorate_total(spark, sf_dir):
    return cleaning.prorate_total(subjects(spark, sf_dir), ITEMS, P.TOTAL).select("id", col(P.TOTAL))


def _relabel(total: str) -> str:
    return f"""CASE WHEN sii IS NOT NULL THEN CAST(CASE WHEN {total} < 30.5 THEN 0 WHEN {total} < 49.5 THEN 1
    WHEN {total} < 79.5 THEN 2 ELSE 3 END AS INT) END"""


_quoted_total = f'"{P.TOTAL}"'


@query("relabel_by_cutoffs", over_subjects(f"SELECT id, {_relabel(_quoted_total)} AS sii FROM subjects"))
def relabel_by_cutoffs(spark, sf_dir):
    return cleaning.relabel_by_cutoffs(subjects(spark, sf_dir), P.TOTAL, P.TARGET, P.LABEL_CUTS).select("id", "sii")


@query("drop_null_target", over_subjects("SELECT id, sii FROM subjects WHERE sii IS NOT NULL", ["id", "sii"]))
def drop_null_target(spark, sf_dir):
    return cleaning.drop_null_target(subjects(spark, sf_dir), P.TARGET).select("id", "sii")


@query(
    "select_features",
    over_subjects(f"SELECT * EXCLUDE ({names([*P.EXCLUDED_FEATURES, 'id'])}) FROM subjects"),
)
def select_features(spark, sf_dir):
    df = subjects(spark, sf_dir)
    return df.select(*[col(c) for c in cleaning.select_features(df, P.EXCLUDED_FEATURES)])


_ALIGNED = ["Physical-Weight", "BIA-BIA_Fat", "Basic_Demos-Age"]


@query("align_features", over_subjects(f"SELECT id, {names(_ALIGNED)} FROM subjects"))
def align_features(spark, sf_dir):
    return cleaning.align_features(subjects(spark, sf_dir), _ALIGNED)


_NUMERIC = ["X", "Z", "enmo", "light", "relative_date_PCIAT"]


@query(
    "cast_numeric_f32",
    tidy_sql(
        over_series(f"""SELECT id, {", ".join(f'CAST("{c}" AS REAL) AS "{c}"' for c in _NUMERIC)} FROM series"""), _NUMERIC
    ),
)
def cast_numeric(spark, sf_dir):
    return tidy(cast_numeric_f32(series(spark, sf_dir).select("id", *_NUMERIC)))


_KEPT = ["Physical-BMI", "Physical-Weight", "BIA-BIA_Fat", P.TOTAL, "sii"]
CLEANED_SQL = f"""SELECT * REPLACE (
  {", ".join(f'NULLIF("{c}", 0) AS "{c}"' for c in _ZERO)},
  {", ".join(f'CASE WHEN id NOT IN ({_IN_BIA}) THEN "{c}" END AS "{c}"' for c in BIA)},
  {_TOTAL} AS "{P.TOTAL}",
  {_relabel(_TOTAL)} AS sii)
FROM (SELECT subjects.* FROM {_WITH_SERIES}
      WHERE subjects.id NOT IN ({_IN}) AND {_COMPLETE}) kept"""


@query("clean_train", over_both(f"SELECT id, {names(_KEPT)} FROM ({CLEANED_SQL})"))
def clean_train_query(spark, sf_dir):
    return clean_train(subjects(spark, sf_dir), series(spark, sf_dir)).select("id", *[col(c) for c in _KEPT])


@query(
    "clean_test",
    over_subjects(f"""SELECT id, {", ".join(f'NULLIF("{c}", 0) AS "{c}"' for c in _ZERO)}, sii FROM subjects"""),
)
def clean_test_query(spark, sf_dir):
    return clean_test(subjects(spark, sf_dir)).select("id", *[col(c) for c in _ZERO], "sii")


@query(
    "has_series",
    over_both(f"SELECT subjects.id, s.id IS NOT NULL AS has_series FROM {_WITH_SERIES}", ["id"]),
)
def has_series(spark, sf_dir):
    return cleaning.has_series(subjects(spark, sf_dir).select("id"), series(spark, sf_dir))
