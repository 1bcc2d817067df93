"""Group statistics, derived features, feature engineering and profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.cleaning_queries import ALL, BIA, CLEANED_SQL
from checks.data import series, subject_columns, subjects, table
from checks.registry import names, over_both, over_subjects, query, tidy, tidy_sql
from checks.series_queries import BASIC_NAMES, BASIC_SQL
from kinecohort.functions.columns import col
from kinecohort.operators import derive, group_stats, profile
from kinecohort.operators.series import series_basic_stats
from kinecohort.plans import presets as P
from kinecohort.plans.prepare import (
    FeatureEngineering,
    clean_test,
    clean_train,
    feature_engineering,
    merge_series_features,
)
from kinecohort.sources.shared import materialize

# --- group statistics ------------------------------------------------------------------
# Order lines in groups of flag, status, quantity and size; the status is missing on some
# lines, so that a null key occurs. Fitted on the lines shipped before the cut-off.

_KEYS = ["l_returnflag", "l_linestatus", "qbin", "sbin"]
_MEASURES = ["l_extendedprice", "l_tax"]
_FITTED_BEFORE = "1998-07-01"
LINES_SQL = """SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_tax, l_discount, l_returnflag,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS l_linestatus,
  CAST(floor(l_quantity / 10) AS BIGINT) AS qbin, CAST(floor(CAST(p_size AS DOUBLE) / 6) AS BIGINT) AS sbin
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )
    missing = F.when(F.col("l_linenumber") != 7, F.col("l_linestatus"))
    kept = items.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_tax", "l_discount", "l_quantity",
        "l_returnflag", missing.alias("l_linestatus"), F.col("p_size").cast("double").alias("p_size"),
    )
    return derive.floor_bins(kept, {"qbin": ("l_quantity", 10), "sbin": ("p_size", 6)})


_STATS_SQL = f"""SELECT {names(_KEYS)}, count(*) AS _group_rows,
  {", ".join(f'avg({c}) AS m{c}, coalesce(stddev_samp({c}), 1.0) AS s{c}' for c in _MEASURES)}
  FROM (LINES) GROUP BY {names(_KEYS)}"""
_FITTED_SQL = _STATS_SQL.replace("LINES", f"SELECT * FROM ({LINES_SQL}) WHERE l_shipdate < '{_FITTED_BEFORE}'")
_STAT_NAMES = [f"{p}{c}" for c in _MEASURES for p in "ms"]
_Z_NAMES = [f"t{c}" for c in _MEASURES]


def _fitted(rows):
    return group_stats.fit_group_stats(rows.filter(F.col("l_shipdate") < F.lit(_FITTED_BEFORE)), _KEYS, _MEASURES)


@query("fit_group_stats", tidy_sql(_STATS_SQL.replace("LINES", LINES_SQL), _STAT_NAMES))
def fit_group_stats(spark, sf_dir):
    return tidy(group_stats.fit_group_stats(lines(spark, sf_dir), _KEYS, _MEASURES))


_Z_SQL = ", ".join(
    f"({c} - avg({c}) OVER g) / (coalesce(stddev_samp({c}) OVER g, 1.0) + 1e-7::DOUBLE) AS t{c}" for c in _MEASURES
)


@query(
    "group_zscore",
    tidy_sql(
        f"SELECT l_orderkey, l_linenumber, {_Z_SQL} FROM ({LINES_SQL}) WINDOW g AS (PARTITION BY {names(_KEYS)})", _Z_NAMES
    ),
)
def group_zscore(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *_KEYS, *_MEASURES)
    out = group_stats.group_zscore(rows, _KEYS, _MEASURES)
    return tidy(out.select("l_orderkey", "l_linenumber", *_Z_NAMES))


def _applied(null_safe: bool) -> str:
    equal = "IS NOT DISTINCT FROM" if null_safe else "="
    on = " AND ".join(f"r.{k} {equal} s.{k}" for k in _KEYS)
    return f"SELECT l_orderkey, l_linenumber, {names(_STAT_NAMES)} FROM ({LINES_SQL}) r LEFT JOIN ({_FITTED_SQL}) s ON {on}"


@query("apply_group_stats", tidy_sql(_applied(False), _STAT_NAMES))
def apply_group_stats(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = group_stats.apply_group_stats(rows, _fitted(rows), _KEYS)
    return tidy(out.select("l_orderkey", "l_linenumber", *_STAT_NAMES))


@query("apply_group_stats_null_safe", tidy_sql(_applied(True), _STAT_NAMES))
def apply_group_stats_null_safe(spark, sf_dir):
    """Hot groups take the other route here: the limit is set below the largest groups."""
    rows = lines(spark, sf_dir)
    out = group_stats.apply_group_stats(rows, _fitted(rows), _KEYS, null_safe=True, hot_rows=100)
    return tidy(out.select("l_orderkey", "l_linenumber", *_STAT_NAMES))


@query("distinct_rows", f"SELECT DISTINCT {names(_KEYS)} FROM ({LINES_SQL})")
def distinct_rows(spark, sf_dir):
    return group_stats.distinct_rows(lines(spark, sf_dir).select(*_KEYS))


# --- derived features ----------------------------------------------------------------------


@query(
    "missing_indicator",
    over_subjects(f'SELECT id, "{P.WAIST}" IS NULL AS {P.WAIST_MISSING} FROM subjects', ["id", P.WAIST]),
)
def missing_indicator(spark, sf_dir):
    return derive.missing_indicator(subjects(spark, sf_dir), P.WAIST, P.WAIST_MISSING).select("id", P.WAIST_MISSING)


_PRODUCTS = ", ".join(f'"{a}" * "{b}" AS "{n}"' for n, (a, b) in P.PRODUCTS.items())
_RATIOS = ", ".join(f'CAST("{a}" AS DOUBLE) / CAST("{b}" AS DOUBLE) AS "{n}"' for n, (a, b) in P.RATIOS.items())


@query("product_features", tidy_sql(over_subjects(f"SELECT id, {_PRODUCTS} FROM subjects"), P.PRODUCTS))
def product_features(spark, sf_dir):
    out = derive.product_features(subjects(spark, sf_dir), P.PRODUCTS).select("id", *P.PRODUCTS)
    return tidy(out.withColumns({c: col(c).cast("double") for c in P.PRODUCTS}))


@query("ratio_features", tidy_sql(over_subjects(f"SELECT id, {_RATIOS} FROM subjects"), P.RATIOS))
def ratio_features(spark, sf_dir):
    return tidy(derive.ratio_features(subjects(spark, sf_dir), P.RATIOS).select("id", *P.RATIOS))


_BINS = {"score": ("CGAS-CGAS_Score", 5), **P.GROUP_BINS}


@query(
    "floor_bin",
    over_subjects(
        "SELECT id, {} FROM subjects".format(
            ", ".join(f'CAST(floor(CAST("{c}" AS DOUBLE) / {w}) AS BIGINT) AS "{n}"' for n, (c, w) in _BINS.items())
        )
    ),
)
def floor_bin(spark, sf_dir):
    return derive.floor_bins(subjects(spark, sf_dir), _BINS).select("id", *_BINS)


_C, _A = P.ALTERNATE_TOTALS
_PAQ = f"""CASE WHEN "{_C}" IS NOT NULL OR "{_A}" IS NOT NULL
  THEN (coalesce("{_C}", 0) + coalesce("{_A}", 0)) / 2 END"""


@query("half_sum_of_alternates", tidy_sql(over_subjects(f"SELECT id, {_PAQ} AS paq FROM subjects"), ["paq"]))
def half_sum_of_alternates(spark, sf_dir):
    return tidy(subjects(spark, sf_dir).select("id", derive.half_sum_of_alternates(_C, _A).alias("paq")))


_SC, _SA = P.ALTERNATE_SEASONS


@query(
    "coalesce_alternates",
    over_subjects(f'SELECT id, "{_SC}", coalesce("{_SC}", "{_SA}") AS "{_SA}" FROM subjects', ["id", _SC, _SA]),
)
def coalesce_alternates(spark, sf_dir):
    return derive.coalesce_alternates(subjects(spark, sf_dir, ["id", _SC, _SA]), _SC, _SA, _SA)


@query(
    "fill_missing_category",
    over_subjects(
        "SELECT id, {} FROM subjects".format(", ".join(f"""coalesce("{c}", 'Missing') AS "{c}" """ for c in P.SEASONS))
    ),
)
def fill_missing_category(spark, sf_dir):
    return derive.fill_missing_category(subjects(spark, sf_dir), P.SEASONS).select("id", *[col(c) for c in P.SEASONS])


# Codes fitted on the subjects under 15; of the segments one is then unknown to the fit.
_SEG = """SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_nationkey = 3 THEN NULL ELSE
  CAST(c_nationkey AS VARCHAR) END AS nation FROM customer"""


@query(
    "ordinal_encode",
    f"""WITH r AS ({_SEG}), f AS (SELECT * FROM r WHERE segment <> 'HOUSEHOLD')
    SELECT id, CAST(coalesce(s.code, -1) AS DOUBLE) AS segment, CAST(coalesce(n.code, -1) AS DOUBLE) AS nation FROM r
    LEFT JOIN (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code FROM f GROUP BY segment) s
      ON r.segment = s.segment
    LEFT JOIN (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS code FROM f WHERE nation IS NOT NULL
      GROUP BY nation) n ON r.nation = n.nation""",
)
def ordinal_encode(spark, sf_dir):
    nation = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), nation.alias("nation")
    )
    codes = derive.fit_ordinal(rows.filter(F.col("segment") != "HOUSEHOLD"), ["segment", "nation"])
    return codes.transform(rows)


SEED = 11
_NOISE = float(np.random.default_rng(SEED).standard_normal())
_WAIST = f'coalesce("{P.WAIST}", "{P.WAIST_SOURCE}" * {P.WAIST_FACTOR}::DOUBLE + {_NOISE!r}::DOUBLE)'


@query(
    "impute_linear_noise",
    tidy_sql(over_subjects(f"SELECT id, {_WAIST} AS waist FROM subjects", ["id", P.WAIST, P.WAIST_SOURCE]), ["waist"]),
)
def impute_linear_noise(spark, sf_dir):
    out = derive.impute_linear_noise(subjects(spark, sf_dir), P.WAIST, P.WAIST_SOURCE, P.WAIST_FACTOR, SEED)
    return tidy(out.select("id", col(P.WAIST).alias("waist")))


# --- feature engineering as a whole -----------------------------------------------------------

_GROUP_COLS = [c for c in ALL if c.startswith("FGC") and not c.endswith(("Season", "Zone"))] + [
    c for c in BIA if not c.endswith(("Season", "Activity_Level_num", "Frame_num"))
]
_GROUP_KEYS = names(P.GROUP_KEYS)
_EXTRA = [
    P.WAIST_MISSING, *P.PRODUCTS, *P.RATIOS, "PAQ_Total",
]
_FEATURES = [c for c in ALL if c not in {*P.EXCLUDED_FEATURES, "id"}] + BASIC_NAMES
_FEATURES += [f"t{c}" for c in _GROUP_COLS] + _EXTRA
_FLOATS = [
    c for c in _FEATURES
    if c != P.WAIST_MISSING and (c not in subject_columns() or c in P.SEASONS or "DOUBLE" in subject_columns()[c])
]
_BINNED = """SELECT *, floor("Physical-Weight" / 10) AS neww, floor("Physical-Height" / 6) AS newh FROM merged"""


def _filled(c: str) -> str:
    return f"""coalesce("{c}", 'Missing')"""


def _derived_sql(z: str, season: dict[str, str]) -> str:
    return f"""SELECT * REPLACE (
      CAST(floor("CGAS-CGAS_Score" / 5.0) AS BIGINT) AS "CGAS-CGAS_Score",
      {", ".join(f'{season[c]} AS "{c}"' for c in P.SEASONS)},
      {_WAIST} AS "{P.WAIST}"),
      "{P.WAIST}" IS NULL AS {P.WAIST_MISSING}, {_PRODUCTS}, {_RATIOS}, {_PAQ} AS "PAQ_Total"
      FROM ({z})"""


_TRAIN_Z = f"""SELECT *, {", ".join(
    f'("{c}" - avg("{c}") OVER g) / (coalesce(stddev_samp("{c}") OVER g, 1.0) + 1e-7::DOUBLE) AS "t{c}"' for c in _GROUP_COLS
)} FROM ({_BINNED}) WINDOW g AS (PARTITION BY {_GROUP_KEYS})"""
_TRAIN_CODES = {c: f"CAST(dense_rank() OVER (ORDER BY {_filled(c)}) - 1 AS DOUBLE)" for c in P.SEASONS}
_TRAIN_MERGED = f"merged AS (SELECT c.*, b.* EXCLUDE (id) FROM ({CLEANED_SQL}) c LEFT JOIN ({BASIC_SQL}) b ON c.id = b.id)"
_TRAIN_SQL = f"""SELECT id, {names(_FEATURES)} FROM
  ({_derived_sql(f"SELECT * FROM ({_TRAIN_Z}) WHERE sii IS NOT NULL", _TRAIN_CODES)})"""


def _merged_train(spark, sf_dir):
    s = series(spark, sf_dir)
    merged = merge_series_features(
        clean_train(subjects(spark, sf_dir), s), series_basic_stats(s, ["X", "enmo", "light"])
    )
    # Written, since fitting reads it for the group statistics and for the rows.
    return materialize(merged, "merged")


def _comparable(df):
    return tidy(df.withColumns({c: col(c).cast("double") for c in P.PRODUCTS}), 5)


@query("feature_engineering", tidy_sql(over_both(_TRAIN_SQL).replace("\nSELECT id,", f", {_TRAIN_MERGED}\nSELECT id,", 1), _FLOATS, 5))
def feature_engineering_query(spark, sf_dir):
    out, features, _ = feature_engineering(_merged_train(spark, sf_dir), seed=SEED)
    return _comparable(out.select("id", *[col(c) for c in features]))


_SCORE_STATS = f"""stats AS (SELECT {_GROUP_KEYS}, {", ".join(
    f'avg("{c}") AS "m{c}", coalesce(stddev_samp("{c}"), 1.0) AS "s{c}"' for c in _GROUP_COLS
)} FROM ({_BINNED}) GROUP BY {_GROUP_KEYS})"""
_SCORE_SUBJECTS = f"""scored AS (SELECT s.* REPLACE (
  {", ".join(f'NULLIF(s."{c}", 0) AS "{c}"' for c in P.ZERO_MEANS_MISSING)}), b.* EXCLUDE (id)
  FROM subjects s LEFT JOIN ({BASIC_SQL}) b ON s.id = b.id)"""
_SCORE_Z = f"""SELECT r.*, {", ".join(f'(r."{c}" - m."m{c}") / (m."s{c}" + 1e-7::DOUBLE) AS "t{c}"' for c in _GROUP_COLS)}
  FROM ({_BINNED.replace("FROM merged", "FROM scored")}) r
  LEFT JOIN stats m ON {" AND ".join(f'r."{k}" = m."{k}"' for k in P.GROUP_KEYS)}"""


def _score_code(c: str) -> str:
    known = f"SELECT DISTINCT {_filled(c)} AS s FROM merged WHERE sii IS NOT NULL"
    return f"""CASE WHEN {_filled(c)} IN ({known})
      THEN CAST((SELECT count(*) FROM ({known}) k WHERE k.s < {_filled(c)}) AS DOUBLE) ELSE -1.0 END"""


_SCORE_SQL = f"""SELECT id, {names(_FEATURES)} FROM
  ({_derived_sql(_SCORE_Z, {c: _score_code(c) for c in P.SEASONS})})"""


@query(
    "feature_engineering_score",
    tidy_sql(
        over_both(_SCORE_SQL).replace(
            "\nSELECT id,", f", {_TRAIN_MERGED}, {_SCORE_STATS}, {_SCORE_SUBJECTS}\nSELECT id,", 1
        ),
        _FLOATS,
        5,
    ),
)
def feature_engineering_score(spark, sf_dir):
    model, _ = FeatureEngineering(SEED).fit_transform(_merged_train(spark, sf_dir))
    s = series(spark, sf_dir)
    scored = merge_series_features(clean_test(subjects(spark, sf_dir)), series_basic_stats(s, ["X", "enmo", "light"]))
    return _comparable(model.aligned(scored))


# --- profiles -------------------------------------------------------------------------------


@query(
    "crosstab_counts",
    'SELECT o_orderstatus, o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1, 2',
)
def crosstab_counts(spark, sf_dir):
    return profile.crosstab_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "share_within_group",
    tidy_sql(
        """SELECT o_orderstatus, o_orderpriority, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS "count"
        FROM orders GROUP BY 1, 2""",
        ["count"],
        9,
    ),
)
def share_within_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return tidy(profile.crosstab_counts(orders, "o_orderstatus", "o_orderpriority", normalize_over_x=True), 9)


@query(
    "value_shares",
    tidy_sql(
        'SELECT lang, count(*) AS "count", count(*) / sum(count(*)) OVER () AS percentage FROM documents GROUP BY lang',
        ["percentage"],
        9,
    ),
)
def value_shares(spark, sf_dir):
    return tidy(profile.value_shares(table(spark, sf_dir, "documents"), "lang"), 9)


@query("value_counts", 'SELECT event_type, count(*) AS "count" FROM events GROUP BY 1')
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "value_range",
    'SELECT min(n) AS lowest, max(n) AS highest FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)',
)
def value_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profile.value_range(profile.crosstab_counts(orders, "o_orderstatus", "o_orderpriority"))


@query(
    "histogram",
    'SELECT floor((value - 0.0) / 25) * 25.0 + 0.0 AS bin_start, count(*) AS "count" FROM events GROUP BY 1',
)
def histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "value", 25)


_BANDWIDTH = """SELECT event_type, 1.06::DOUBLE * coalesce(nullif(least(sd, (q3 - q1) / 1.34::DOUBLE), 0), nullif(sd, 0),
  nullif(abs(q1), 0), 1) * pow(n, -0.2::DOUBLE) AS h FROM (
  SELECT event_type, count(value) AS n, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"""


@query(
    "kde_density",
    tidy_sql(
        f"""SELECT event_type, g.at AS "value",
        sum(exp(-(((g.at - e.value) / h) * ((g.at - e.value) / h)) / 2) / (2.5066282746310002::DOUBLE * h)) / count(*)
          AS density
        FROM events e JOIN ({_BANDWIDTH}) b USING (event_type), (SELECT i * 12.5::DOUBLE AS at FROM range(41) r(i)) g
        GROUP BY 1, 2""",
        ["value", "density"],
        10,
    ),
)
def kde_density(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tidy(profile.kde_density(events, "value", 0, 500, steps=40, group="event_type"), 10)


_WHOLE_BANDWIDTH = _BANDWIDTH.replace("event_type, ", "", 1).replace("SELECT event_type, count", "SELECT count").replace(
    " FROM events GROUP BY 1", " FROM events"
)


@query(
    "kde_density_whole",
    tidy_sql(
        f"""SELECT g.at AS "value",
        sum(exp(-(((g.at - e.value) / h) * ((g.at - e.value) / h)) / 2) / (2.5066282746310002::DOUBLE * h)) / count(*)
          AS density
        FROM events e, ({_WHOLE_BANDWIDTH}) b, (SELECT low + i * ((high - low) / 20) AS at FROM range(21) r(i),
          (SELECT min(value) AS low, max(value) AS high FROM events)) g
        GROUP BY 1""",
        ["value", "density"],
        10,
    ),
)
def kde_density_whole(spark, sf_dir):
    """All event types together, over the range of the values."""
    return tidy(profile.kde_density(table(spark, sf_dir, "events"), "value", steps=20), 10)


_WHOLE_GRID = """(SELECT low + i * ((high - low) / 20) AS at FROM range(21) r(i),
          (SELECT min(value) AS low, max(value) AS high FROM events)) g"""
# The published approximation of the normal distribution function, as the operator has it.
_POLY = "({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
_UPPER = "exp(-z * z / 2) / 2.5066282746310002::DOUBLE * " + _POLY.format(t="(1 / (1 + 0.2316419::DOUBLE * abs(z)))")


@query(
    "kde_density_cumulative",
    tidy_sql(
        f"""SELECT "value", avg(CASE WHEN z >= 0 THEN 1 - {_UPPER} ELSE {_UPPER} END) AS density FROM (
        SELECT g.at AS "value", (g.at - e.value) / h AS z FROM events e, ({_WHOLE_BANDWIDTH}) b, {_WHOLE_GRID})
        GROUP BY 1""",
        ["value", "density"],
        8,
    ),
)
def kde_density_cumulative(spark, sf_dir):
    return tidy(profile.kde_density(table(spark, sf_dir, "events"), "value", steps=20, cumulative=True), 8)


# --- readings that are not numbers, and a group without a name ---------------------------

_HOLES_SQL = """(SELECT CASE WHEN event_type = 'error' THEN '~' ELSE event_type END AS event_type, value
  FROM events WHERE event_id % 5 <> 0)"""


def _with_holes(spark, sf_dir):
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf_dir, "events").select(kind.alias("event_type"), value.alias("value"))


@query(
    "histogram_nan",
    f"""SELECT floor((value - 0.0) / 25) * 25.0 + 0.0 AS bin_start, count(*) AS "count" FROM {_HOLES_SQL} GROUP BY 1""",
)
def histogram_nan(spark, sf_dir):
    return profile.histogram(_with_holes(spark, sf_dir), "value", 25)


@query(
    "kde_density_null_group",
    tidy_sql(
        f"""SELECT nullif(event_type, '~') AS event_type, g.at AS "value",
        sum(exp(-(((g.at - e.value) / h) * ((g.at - e.value) / h)) / 2) / (2.5066282746310002::DOUBLE * h)) / count(*)
          AS density
        FROM {_HOLES_SQL} e JOIN ({_BANDWIDTH.replace("FROM events", f"FROM {_HOLES_SQL}")}) b USING (event_type),
          (SELECT i * 12.5::DOUBLE AS at FROM range(41) r(i)) g
        GROUP BY 1, 2""",
        ["value", "density"],
        10,
    ),
)
def kde_density_null_group(spark, sf_dir):
    return tidy(profile.kde_density(_with_holes(spark, sf_dir), "value", 0, 500, steps=40, group="event_type"), 10)


_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query(
    "box_stats",
    tidy_sql(
        """WITH v AS (SELECT l_returnflag, l_extendedprice * l_quantity * l_quantity AS x FROM lineitem),
        q AS (SELECT l_returnflag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
          quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
        SELECT l_returnflag, q1, median, q3,
          min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM v JOIN q USING (l_returnflag) GROUP BY 1, 2, 3, 4""",
        _BOX,
        3,
    ),
)
def box_stats(spark, sf_dir):
    x = F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x"))
    return tidy(profile.box_stats(rows, "x", "l_returnflag"), 3)


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_SQL = """SELECT l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax FROM lineitem"""


def _correlated(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_linenumber") != 7, F.col("l_tax"))
    ).select(*_CORR)


def _pairs_sql(one) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, {one(a, b)}" for a in _CORR for b in _CORR
    )


@query("pairwise_corr", tidy_sql(_pairs_sql(lambda a, b: f"corr({a}, {b}) AS value FROM ({_CORR_SQL})"), ["value"], 8))
def pairwise_corr(spark, sf_dir):
    return tidy(profile.pairwise_corr(_correlated(spark, sf_dir), _CORR), 8)


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "pairwise_corr_spearman",
    tidy_sql(
        _pairs_sql(
            lambda a, b: f"""corr(x, y) AS value FROM (SELECT {_rank_sql(a)} AS x, {_rank_sql(b)} AS y
            FROM ({_CORR_SQL}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        ),
        ["value"],
        8,
    ),
)
def pairwise_corr_spearman(spark, sf_dir):
    return tidy(profile.pairwise_corr(_correlated(spark, sf_dir), _CORR, "spearman"), 8)


@query(
    "box_stats_nan",
    tidy_sql(
        """WITH v AS (SELECT l_returnflag, l_extendedprice AS x FROM lineitem WHERE l_linenumber <> 2),
        q AS (SELECT l_returnflag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
          quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
        SELECT l_returnflag, q1, median, q3,
          min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
          max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
          count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM v JOIN q USING (l_returnflag) GROUP BY 1, 2, 3, 4""",
        _BOX,
        3,
    ),
)
def box_stats_nan(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return tidy(profile.box_stats(table(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x")), "x", "l_returnflag"), 3)


def _correlated_nan(spark, sf_dir):
    tax = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").withColumn("l_tax", tax).select(*_CORR)


@query(
    "pairwise_corr_nan",
    tidy_sql(_pairs_sql(lambda a, b: f"corr({a}, {b}) AS value FROM ({_CORR_SQL})"), ["value"], 8),
)
def pairwise_corr_nan(spark, sf_dir):
    """Readings that are not numbers count as missing ones."""
    return tidy(profile.pairwise_corr(_correlated_nan(spark, sf_dir), _CORR), 8)
