"""Sensor series: per-sample features and per-subject statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import LAYOUT, series, subjects
from checks.registry import names, nearest_sql, over_both, over_series, query, tidy, tidy_sql
from kinecohort.functions.columns import col
from kinecohort.operators import series as S
from kinecohort.operators.quantiles import quantiles
from kinecohort.plans.prepare import merge_series_features

DATE = "relative_date_PCIAT"
W = LAYOUT.window
_DAY = f'"{DATE}" + time_of_day / 86400e9::DOUBLE'
_SECONDS = f'"{DATE}" * 86400 + time_of_day / 1e9::DOUBLE'

# Samples with every per-sample feature.
SAMPLES = f"""SELECT *, {_DAY} AS day, round(time_of_day / 3600e9::DOUBLE, 2) AS hour, abs(anglez) AS anglez_abs,
  coalesce({_SECONDS} - lag({_SECONDS}) OVER (PARTITION BY id ORDER BY step), 5.0) AS time_diff,
  coalesce(CASE WHEN count(anglez) OVER recent >= {W} THEN stddev_samp(abs(anglez)) OVER recent END, 0.0)
    AS rolling_std_anglez
FROM series WINDOW recent AS (PARTITION BY id ORDER BY step ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"""


def _sample_sql(column: str, digits: int = 6) -> str:
    return tidy_sql(over_series(f"SELECT id, step, {column} FROM ({SAMPLES})"), [column], digits)


@query("elapsed_day", _sample_sql("day", 9))
def elapsed_day(spark, sf_dir):
    return tidy(series(spark, sf_dir).select("id", "step", S.elapsed_day(LAYOUT).alias("day")), 9)


@query("time_gap", _sample_sql("time_diff", 6))
def time_gap(spark, sf_dir):
    s = series(spark, sf_dir).select("id", "step", DATE, "time_of_day")
    return tidy(S.time_gap(s, LAYOUT).select("id", "step", "time_diff"), 6)


@query("hour_of_day", _sample_sql("hour", 2))
def hour_of_day(spark, sf_dir):
    return tidy(series(spark, sf_dir).select("id", "step", S.hour_of_day(LAYOUT).alias("hour")), 2)


@query("abs_angle", _sample_sql("anglez_abs"))
def abs_angle(spark, sf_dir):
    return tidy(series(spark, sf_dir).select("id", "step", S.abs_angle(LAYOUT).alias("anglez_abs")))


@query("rolling_std", _sample_sql("rolling_std_anglez"))
def rolling_std(spark, sf_dir):
    s = series(spark, sf_dir).select("id", "step", "anglez")
    return tidy(S.rolling_std(s, S.abs_angle(LAYOUT), "rolling_std_anglez", LAYOUT).drop("anglez"))


# --- statistics ---------------------------------------------------------------------

_BASIC = ["X", "enmo", "light"]
_FUNCS = {"min": "min", "mean": "avg", "max": "max", "std": "stddev_samp"}
BASIC_NAMES = [f"{c}_{s}" for s in _FUNCS for c in _BASIC]
BASIC_SQL = "SELECT id, {} FROM series GROUP BY id".format(
    ", ".join(f'CAST({f}(CAST("{c}" AS REAL)) AS REAL) AS "{c}_{s}"' for s, f in _FUNCS.items() for c in _BASIC)
)


@query("series_basic_stats", tidy_sql(over_series(BASIC_SQL), BASIC_NAMES))
def series_basic_stats(spark, sf_dir):
    return tidy(S.series_basic_stats(series(spark, sf_dir), _BASIC))


DAILY = f"""SELECT id, "{DATE}", avg(enmo) AS daily_avg_enmo, avg(light) AS daily_avg_light
FROM series GROUP BY id, "{DATE}" """


@query("daily_average", tidy_sql(over_series(DAILY), ["daily_avg_enmo", "daily_avg_light"]))
def daily_average(spark, sf_dir):
    return tidy(S.daily_average(series(spark, sf_dir), layout=LAYOUT))


def _levels(stats, prefix: str) -> tuple[str, list[str]]:
    parts = [(f"{_FUNCS[s]}(daily_avg_{c})", f"{prefix}_{c}_{s}") for c, wanted in stats.items() for s in wanted]
    return ", ".join(f'{e} AS "{n}"' for e, n in parts), [n for _, n in parts]


_V2, _V2_NAMES = _levels(S.DAILY_V2, "daily_avg")
_V3, _V3_NAMES = _levels(S.DAILY_V3, "daily_avg")
_F7, _F7_NAMES = _levels(S.DAILY_V2, "first7_avg")


@query(
    "daily_average_summary", tidy_sql(over_series(f"SELECT id, {_V2} FROM ({DAILY}) GROUP BY id"), _V2_NAMES)
)
def daily_average_summary(spark, sf_dir):
    daily = S.daily_average(series(spark, sf_dir), layout=LAYOUT)
    return tidy(S.daily_average_summary(daily, S.DAILY_V2))


FIRST_WEEK = f"""SELECT id, {_F7} FROM (
  SELECT e.id, e."{DATE}", avg(enmo) AS daily_avg_enmo, avg(light) AS daily_avg_light
  FROM series e JOIN (SELECT id, min({_DAY}) AS first_day FROM series GROUP BY id) f ON e.id = f.id
  WHERE {_DAY} - first_day < 7 GROUP BY e.id, e."{DATE}") GROUP BY id"""
_FIRST_GLOBAL = f"""SELECT id, {_F7} FROM (
  SELECT id, "{DATE}", avg(enmo) AS daily_avg_enmo, avg(light) AS daily_avg_light FROM series
  WHERE {_DAY} - (SELECT min({_DAY}) FROM series) < 7 GROUP BY id, "{DATE}") GROUP BY id"""


@query("first_n_days_summary", tidy_sql(over_series(FIRST_WEEK), _F7_NAMES, 9))
def first_n_days_summary(spark, sf_dir):
    return tidy(S.first_n_days_summary(series(spark, sf_dir), 7, S.DAILY_V2, LAYOUT), 9)


@query("first_n_days_summary_global", tidy_sql(over_series(_FIRST_GLOBAL), _F7_NAMES, 9))
def first_n_days_summary_global(spark, sf_dir):
    return tidy(S.first_n_days_summary(series(spark, sf_dir), 7, S.DAILY_V2, LAYOUT, scope="global"), 9)


@query(
    "series_span",
    over_series(
        f"""SELECT id, min("{DATE}") AS "relative_start_date_PCIAT", max("{DATE}") - min("{DATE}") AS total_days
        FROM series GROUP BY id"""
    ),
)
def series_span(spark, sf_dir):
    return S.series_span(series(spark, sf_dir), LAYOUT)


_V2_BASE = {
    "relative_start_date_PCIAT": f'min("{DATE}")',
    "total_days": f'max("{DATE}") - min("{DATE}")',
    "rolling_std_anglez_abs_std": "stddev_samp(rolling_std_anglez)",
    **{
        f"{n}_{s}": f'{f}("{c}")'
        for c, n in (("X", "X"), ("Y", "Y"), ("anglez", "angleZ"))
        for s, f in (("mean", "avg"), ("std", "stddev_samp"))
    },
}
_V2_ALL = [*_V2_BASE, *_V2_NAMES, *_F7_NAMES]


@query(
    "series_features_v2",
    tidy_sql(
        over_series(
            f"""SELECT b.id, {", ".join(f'CAST("{n}" AS REAL) AS "{n}"' for n in _V2_ALL)}
            FROM (SELECT id, {", ".join(f'{e} AS "{n}"' for n, e in _V2_BASE.items())} FROM ({SAMPLES}) GROUP BY id) b
            LEFT JOIN (SELECT id, {_V2} FROM ({DAILY}) GROUP BY id) d ON b.id = d.id
            LEFT JOIN ({FIRST_WEEK}) f ON b.id = f.id"""
        ),
        _V2_ALL,
    ),
)
def series_features_v2(spark, sf_dir):
    return tidy(S.series_features_v2(series(spark, sf_dir), LAYOUT))


_QUANTILED = ["X", "enmo", "light"]
_QUANTILES = ", ".join(
    f'{nearest_sql(c, q)} AS "{c}_q{int(q * 100)}"' for c in _QUANTILED for q in S.QUARTILES
)
_QUANTILE_NAMES = [f"{c}_q{int(q * 100)}" for c in _QUANTILED for q in S.QUARTILES]


@query(
    "quantiles_nearest", tidy_sql(over_series(f"SELECT id, {_QUANTILES} FROM series GROUP BY id"), _QUANTILE_NAMES)
)
def quantiles_nearest(spark, sf_dir):
    return tidy(quantiles(series(spark, sf_dir), ["id"], _QUANTILED))


@query(
    "quantiles_nearest_large_groups",
    tidy_sql(over_series(f"SELECT weekday, {_QUANTILES} FROM series GROUP BY weekday"), _QUANTILE_NAMES),
)
def quantiles_nearest_large_groups(spark, sf_dir):
    """The same by narrowing, as for groups too large to sort in one task."""
    return tidy(quantiles(series(spark, sf_dir), ["weekday"], _QUANTILED, small_rows=100))


_SEVEN = ["X", "Y", "Z", "enmo", "light", "rolling_std_anglez", DATE, "time_of_day"]
_V3_BASE = {
    "non-wear_flag_mean": 'avg("non-wear_flag")',
    "non-wear_flag_std": 'stddev_samp("non-wear_flag")',
    "quarter_mean": "avg(quarter)",
    "weekday_mean": "avg(weekday)",
    "weekday_std": "stddev_samp(weekday)",
    "day_mean": "avg(day)",
    "day_std": "stddev_samp(day)",
    "time_diff_max": "max(time_diff)",
}
for _c in _SEVEN:
    _V3_BASE |= {f"{_c}_{s}": f'{f}("{_c}")' for s, f in _FUNCS.items()}
    _V3_BASE |= {f"{_c}_q{int(q * 100)}": nearest_sql(_c, q) for q in S.QUARTILES}
V3_NAMES = [*_V3_BASE, *_V3_NAMES]
# Nanoseconds and seconds are compared in hours and days: 32-bit values have seven digits.
_SCALE = {**{n: 3.6e12 for n in V3_NAMES if n.startswith("time_of_day")}, "time_diff_max": 86400.0}
V3_SQL = f"""SELECT b.id, {", ".join(f'CAST("{n}" AS REAL) AS "{n}"' for n in V3_NAMES)}
FROM (SELECT id, {", ".join(f'{e} AS "{n}"' for n, e in _V3_BASE.items())} FROM ({SAMPLES}) GROUP BY id) b
LEFT JOIN (SELECT id, {_V3} FROM ({DAILY}) GROUP BY id) d ON b.id = d.id
WHERE "{DATE}_max" - "{DATE}_min" > 0"""


@query(
    "series_features_v3",
    tidy_sql(
        over_series(
            "SELECT * REPLACE ({}) FROM ({})".format(
                ", ".join(f'CAST("{n}" AS DOUBLE) / {s} AS "{n}"' for n, s in _SCALE.items()), V3_SQL
            )
        ),
        V3_NAMES,
    ),
)
def series_features_v3(spark, sf_dir):
    out = S.series_features_v3(series(spark, sf_dir), LAYOUT)
    return tidy(out.withColumns({n: col(n).cast("double") / s for n, s in _SCALE.items()}))


# Series cut by hour of the day, so that many of them lie within one day.
_HOURLY = "id || '-' || CAST(CAST(floor(time_of_day / 3600e9::DOUBLE) AS BIGINT) AS VARCHAR)"


@query(
    "drop_single_day_series",
    over_series(
        f"""SELECT * FROM (SELECT {_HOURLY} AS id, min("{DATE}") AS first, max("{DATE}") AS last
        FROM series GROUP BY 1) WHERE last - first > 0"""
    ),
)
def drop_single_day_series(spark, sf_dir):
    hour = F.floor(F.col("time_of_day") / F.lit(3600e9)).cast("string")
    hourly = series(spark, sf_dir).withColumn("id", F.concat("id", F.lit("-"), hour))
    span = hourly.groupBy("id").agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    return S.drop_single_day_series(span, "first", "last")


_DESCRIBED = ["enmo", "light", "weekday"]
_DESCRIBE = {
    "count": 'CAST(count("{c}") AS DOUBLE)',
    "null_count": 'CAST(count(*) - count("{c}") AS DOUBLE)',
    "mean": 'avg("{c}")',
    "std": 'stddev_samp("{c}")',
    "min": 'CAST(min("{c}") AS DOUBLE)',
    "q25": 0.25,
    "q50": 0.5,
    "q75": 0.75,
    "max": 'CAST(max("{c}") AS DOUBLE)',
}
_CELLS = [
    nearest_sql(c, e) if isinstance(e, float) else e.format(c=c) for e in _DESCRIBE.values() for c in _DESCRIBED
]
_STAT_NAMES = [f"stat_{i}" for i in range(len(_CELLS))]


@query(
    "describe_vector",
    tidy_sql(
        over_series(
            "SELECT id, {} FROM series GROUP BY id".format(", ".join(f"{e} AS stat_{i}" for i, e in enumerate(_CELLS)))
        ),
        _STAT_NAMES,
    ),
)
def describe_vector(spark, sf_dir):
    return tidy(S.describe_vector(series(spark, sf_dir), _DESCRIBED))


# --- joins ------------------------------------------------------------------------------


@query(
    "merge_series_features",
    tidy_sql(
        over_both(
            f"""SELECT subjects.id, "Basic_Demos-Age", {names(BASIC_NAMES)}
            FROM subjects LEFT JOIN ({BASIC_SQL}) s ON subjects.id = s.id""",
            ["id", "Basic_Demos-Age"],
        ),
        BASIC_NAMES,
    ),
)
def merge_series_features_query(spark, sf_dir):
    features = S.series_basic_stats(series(spark, sf_dir), _BASIC)
    people = subjects(spark, sf_dir, ["id", "Basic_Demos-Age"])
    return tidy(merge_series_features(people, features))


@query(
    "join_aggregate_levels",
    tidy_sql(
        over_series(
            f"""SELECT b.*, d.* EXCLUDE (id) FROM ({BASIC_SQL}) b
            LEFT JOIN (SELECT id, {_V3} FROM ({DAILY}) GROUP BY id) d ON b.id = d.id"""
        ),
        [*BASIC_NAMES, *_V3_NAMES],
    ),
)
def join_aggregate_levels(spark, sf_dir):
    s = series(spark, sf_dir)
    daily = S.daily_average_summary(S.daily_average(s, layout=LAYOUT))
    return tidy(S.join_aggregate_levels(S.series_basic_stats(s, _BASIC), daily))
