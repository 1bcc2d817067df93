"""Sensor series: per-sample expressions, ordered features and per-subject statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinecohort.functions.columns import as_f32, cast_numeric_f32, col, nan_to_null
from kinecohort.operators.order import BLOCK, BLOCK_ROWS, HALO, POSITION, blocks, in_block_window
from kinecohort.operators.quantiles import quantile_name, quantiles
from kinecohort.operators.skew import HOT_ROWS, lookup_join
from kinecohort.sources.shared import materialize

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class SeriesLayout:
    """Names of the columns of a series table.

    ``order`` must be unique within a subject: it stands for the sampling order.
    """

    id: str = "id"
    order: tuple[str, ...] = ("step",)
    date: str = "relative_date_PCIAT"
    time_of_day: str = "time_of_day"
    angle: str = "anglez"
    window: int = 725
    block_rows: int = BLOCK_ROWS

    @property
    def sort_key(self) -> list[str]:
        return [self.id, *self.order]


LAYOUT = SeriesLayout()


def nan_values_to_null(df: DataFrame) -> DataFrame:
    """NaN readings become null, so that min, max and counts ignore them."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[nan_to_null(col(c)).alias(c) if c in floating else col(c) for c in df.columns]
    )


# --- per-sample expressions -------------------------------------------------


def elapsed_day(layout: SeriesLayout = LAYOUT) -> Column:
    """Fractional day: day offset plus the share of the day gone (time in nanoseconds)."""
    return col(layout.date) + col(layout.time_of_day) / F.lit(86400e9)


def elapsed_seconds(layout: SeriesLayout = LAYOUT) -> Column:
    return col(layout.date) * 86400 + col(layout.time_of_day) / F.lit(1e9)


def hour_of_day(layout: SeriesLayout = LAYOUT) -> Column:
    return F.round(col(layout.time_of_day) / F.lit(3600e9), 2)


def abs_angle(layout: SeriesLayout = LAYOUT) -> Column:
    return F.abs(col(layout.angle))


# --- features that need the order of the samples ----------------------------


def _gap(blocked: DataFrame, layout: SeriesLayout, first_gap: float) -> DataFrame:
    seconds = elapsed_seconds(layout)
    gap = seconds - F.lag(seconds).over(in_block_window([layout.id]))
    return blocked.withColumn("time_diff", F.coalesce(gap, F.lit(float(first_gap))))


def _rolling(blocked: DataFrame, value: Column, layout: SeriesLayout, name: str) -> DataFrame:
    """Trailing standard deviation without a sliding frame.

    Positions are cut into chunks as long as the window. A window is then the tail of one
    chunk and the head of the next; both grow one row at a time, and the two parts are
    merged by their counts, means and squared deviations. Work per row is constant and
    nothing is subtracted from a long running total, so flat stretches stay exact.
    """
    w = layout.window
    chunk = F.floor(F.col(POSITION) / F.lit(w))
    keys = [BLOCK, col(layout.id), "_chunk"]
    so_far = Window.partitionBy(*keys).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    to_come = (
        Window.partitionBy(*keys).orderBy(F.desc(POSITION)).rowsBetween(Window.unboundedPreceding, 0)
    )

    def part(over) -> Column:
        return F.struct(
            F.count("_x").over(over).alias("n"),
            F.coalesce(F.avg("_x").over(over), F.lit(0.0)).alias("m"),
            F.coalesce(F.var_pop("_x").over(over) * F.count("_x").over(over), F.lit(0.0)).alias("s"),
        )

    parts = (
        blocked.withColumn("_x", nan_to_null(value.cast("double")))
        .withColumn("_chunk", chunk)
        .withColumn("_tail", part(to_come))
        .withColumn("_head", part(so_far))
    )
    earlier = F.lag("_tail", w - 1).over(in_block_window([layout.id]))
    last_of_chunk = F.col(POSITION) % w == w - 1
    parts = parts.withColumn("_old", F.when(~last_of_chunk, earlier))
    n_old = F.coalesce(F.col("_old.n"), F.lit(0))
    n = n_old + F.col("_head.n")
    shift = F.coalesce(F.col("_old.m"), F.lit(0.0)) - F.col("_head.m")
    squares = (
        F.col("_head.s")
        + F.coalesce(F.col("_old.s"), F.lit(0.0))
        + shift * shift * n_old * F.col("_head.n") / F.nullif(n, F.lit(0))
    )
    full = F.when(n >= w, F.sqrt(squares / F.lit(w - 1)))
    return parts.withColumn(name, F.coalesce(full, F.lit(0.0))).drop(
        "_x", "_chunk", "_tail", "_head", "_old"
    )


def _in_blocks(df: DataFrame, layout: SeriesLayout, halo: int) -> DataFrame:
    # Partitioned by block once; every window below clusters on block plus more.
    return blocks(df, layout.sort_key, halo, layout.block_rows).repartition(BLOCK)


def _whole(blocked: DataFrame) -> DataFrame:
    return blocked.filter(~F.col(HALO)).drop(POSITION, BLOCK, HALO)


def time_gap(df: DataFrame, layout: SeriesLayout = LAYOUT, first_gap: float = 5) -> DataFrame:
    """Add ``time_diff``: seconds since the previous sample; ``first_gap`` on the first."""
    return _whole(_gap(_in_blocks(df, layout, 1), layout, first_gap))


def rolling_std(
    df: DataFrame, value: Column, name: str = "rolling_std", layout: SeriesLayout = LAYOUT
) -> DataFrame:
    """Add the trailing standard deviation over ``layout.window`` samples, 0 until it is full."""
    if layout.window < 2:
        raise ValueError("the window needs at least two samples")
    return _whole(_rolling(_in_blocks(df, layout, layout.window - 1), value, layout, name))


def series_samples(df: DataFrame, layout: SeriesLayout = LAYOUT, first_gap: float = 5) -> DataFrame:
    """Every per-sample feature in one pass over the sorted series."""
    blocked = _in_blocks(nan_values_to_null(df), layout, layout.window - 1)
    blocked = _gap(blocked, layout, first_gap)
    blocked = blocked.withColumn(f"{layout.angle}_abs", abs_angle(layout))
    blocked = _rolling(blocked, col(f"{layout.angle}_abs"), layout, f"rolling_std_{layout.angle}")
    return (
        _whole(blocked).withColumn("day", elapsed_day(layout)).withColumn("hour", hour_of_day(layout))
    )


# --- per-subject statistics ---------------------------------------------------


def series_basic_stats(df: DataFrame, cols: Sequence[str], id: str = "id") -> DataFrame:
    """Min, mean, max and std per subject of columns cast to 32-bit float first."""
    stats = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp}
    return df.groupBy(col(id)).agg(
        *[
            f(nan_to_null(as_f32(col(c)))).cast("float").alias(f"{c}_{s}")
            for s, f in stats.items()
            for c in cols
        ]
    )


def daily_average(
    df: DataFrame, cols: Sequence[str] = ("enmo", "light"), layout: SeriesLayout = LAYOUT
) -> DataFrame:
    """Mean per subject and day as ``daily_avg_<col>``."""
    return df.groupBy(col(layout.id), col(layout.date)).agg(
        *[F.avg(nan_to_null(col(c).cast("double"))).alias(f"daily_avg_{c}") for c in cols]
    )


_AGGREGATES = {"min": F.min, "mean": F.avg, "std": F.stddev_samp, "max": F.max}
ALL_FOUR = ("min", "mean", "std", "max")
DAILY_V2 = {"enmo": ALL_FOUR, "light": ALL_FOUR}
DAILY_V3 = {"enmo": ALL_FOUR, "light": ("max",)}


def daily_average_summary(
    daily: DataFrame,
    stats: Mapping[str, Sequence[str]] = DAILY_V3,
    prefix: str = "daily_avg",
    id: str = "id",
) -> DataFrame:
    """Second level over ``daily_average``: statistics of the daily means per subject."""
    return daily.groupBy(col(id)).agg(
        *[
            _AGGREGATES[s](f"daily_avg_{c}").alias(f"{prefix}_{c}_{s}")
            for c, wanted in stats.items()
            for s in wanted
        ]
    )


def first_n_days_summary(
    df: DataFrame,
    n: float = 7,
    stats: Mapping[str, Sequence[str]] = DAILY_V2,
    layout: SeriesLayout = LAYOUT,
    scope: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Daily-average summary of the samples less than ``n`` days after the first one.

    The first day is that of the subject (``scope="id"``) or that of the whole table
    (``scope="global"``).
    """
    day = elapsed_day(layout)
    if scope == "global":
        early = df.filter(day - df.agg(F.min(day)).scalar() < n)
    elif scope == "id":
        starts = df.groupBy(col(layout.id)).agg(
            F.min(day).alias("_first_day"), F.count(F.lit(1)).alias("_w")
        )
        joined = lookup_join(
            df, starts, [layout.id], "_w", hot_rows=hot_rows, spread_by=[*layout.order, layout.time_of_day]
        )
        early = joined.filter(day - F.col("_first_day") < n)
    else:
        raise ValueError(f"unknown scope: {scope}")
    return daily_average_summary(
        daily_average(early, list(stats), layout), stats, f"first{n:g}_avg", layout.id
    )


def series_span(df: DataFrame, layout: SeriesLayout = LAYOUT) -> DataFrame:
    """First day offset and number of days between the first and the last."""
    date = col(layout.date)
    return df.groupBy(col(layout.id)).agg(
        F.min(date).alias("relative_start_date_PCIAT"),
        (F.max(date) - F.min(date)).alias("total_days"),
    )


def join_aggregate_levels(base: DataFrame, *levels: DataFrame, id: str = "id") -> DataFrame:
    """Left-join per-subject aggregates of other levels; both sides are unique per subject."""
    for level in levels:
        base = base.join(level, id, "left")
    return base


def drop_single_day_series(
    stats: DataFrame, first: str = "relative_date_PCIAT_min", last: str = "relative_date_PCIAT_max"
) -> DataFrame:
    """Keep the subjects whose samples span more than one day."""
    return stats.filter(col(last) - col(first) > 0)


def series_features_v2(df: DataFrame, layout: SeriesLayout = LAYOUT) -> DataFrame:
    """Span, spread and daily summaries (whole series and first week) per subject."""
    # Read three times below, so the ordered features are evaluated once.
    samples = materialize(series_samples(df, layout), "samples")
    date = col(layout.date)
    base = samples.groupBy(col(layout.id)).agg(
        F.min(date).alias("relative_start_date_PCIAT"),
        (F.max(date) - F.min(date)).alias("total_days"),
        F.stddev_samp(f"rolling_std_{layout.angle}").alias(f"rolling_std_{layout.angle}_abs_std"),
        *[
            f(c).alias(f"{name}_{s}")
            for c, name in (("X", "X"), ("Y", "Y"), (layout.angle, "angleZ"))
            for s, f in (("mean", F.avg), ("std", F.stddev_samp))
        ],
    )
    daily = daily_average_summary(daily_average(samples, layout=layout), DAILY_V2, id=layout.id)
    early = first_n_days_summary(samples, 7, DAILY_V2, layout)
    return cast_numeric_f32(join_aggregate_levels(base, daily, early, id=layout.id))


def series_features_v3(
    df: DataFrame,
    layout: SeriesLayout = LAYOUT,
    keep_single_day: bool = False,
    dotted_names: bool = False,
) -> DataFrame:
    """The 69 statistics per subject, 32-bit, of subjects with more than one day.

    Quantiles are named ``X_q25``; ``dotted_names`` gives ``X_0.25`` instead.
    """
    samples = materialize(series_samples(df, layout), "samples")
    seven = ["X", "Y", "Z", "enmo", "light", f"rolling_std_{layout.angle}", layout.date, layout.time_of_day]
    plain = [
        F.avg(col("non-wear_flag")).alias("non-wear_flag_mean"),
        F.stddev_samp(col("non-wear_flag")).alias("non-wear_flag_std"),
        F.avg("quarter").alias("quarter_mean"),
        F.avg("weekday").alias("weekday_mean"),
        F.stddev_samp("weekday").alias("weekday_std"),
        F.avg("day").alias("day_mean"),
        F.stddev_samp("day").alias("day_std"),
        F.max("time_diff").alias("time_diff_max"),
        *[
            f(col(c)).alias(f"{c}_{s}")
            for c in seven
            for s, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))
        ],
    ]
    base = quantiles(samples, [layout.id], seven, QUARTILES, extra=plain)
    daily = daily_average_summary(daily_average(samples, layout=layout), DAILY_V3, id=layout.id)
    out = cast_numeric_f32(join_aggregate_levels(base, daily, id=layout.id))
    if not keep_single_day:
        out = drop_single_day_series(out, f"{layout.date}_min", f"{layout.date}_max")
    if dotted_names:
        out = out.withColumnsRenamed({quantile_name(c, q): f"{c}_{q}" for c in seven for q in QUARTILES})
    return out


DESCRIBED = ("count", "null_count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_vector(df: DataFrame, cols: Sequence[str], id: str = "id") -> DataFrame:
    """Nine statistics of every column, flattened statistic by statistic into ``stat_i``."""
    plain = []
    for i, c in enumerate(cols):
        x = col(c)
        plain += [
            F.count(x).cast("double").alias(f"_{i}_count"),
            F.count_if(x.isNull()).cast("double").alias(f"_{i}_null_count"),
            F.avg(x).alias(f"_{i}_mean"),
            F.stddev_samp(x).alias(f"_{i}_std"),
            F.min(x).cast("double").alias(f"_{i}_min"),
            F.max(x).cast("double").alias(f"_{i}_max"),
        ]
    grouped = quantiles(df, [id], cols, QUARTILES, extra=plain)

    def cell(stat: str, i: int, c: str) -> Column:
        return col(f"{c}_{stat}") if stat in ("q25", "q50", "q75") else F.col(f"_{i}_{stat}")

    flat = [cell(s, i, c) for s in DESCRIBED for i, c in enumerate(cols)]
    return grouped.select(col(id), *[x.alias(f"stat_{k}") for k, x in enumerate(flat)])
