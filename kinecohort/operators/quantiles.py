"""Exact order statistics per key.

The built-in exact percentiles keep every distinct value of a group in one task, and the
approximate ones return another element. Here groups of a checked size are sorted as
arrays within the ordinary aggregation; larger ones are narrowed first: each pass counts
the values of the current interval in bins (counts combine map-side) and keeps the bin
that holds the wanted rank, until no interval holds more than LAST_VALUES values, or it
holds equal ones only. Bins are of equal width in one pass and of equal ratio in the next, so
that values over any range of magnitudes come apart. Both ways return the same elements.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, nan_to_null
from kinecohort.operators.skew import HOT_ROWS, lookup_join
from kinecohort.sources.shared import materialize

# Values of one group that may be sorted as arrays in one task (8 bytes each).
SMALL_GROUP_VALUES = 1_000_000
BINS = 1024
# Values of an interval that may be ordered in one task at the end.
LAST_VALUES = 100_000
# Far beyond what doubles can need; more would be a fault of this module.
MOST_PASSES = 500


def nearest_rank(n: Column, q: float) -> Column:
    """0-based rank of the element nearest to the quantile, halves upwards."""
    return F.floor(F.lit(float(q)) * (n - 1) + F.lit(0.5)).cast("long")


def quantile_name(name: str, q: float) -> str:
    return f"{name}_q{q * 100:g}"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key group, written since it is read more than once."""
    return materialize(df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_w")), "group-sizes")


def _wanted_ranks(n: Column, probs: Sequence[float], method: str) -> list[Column]:
    if method == "nearest":
        return [nearest_rank(n, q) for q in probs]
    if method == "linear":
        places = [F.lit(float(q)) * (n - 1) for q in probs]
        return [f(p).cast("long") for p in places for f in (F.floor, F.ceil)]
    raise ValueError(f"unknown method: {method}")


def _combine(found: list[Column], n: Column, probs: Sequence[float], method: str) -> list[Column]:
    if method == "nearest":
        return found
    out = []
    for i, q in enumerate(probs):
        low, high = found[2 * i], found[2 * i + 1]
        place = F.lit(float(q)) * (n - 1)
        out.append(low + (high - low) * (place - F.floor(place)))
    return out


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    method: str = "nearest",
    extra: Sequence[Column] = (),
    small_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Quantiles of ``cols`` per key as ``<col>_q25`` etc., NaN counting as null.

    ``extra`` are further aggregates to evaluate along (they share the shuffle when the
    groups are small). ``method`` is ``nearest`` (an element of the group) or ``linear``.
    """
    if small_rows is None:
        small_rows = SMALL_GROUP_VALUES // len(cols)
    sizes = group_sizes(df, keys)
    large = F.col("_w") > small_rows
    n_groups, n_large = sizes.agg(F.count(F.lit(1)), F.count_if(large)).first()
    if n_large == 0:
        return _by_sorted_arrays(df, keys, cols, probs, method, extra)
    if n_large == n_groups:
        return _large_groups(df, keys, cols, probs, method, extra, hot_rows)
    # Few groups are large, so the table of them is small next to the rows.
    flags = sizes.filter(large).withColumn("_large", F.lit(True))
    flagged = lookup_join(df, flags, keys, "_w", null_safe=True, hot_rows=hot_rows)
    of_small = flagged.filter(F.col("_large").isNull()).drop("_large")
    of_large = flagged.filter(F.col("_large")).drop("_large")
    return _by_sorted_arrays(of_small, keys, cols, probs, method, extra).unionByName(
        _large_groups(of_large, keys, cols, probs, method, extra, hot_rows)
    )


def _large_groups(df, keys, cols, probs, method, extra, hot_rows) -> DataFrame:
    picked = _by_narrowing(df, keys, cols, probs, method, hot_rows)
    rest = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"), *extra)
    same = [rest[f"`{k}`"].eqNullSafe(picked[f"`{k}`"]) for k in keys]
    values = [quantile_name(c, q) for c in cols for q in probs]
    return rest.join(picked, reduce(and_, same), "left").select(
        *[rest[f"`{c}`"] for c in rest.columns if c != "_rows"], *[col(v) for v in values]
    )


def _by_sorted_arrays(df, keys, cols, probs, method, extra) -> DataFrame:
    arrays = [
        F.sort_array(F.collect_list(nan_to_null(col(c).cast("double")))).alias(f"_sorted{i}")
        for i, c in enumerate(cols)
    ]
    grouped = df.groupBy(*[col(k) for k in keys]).agg(*extra, *arrays)
    out = []
    for i, c in enumerate(cols):
        values = F.col(f"_sorted{i}")
        n = F.size(values).cast("double")
        found = [
            F.when(F.size(values) > 0, F.get(values, r.cast("int")))
            for r in _wanted_ranks(n, probs, method)
        ]
        out += [
            v.alias(quantile_name(c, q)) for v, q in zip(_combine(found, n, probs, method), probs)
        ]
    kept = grouped.columns[: -len(cols)]
    return grouped.select(*[col(x) for x in kept], *out)


def largest_interval(state: DataFrame) -> int:
    """Values in the fullest interval of different values (what a task may have to order)."""
    each = state.select(F.explode("_ivs").alias("iv")).filter("iv.lo < iv.hi")
    return each.agg(F.max("iv.n")).first()[0] or 0


def _place(by_ratio: bool) -> Column:
    """Bin of v within lo .. hi, never falling as v grows; infinities have bins of their own.

    The lowest and the highest value are never in one bin, so every pass gets on.
    """
    v, most = F.col("v"), F.lit(1.7976931348623157e308)
    lo, hi = F.greatest(F.col("lo"), -most), F.least(F.col("hi"), most)
    if by_ratio:
        # Signs come apart first, then magnitudes.
        positive = (F.log(v) - F.log(lo)) / F.nullif(F.log(hi) - F.log(lo), F.lit(0.0))
        negative = (F.log(-lo) - F.log(-v)) / F.nullif(F.log(-lo) - F.log(-hi), F.lit(0.0))
        signs = F.when(v < 0, 0).when(v == 0, 1).otherwise(2).cast("double") / F.lit(float(BINS))
        part = F.when((lo <= 0) & (hi >= 0), signs).when(lo > 0, positive).otherwise(negative)
    else:
        # Halves, since the difference may be beyond all doubles.
        part = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    inner = F.least(F.greatest(F.floor(part * F.lit(float(BINS))), F.lit(0)), F.lit(BINS - 1)).cast("long")
    own = F.when(v == F.lit(float("-inf")), F.lit(-2)).when(v == F.lit(float("inf")), F.lit(BINS + 1))
    own = own.when(v <= lo, F.lit(-1)).when(v >= hi, F.lit(BINS))
    return own.otherwise(F.coalesce(inner, F.lit(0))).cast("long")


def _by_narrowing(df, keys, cols, probs, method, hot_rows, last_values: int | None = None) -> DataFrame:
    last_values = LAST_VALUES if last_values is None else last_values
    by = [col(k) for k in keys]
    values = [nan_to_null(col(c).cast("double")) for c in cols]
    rows = df.select(*by, F.array(*values).alias("_vals"))
    per_col = range(len(cols))
    bounds = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_w"),
        *[F.count(F.col("_vals")[i]).alias(f"_n{i}") for i in per_col],
        *[F.min(F.col("_vals")[i]).alias(f"_lo{i}") for i in per_col],
        *[F.max(F.col("_vals")[i]).alias(f"_hi{i}") for i in per_col],
    )
    bounds = materialize(bounds, "bounds")

    def first_interval(i: int) -> Column:
        ranks = _wanted_ranks(F.col(f"_n{i}").cast("double"), probs, method)
        wanted = [F.struct(F.lit(t).alias("t"), r.alias("r")) for t, r in enumerate(ranks)]
        return F.struct(
            F.lit(i).alias("c"),
            F.col(f"_lo{i}").alias("lo"),
            F.col(f"_hi{i}").alias("hi"),
            F.col(f"_n{i}").alias("n"),
            F.array(*wanted).alias("rs"),
        )

    intervals = F.array(*[first_interval(i) for i in per_col])
    state = bounds.select(
        *by, "_w", F.filter(intervals, lambda iv: iv["lo"].isNotNull()).alias("_ivs")
    )
    for i in range(MOST_PASSES):
        # Each state is written: the next pass must not repeat the scans of this one.
        state = materialize(state, "intervals")
        if largest_interval(state) <= last_values:
            break
        state = _narrow(rows, keys, state, hot_rows, by_ratio=i % 2 == 1)
    else:
        raise RuntimeError("intervals do not get narrower")

    inside = _inside(rows, keys, state, hot_rows)
    ordered = Window.partitionBy(*by, "c", "lo").orderBy("v")
    counted = (
        inside.groupBy(*by, "c", "lo", "v")
        .agg(F.count(F.lit(1)).alias("n"), F.first("rs").alias("rs"))
        .withColumn("cum", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    hits = _targets(counted).select(*by, "c", F.col("x.t").alias("t"), "v")
    n_ranks = len(_wanted_ranks(F.lit(1.0), probs, method))
    picks = [
        F.max(F.when((F.col("c") == i) & (F.col("t") == t), F.col("v"))).alias(f"_p{i}_{t}")
        for i in per_col
        for t in range(n_ranks)
    ]
    sizes = bounds.select(*by, *[f"_n{i}" for i in per_col])
    found_rows = hits.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*picks)
    same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    wide = sizes.join(found_rows, reduce(and_, same), "left")
    out = []
    for i, c in enumerate(cols):
        found = [F.col(f"_p{i}_{t}") for t in range(n_ranks)]
        n = F.col(f"_n{i}").cast("double")
        out += [
            v.alias(quantile_name(c, q)) for v, q in zip(_combine(found, n, probs, method), probs)
        ]
    return wide.select(*by, *out)


def _inside(rows: DataFrame, keys, state: DataFrame, hot_rows) -> DataFrame:
    """The values that fall into an interval still searched, one row each, with the group size."""
    sized = state.withColumn("_size", F.col("_w"))
    joined = lookup_join(
        rows, sized, keys, "_w", how="inner", null_safe=True, hot_rows=hot_rows, written=True
    )
    hit = F.filter(
        F.transform(
            F.col("_ivs"),
            lambda iv: F.struct(
                iv["c"].alias("c"),
                iv["lo"].alias("lo"),
                iv["hi"].alias("hi"),
                iv["rs"].alias("rs"),
                F.get(F.col("_vals"), iv["c"]).alias("v"),
                F.col("_size").alias("_w"),
            ),
        ),
        lambda x: (x["v"] >= x["lo"]) & (x["v"] <= x["hi"]),
    )
    return joined.select(*[col(k) for k in keys], F.explode(hit).alias("_x")).select(
        *[col(k) for k in keys], "_x.*"
    )


def _targets(counted: DataFrame) -> DataFrame:
    """Keep the rows whose cumulative count first exceeds a wanted rank."""
    return counted.withColumn("x", F.explode("rs")).filter(
        (F.col("x.r") < F.col("cum")) & (F.col("x.r") >= F.col("cum") - F.col("n"))
    )


def _narrow(rows: DataFrame, keys, state: DataFrame, hot_rows, by_ratio: bool = False) -> DataFrame:
    by = [col(k) for k in keys]
    binned = _inside(rows, keys, state, hot_rows).withColumn("bin", _place(by_ratio))
    # At most BINS + 4 rows per interval from here on.
    ordered = Window.partitionBy(*by, "c", "lo").orderBy("bin")
    counted = (
        binned.groupBy(*by, "c", "lo", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("new_lo"),
            F.max("v").alias("new_hi"),
            F.first("rs").alias("rs"),
            F.first("_w").alias("_w"),
        )
        .withColumn("cum", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    kept = _targets(counted).select(
        *by,
        "_w",
        "c",
        F.col("new_lo").alias("lo"),
        F.col("new_hi").alias("hi"),
        "n",
        F.struct(F.col("x.t").alias("t"), (F.col("x.r") - (F.col("cum") - F.col("n"))).alias("r")).alias("target"),
    )
    intervals = kept.groupBy(*by, "c", "lo", "hi").agg(
        F.max("n").alias("n"), F.collect_list("target").alias("rs"), F.max("_w").alias("_w")
    )
    return intervals.groupBy(*by).agg(
        F.collect_list(F.struct("c", "lo", "hi", "n", "rs")).alias("_ivs"), F.max("_w").alias("_w")
    )
