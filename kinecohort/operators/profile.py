"""Data behind the profile charts: counts, shares, histograms, densities, boxes, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.functions.columns import col, nan_to_null
from kinecohort.operators.order import running_sum
from kinecohort.operators.quantiles import quantile_name, quantiles
from kinecohort.operators.skew import lookup_join
from kinecohort.sources.shared import materialize

ALL = "_all"


def crosstab_counts(df: DataFrame, x: str, y: str, normalize_over_x: bool = False) -> DataFrame:
    """Rows per (x, y), nulls being a value; with ``normalize_over_x`` the share within x."""
    counts = df.groupBy(col(x), col(y)).agg(F.count(F.lit(1)).alias("count"))
    return share_within_group(counts, "count", [x]) if normalize_over_x else counts


def share_within_group(counts: DataFrame, amount: str, keys: Sequence[str]) -> DataFrame:
    """Replace an amount by its share of the group total.

    The totals are aggregated and looked up: a window over the group would hold all its
    values in one task.
    """
    totals = counts.groupBy(*[col(k) for k in keys]).agg(
        F.sum(col(amount)).alias("_total"), F.count(F.lit(1)).alias("_w")
    )
    joined = lookup_join(counts, totals, keys, "_w", null_safe=True)
    return joined.withColumn(amount, col(amount) / F.col("_total")).drop("_total")


def value_range(counts: DataFrame, name: str = "count") -> DataFrame:
    return counts.agg(F.min(col(name)).alias("lowest"), F.max(col(name)).alias("highest"))


def value_shares(df: DataFrame, x: str) -> DataFrame:
    """Rows per value and their share of all rows.

    The total is a scalar subquery: a window over everything would
    put every distinct value into one task.
    """
    counts = value_counts(df, x)
    total = counts.agg(F.sum("count"))
    return counts.withColumn("percentage", F.col("count") / total.scalar())


def value_counts(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, x: str, width: float, low: float = 0.0) -> DataFrame:
    """Rows per bin ``[bin_start, bin_start + width)``; null and NaN are in none."""
    value = nan_to_null(col(x).cast("double"))
    place = F.floor((value - F.lit(float(low))) / F.lit(float(width)))
    start = (place * F.lit(float(width)) + F.lit(float(low))).alias("bin_start")
    return df.filter(value.isNotNull()).groupBy(start).agg(F.count(F.lit(1)).alias("count"))


def _with_all(df: DataFrame, group: str | None) -> tuple[DataFrame, str]:
    return (df, group) if group else (df.withColumn(ALL, F.lit(0)), ALL)


def normal_reference_bandwidth(
    df: DataFrame, x: str, group: str | None = None, small_rows: int | None = None
) -> DataFrame:
    """Per group 1.06 * min(std, IQR / 1.34) * n^(-1/5), of the first of these that is not 0."""
    df, key = _with_all(df, group)
    value = nan_to_null(col(x).cast("double"))
    sizes = [F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd")]
    q = quantiles(df, [key], [x], (0.25, 0.75), "linear", extra=sizes, small_rows=small_rows)
    q1, q3 = col(quantile_name(x, 0.25)), col(quantile_name(x, 0.75))
    spread = F.least(F.col("_sd"), (q3 - q1) / F.lit(1.34))
    scale = F.coalesce(
        F.nullif(spread, F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)), F.nullif(F.abs(q1), F.lit(0.0)), F.lit(1.0)
    )
    return q.filter(F.col("_n") > 0).select(
        col(key), (F.lit(1.06) * scale * F.pow(F.col("_n"), F.lit(-0.2))).alias("bandwidth")
    )


def _normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, error below 7.5e-8)."""
    # Coefficients of the published approximation 26.2.17 (Abramowitz, Stegun).
    p = 0.2316419
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + F.lit(c)) * t
    upper = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def kde_density(
    df: DataFrame,
    x: str,
    low: float | None = None,
    high: float | None = None,
    steps: int = 50,
    group: str | None = None,
    bandwidth: float | None = None,
    cumulative: bool = False,
) -> DataFrame:
    """Gaussian kernel density of ``x`` per group on ``steps + 1`` points from low to high.

    Null and NaN values have no part in it; a null group is a group. The bandwidth, one number per
    group, is attached to the rows, and every grid point is a sum over them: these combine
    map-side, and one row per group and task is shuffled. Without a ``bandwidth`` the normal
    reference rule is used per group; without bounds the grid reaches from the lowest to the
    highest value of all groups.
    """
    value = nan_to_null(col(x).cast("double"))
    df, key = _with_all(df, group)
    rows = df.select(col(key), value.alias("_x")).filter(F.col("_x").isNotNull())
    lowest = F.lit(float(low)) if low is not None else F.coalesce(rows.agg(F.min("_x")).scalar(), F.lit(0.0))
    highest = F.lit(float(high)) if high is not None else F.coalesce(rows.agg(F.max("_x")).scalar(), F.lit(1.0))
    rows = rows.withColumns({"_low": lowest, "_step": (highest - lowest) / F.lit(float(steps))})
    if bandwidth is None:
        sizes = df.groupBy(col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_w"))
        widths = normal_reference_bandwidth(df, x, key)
        widths = widths.join(sizes, widths[key].eqNullSafe(sizes["_key"])).drop("_key")
        rows = lookup_join(rows, widths, [key], "_w", how="inner", null_safe=True)
    else:
        rows = rows.withColumn("bandwidth", F.lit(float(bandwidth)))

    def kernel(i: int) -> Column:
        z = (F.col("_low") + F.lit(float(i)) * F.col("_step") - F.col("_x")) / F.col("bandwidth")
        return _normal_cdf(z) if cumulative else F.exp(-z * z / 2) / (F.lit(2.5066282746310002) * F.col("bandwidth"))

    sums = rows.groupBy(col(key)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("_low").alias("_low"),
        F.first("_step").alias("_step"),
        *[F.sum(kernel(i)).alias(f"_s{i}") for i in range(steps + 1)],
    )
    points = F.array(
        *[
            F.struct((F.col("_low") + F.lit(float(i)) * F.col("_step")).alias("value"), (F.col(f"_s{i}") / F.col("_n")).alias("density"))
            for i in range(steps + 1)
        ]
    )
    out = sums.select(*([col(key)] if group else []), F.explode(points).alias("_p"))
    return out.select(*([col(key)] if group else []), "_p.*")


def box_stats(df: DataFrame, x: str, group: str, small_rows: int | None = None) -> DataFrame:
    """Quartiles per group and the outermost values within 1.5 interquartile ranges; NaN counts as null."""
    df = df.select(col(group), nan_to_null(col(x).cast("double")).alias(x))
    rows = [F.count(F.lit(1)).alias("_w")]
    q = quantiles(df, [group], [x], (0.25, 0.5, 0.75), "linear", extra=rows, small_rows=small_rows)
    quartiles = q.select(
        col(group),
        "_w",
        col(quantile_name(x, 0.25)).alias("q1"),
        col(quantile_name(x, 0.5)).alias("median"),
        col(quantile_name(x, 0.75)).alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = col(x)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    joined = lookup_join(df.select(col(group), v), quartiles, [group], "_w", null_safe=True)
    return joined.groupBy(col(group)).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def pairwise_corr(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of every ordered pair of columns over the rows that have both values (NaN is none)."""
    df = df.select(*[nan_to_null(col(c).cast("double")).alias(c) for c in cols])
    if method == "spearman":
        return _spearman(df, cols)
    if method != "pearson":
        raise ValueError(f"unknown method: {method}")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    # All pairs in one aggregate over one scan; the result is one row.
    row = df.agg(*[F.corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    at = {p: f"r{i}" for i, p in enumerate(pairs)}
    cells = [
        F.struct(
            F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(at.get((a, b)) or at[(b, a)]).alias("value")
        )
        for a, b in product(cols, cols)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), col(a).cast("double").alias("x"), col(b).cast("double").alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = (
        df.select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Read for the ranks of either side and for the sums.
    rows = materialize(rows, "pairs")
    # Both sides in one table of (pair, side, value), ranked together.
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v"), "n") for s in ("x", "y")])
    counts = (
        rows.select("pair", F.explode(sides).alias("s"))
        .groupBy("pair", "s.side", "s.v")
        .agg(F.sum("s.n").alias("m"), F.count(F.lit(1)).alias("_w"))
    )
    ranks = running_sum(counts, ["pair", "side"], ["v"], "m", "before").withColumn(
        "rank", F.col("before") + (F.col("m") + 1) / 2
    )
    for side in ("x", "y"):
        own = ranks.filter(F.col("side") == side).select(
            "pair", F.col("v").alias(side), F.col("rank").alias(f"rank_{side}"), "_w"
        )
        rows = lookup_join(rows, own, ["pair", side], "_w", how="inner")
    n, rx, ry = F.col("n"), F.col("rank_x"), F.col("rank_y")
    # Ranks have mean (N + 1) / 2; centring them keeps the sums small.
    size = rows.groupBy("pair").agg(F.sum("n").alias("_size"), F.count(F.lit(1)).alias("_w"))
    centred = lookup_join(rows, size, ["pair"], "_w", how="inner")
    mid = (F.col("_size") + 1) / 2
    dx, dy = rx - mid, ry - mid
    sums = centred.groupBy("pair").agg(
        F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy")
    )
    r = F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))
    names = F.array(
        *[F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2")) for a, b in pairs]
    )
    one = sums.select(F.get(names, F.col("pair")).alias("p"), r.alias("value"))
    both = F.when(F.col("p.column1") == F.col("p.column2"), F.array("p")).otherwise(
        F.array("p", F.struct(F.col("p.column2").alias("column1"), F.col("p.column1").alias("column2")))
    )
    return one.select(F.explode(both).alias("q"), "value").select("q.column1", "q.column2", "value")
