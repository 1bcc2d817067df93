"""Column expressions: null handling, IEEE division, horizontal statistics, labels.

Everything here is a plain expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Back-ticked column name, needed for names that hold dots or back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def starting_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def ending_with(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become null (what the MLlib learners need)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ieee_div(num: Column, den: Column) -> Column:
    """Division as IEEE 754 has it: x/0 is signed infinity, 0/0 is NaN, null stays null."""
    n, d = num.cast("double"), den.cast("double")
    by_zero = F.when((n == 0) | F.isnan(n), F.lit(float("nan"))).when(
        n.isNotNull(), F.signum(n) * F.lit(float("inf"))
    )
    return F.when(d != 0, n / d).when(d == 0, by_zero)


def floor_bin(c: Column, width: float) -> Column:
    """Floor division (rounds towards minus infinity, unlike ``div``)."""
    return F.floor(c / F.lit(width))


def null_count(names: Sequence[str]) -> Column:
    """Number of null values among the columns of a row."""
    return reduce(add, [col(c).isNull().cast("int") for c in names])


def mean_horizontal(names: Sequence[str]) -> Column:
    """Mean of the non-null values of a row; null where all are null."""
    total = reduce(add, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in names])
    present = F.lit(len(names)) - null_count(names)
    return F.when(present > 0, total / F.nullif(present, F.lit(0)))


def round_whole(c: Column, mode: str = "half_up") -> Column:
    """Round to a whole number; ``half_up`` is away from zero, ``half_even`` is banker's."""
    if mode == "half_up":
        return F.round(c, 0)
    if mode == "half_even":
        return F.bround(c, 0)
    raise ValueError(f"unknown rounding mode: {mode}")


def threshold_label(score: Column, cuts: Sequence[float]) -> Column:
    """Label = index of the first cut above the score, in the given order.

    NaN and null scores get the last label; cuts need not be sorted.
    """
    label = F.when(score < F.lit(float(cuts[0])), F.lit(0))
    for i, cut in enumerate(cuts[1:], start=1):
        label = label.when(score < F.lit(float(cut)), F.lit(i))
    return label.otherwise(F.lit(len(cuts)))


def as_f32(c: Column) -> Column:
    """32-bit float, by way of a double.

    Spark takes a cast of a whole number to float and on to double for a widening one and
    leaves the float out, so a direct cast would keep digits that a float has not got.
    """
    return c.cast("double").cast("float")


def cast_numeric_f32(df: DataFrame) -> DataFrame:
    """Cast every numeric column to 32-bit float, leave the others alone."""
    numeric = set(numeric_columns(df))
    return df.select(*[as_f32(col(c)).alias(c) if c in numeric else col(c) for c in df.columns])
