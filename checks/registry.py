"""Registering a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.data import series_sql, subjects_sql
from kinecohort.functions.columns import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are looked at."""

    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats as rounded doubles (without a negative zero)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[
            (F.round(col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def tidy_sql(sql: str, floats: Iterable[str], digits: int = 6) -> str:
    rounded = ", ".join(f'(ROUND(CAST("{c}" AS DOUBLE), {digits}) + 0.0) AS "{c}"' for c in floats)
    return f"SELECT * REPLACE ({rounded}) FROM (\n{sql}\n)"


def over_subjects(select: str, keep: list[str] | None = None) -> str:
    return f"WITH subjects AS ({subjects_sql(keep)})\n{select}"


def over_series(select: str) -> str:
    return f"WITH series AS ({series_sql()})\n{select}"


def over_both(select: str, keep: list[str] | None = None) -> str:
    return f"WITH subjects AS ({subjects_sql(keep)}), series AS ({series_sql()})\n{select}"


def names(cols: Iterable[str]) -> str:
    return ", ".join(f'"{c}"' for c in cols)


def nearest_sql(c: str, q: float) -> str:
    """Element at the rank nearest to the quantile."""
    return (
        f'list_sort(list("{c}") FILTER (WHERE "{c}" IS NOT NULL))'
        f'[CAST(floor({q} * (count("{c}") - 1) + 0.5) AS BIGINT) + 1]'
    )
