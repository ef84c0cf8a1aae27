"""Scopes and time windows over error tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def days(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * 86400.0))


def scoped(logs: DataFrame, application: int | Sequence[int] | None = None) -> DataFrame:
    """Rows of one application or several; None is all."""
    if application is None:
        return logs
    ids = [application] if isinstance(application, int) else list(application)
    return logs.filter(F.col("application_id").isin(ids))


def since(logs: DataFrame, as_of: Column, n: float, application: int | Sequence[int] | None = None) -> DataFrame:
    """The last n days. Bounds are constants, so that they reach the scan."""
    return scoped(logs, application).filter(F.col("occurred_at") >= as_of - days(n))


def day_start(as_of: Column, back: int = 0) -> Column:
    return F.date_trunc("DAY", as_of - days(back)).cast("timestamp_ntz")


def clamp_days(n: int) -> int:
    return max(1, min(365, int(n)))


def day_spine(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row with a column ``day`` for each date between, made without reading data."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))).alias("day"))
