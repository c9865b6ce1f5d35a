"""Registration counts per join day (Q16) and per join month (Q17)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.columns import month_start
from segmenta.sources.tables import require_columns


def _as_date(value) -> _dt.date:
    if value is None:
        return _dt.datetime.now(_dt.timezone.utc).date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value)[:10])


def registrations_daily(users: DataFrame, *, as_of=None, years: int = 30) -> DataFrame:
    """date_joined (date), count — users with an id who joined from 1 January
    ``years`` years before ``as_of``'s year up to (not including) 1 January of
    ``as_of``'s year; ascending by day.

    The bounds are computed once on the driver and compared as literals, so
    they reach the Parquet scan as pushed filters.
    """
    require_columns(users, ["id", "date_joined"], "users")
    today = _as_date(as_of)
    lower = _dt.date(today.year - years, 1, 1)
    upper = _dt.date(today.year, 1, 1)
    return (
        users.where(
            F.col("id").isNotNull()
            & (F.col("date_joined") >= F.lit(lower.isoformat()))
            & (F.col("date_joined") < F.lit(upper.isoformat()))
        )
        .groupBy(F.to_date("date_joined").alias("date_joined"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("date_joined")
    )


def registrations_monthly(users: DataFrame) -> DataFrame:
    """date_joined (first day of the month), count — users with an id, all time;
    ascending by month (a NULL join date is its own group)."""
    require_columns(users, ["id", "date_joined"], "users")
    return (
        users.where(F.col("id").isNotNull())
        .groupBy(month_start("date_joined").alias("date_joined"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("date_joined").asc_nulls_last())
    )
