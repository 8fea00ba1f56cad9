"""Row filters on time. Bounds are plain literals, so they reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

Day = str | dt.date


def _day(value: Day) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def closed_window(df: DataFrame, start: Day, end: Day, column: str = "created_at") -> DataFrame:
    """Rows from midnight of `start` to midnight of `end`, both included.

    The upper bound is an instant, not a day: later rows of the last day fall out.
    """
    return df.where(f"`{column}` >= '{_day(start)}' AND `{column}` <= '{_day(end)}'")


def day_range(
    df: DataFrame, start: Day | None, end: Day | None, column: str = "created_at"
) -> DataFrame:
    """Rows of the days `start` to `end`, the whole last day included; None leaves a side open."""
    if start is not None:
        df = df.where(f"`{column}` >= '{_day(start)}'")
    if end is not None:
        df = df.where(f"`{column}` < '{_day(end) + dt.timedelta(days=1)}'")
    return df


def calendar_year(df: DataFrame, year: int, column: str = "created_at") -> DataFrame:
    """Rows of one calendar year, written as a range so that it can be pushed down."""
    return day_range(df, dt.date(year, 1, 1), dt.date(year, 12, 31), column)
