"""Table sizes, status counts and the values filters can choose from."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions import calendar as cal


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    sizes = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("cols")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, sizes)


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """A few rows to look at, whichever come first."""
    return df.limit(n)


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status, most frequent first; unknown status left out."""
    return (
        orders.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.col("orders").desc(), "status")
    )


def dimension_values(df: DataFrame, column: str) -> DataFrame:
    """The known values of a column, in order."""
    known = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    return known.distinct().orderBy("value")


def available_months(items: DataFrame) -> DataFrame:
    """Months with items, newest first."""
    month = cal.month_start(F.col("created_at")).alias("month")
    months = items.select(month).where(F.col("month").isNotNull()).distinct()
    return months.withColumn("label", cal.month_label(F.col("month"))).orderBy(F.desc("month"))


def cohort_months_weekly(items: DataFrame) -> DataFrame:
    """Months a weekly cohort can belong to: those of the Mondays, newest first."""
    monday = items.select(cal.week_start(F.col("created_at")).alias("created_at"))
    return available_months(monday)


def date_bounds(items: DataFrame) -> DataFrame:
    """First and last day with items."""
    return items.agg(
        F.to_date(F.min("created_at")).alias("first_day"),
        F.to_date(F.max("created_at")).alias("last_day"),
    )
