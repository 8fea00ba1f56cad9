"""The cohort core: who was active when, counted by first period and age.

The plan has one scan and no join. Rows are reduced to distinct (user, period) on the
map side and shuffled by both columns, so a user with a third of all rows arrives as a
handful of rows. The window per user then sees at most one row per period.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.sources.store import ByUser, parts_of


@dataclass(frozen=True)
class Grain:
    """How a timestamp becomes a period, and how far apart two periods are."""

    name: str
    start: Callable[[Column], Column]
    gap: Callable[[Column, Column], Column]

    @property
    def cohort_column(self) -> str:
        return f"cohort_{self.name}"

    @property
    def age_column(self) -> str:
        return f"age_{self.name[0]}"


MONTH = Grain("month", cal.month_start, cal.month_gap)
WEEK = Grain("week", cal.week_start, cal.week_gap)
DAY = Grain("day", cal.day_start, cal.day_gap)


def _dated(items: DataFrame) -> DataFrame:
    return items.where(F.col("user_id").isNotNull() & F.col("created_at").isNotNull())


def active_periods(items: ByUser, grain: Grain) -> DataFrame:
    """One row per user and active period, with the user's first period as `cohort`.

    Of several frames that have no user in common, each is done for itself.
    """
    return reduce(DataFrame.unionAll, (_active_periods(part, grain) for part in parts_of(items)))


def active_pairs(items: DataFrame, grain: Grain) -> DataFrame:
    """The distinct (user_id, period) of dated rows."""
    period = grain.start(F.col("created_at")).alias("period")
    return _dated(items).select("user_id", period).distinct()


def _active_periods(items: DataFrame, grain: Grain) -> DataFrame:
    periods = active_pairs(items, grain)
    first = F.min("period").over(Window.partitionBy("user_id"))
    return periods.withColumn("cohort", first)


def _aged_periods(items: ByUser, grain: Grain) -> DataFrame:
    age = grain.gap(F.col("period"), F.col("cohort"))
    return active_periods(items, grain).withColumn("age", age)


def _sized(cells: DataFrame) -> DataFrame:
    """Everyone is active at age 0, so that cell is the cohort's size."""
    size = F.max(F.when(F.col("age") == 0, F.col("active_users")))
    return cells.withColumn("cohort_size", size.over(Window.partitionBy("cohort")))


def cohort_cells(items: ByUser, grain: Grain) -> DataFrame:
    """Observed cells: `cohort, age, active_users, cohort_size, retention`."""
    cells = (
        _aged_periods(items, grain)
        .groupBy("cohort", "age")
        .agg(F.count("*").alias("active_users"))
    )
    return cells_of_counts(cells)


def cells_of_counts(counts: DataFrame) -> DataFrame:
    """Counts by `cohort, age` with each cohort's size and the share of it."""
    return _with_retention(_sized(counts))


def dense_cells(
    items: ByUser,
    grain: Grain,
    max_age: int,
    keep_cohort: Column | None = None,
) -> DataFrame:
    """Every cell from age 0 to `max_age` that could have been observed, zeros included.

    The horizon is the last period over all the input rows, whatever cohorts are kept. To
    learn it from the same pass, rows of no interest go into one cell without a cohort.
    """
    kept = F.col("age").between(0, max_age)
    if keep_cohort is not None:
        kept = kept & keep_cohort
    cells = (
        _aged_periods(items, grain)
        .withColumn("kept", kept)
        .groupBy(
            F.when(F.col("kept"), F.col("cohort")).alias("cohort"),
            F.when(F.col("kept"), F.col("age")).alias("age"),
        )
        .agg(F.count("*").alias("active_users"), F.max("period").alias("last_period"))
    )
    # The window over everything sees kept cohorts x (max_age + 1) cells and the one without.
    horizon = F.max("last_period").over(Window.partitionBy())
    found = _sized(cells.withColumn("horizon", horizon)).where(F.col("cohort").isNotNull())
    # The age-0 cell of a cohort stands for all its ages, every other cell for its own.
    last_age = F.least(F.lit(max_age), grain.gap(F.col("horizon"), F.col("cohort")))
    ages = F.when(F.col("age") == 0, F.sequence(F.lit(0), last_age)).otherwise(F.array("age"))
    spread = found.select(
        "cohort",
        "cohort_size",
        "active_users",
        F.col("age").alias("own_age"),
        F.explode(ages).alias("age"),
    )
    active = F.when(F.col("age") == F.col("own_age"), F.col("active_users")).otherwise(F.lit(0))
    return _with_retention(
        spread.groupBy("cohort", "cohort_size", "age").agg(F.sum(active).alias("active_users"))
    )


def _with_retention(cells: DataFrame) -> DataFrame:
    return cells.select(
        "cohort",
        "age",
        "active_users",
        "cohort_size",
        (F.col("active_users") / F.col("cohort_size")).alias("retention"),
    )


def named(cells: DataFrame, grain: Grain, *extra: Column) -> DataFrame:
    """The cells under the grain's own column names, with any extra columns in front."""
    return cells.select(
        F.col("cohort").alias(grain.cohort_column),
        *extra,
        F.col("age").alias(grain.age_column),
        "active_users",
        "cohort_size",
        "retention",
    )
