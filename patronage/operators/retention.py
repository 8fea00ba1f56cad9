"""Cohort retention by month, week and day; sparse, dense and wide.

Items are one frame, or several that have no user in common (`sources.store`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.functions.spans import Day, day_range
from patronage.functions.values import sample_size_suffix, status_is
from patronage.plans.cohorts import DAY, MONTH, WEEK, Grain, cohort_cells, dense_cells, named
from patronage.schemas import require_columns
from patronage.sources.store import ByUser, on_parts

COMPLETE = "Complete"


def _complete(
    items: ByUser, status: str, normalize: str, status_optional: bool = False
) -> ByUser:
    """Completed items. Where the status is optional, a table without one counts as completed."""

    def completed(part: DataFrame) -> DataFrame:
        require_columns(part, ("user_id", "created_at"), "order items")
        if status_optional and "status" not in part.columns:
            return part
        require_columns(part, ("status",), "order items")
        return part.where(status_is(F.col("status"), status, normalize))

    return on_parts(items, completed)


def cohort_monthly_sparse(
    items: ByUser,
    start: Day | None = None,
    end: Day | None = None,
    status: str = COMPLETE,
    normalize: str = "none",
) -> DataFrame:
    """Monthly retention, observed cells only; `start` and `end` are whole days, either may be open."""
    rows = on_parts(
        _complete(items, status, normalize), lambda part: day_range(part, start, end)
    )
    return named(cohort_cells(rows, MONTH), MONTH)


def cohort_monthly_by_category(
    items: ByUser,
    products: DataFrame,
    category: str,
    status: str = COMPLETE,
    normalize: str = "none",
) -> DataFrame:
    """Monthly retention within one product category, first purchase included."""
    chosen = products.where(F.col("category") == category).select(F.col("id").alias("product_id"))
    rows = on_parts(
        _complete(items, status, normalize),
        lambda part: part.join(chosen, "product_id", "left_semi"),
    )
    return named(cohort_cells(rows, MONTH), MONTH)


def cohort_monthly_dense(
    items: ByUser,
    max_age: int = 12,
    status: str = COMPLETE,
    normalize: str = "trim_lower",
) -> DataFrame:
    """Monthly retention with a zero for every observable cell without activity."""
    rows = _complete(items, status, normalize, status_optional=True)
    cells = dense_cells(rows, MONTH, max_age)
    label = F.concat(cal.month_label(F.col("cohort")), sample_size_suffix(F.col("cohort_size")))
    return named(cells, MONTH, label.alias("cohort_label"))


def _kept_cohorts(month: str, week_of_month: int | None) -> Column:
    """Cohorts of a month; for weeks that is their Monday's month."""
    kept = cal.month_label(F.col("cohort")) == month
    if week_of_month is not None:
        kept = kept & (cal.week_of_month(F.col("cohort")) == week_of_month)
    return kept


def cohort_weekly_dense(
    items: ByUser,
    month: str,
    week_of_month: int | None = None,
    max_age: int = 12,
    status: str = COMPLETE,
    normalize: str = "trim_lower",
) -> DataFrame:
    """Weekly retention of the cohorts of one month, or of one week of it."""
    rows = _complete(items, status, normalize)
    return _weekly(dense_cells(rows, WEEK, max_age, _kept_cohorts(month, week_of_month)))


def _weekly(cells: DataFrame) -> DataFrame:
    """The cells with the number and label of their week."""
    monday = F.col("cohort")
    label = F.concat(
        cal.month_label(monday),
        F.lit(" W"),
        cal.week_of_month(monday).cast("string"),
        F.lit(" ("),
        cal.iso_week_label(monday),
        F.lit(")"),
        sample_size_suffix(F.col("cohort_size")),
    )
    return named(cells, WEEK, cal.week_index(monday).alias("week_index"), label.alias("cohort_label"))


def cohort_weekly_month(
    items: ByUser,
    month: str,
    max_age: int = 12,
    status: str = COMPLETE,
    normalize: str = "trim_lower",
) -> DataFrame:
    """Weekly retention of all the cohorts of one month; the status is optional here."""
    rows = _complete(items, status, normalize, status_optional=True)
    return _weekly(dense_cells(rows, WEEK, max_age, _kept_cohorts(month, None)))


def cohort_daily_dense(
    items: ByUser,
    month: str,
    week_of_month: int | None = None,
    max_age: int = 30,
    status: str = COMPLETE,
    normalize: str = "trim_lower",
) -> DataFrame:
    """Daily retention of the cohorts of one month.

    The month is the day's own, the week of the month that of the day's Monday.
    """
    cells = dense_cells(
        _complete(items, status, normalize), DAY, max_age, _kept_cohorts(month, week_of_month)
    )
    day = F.col("cohort")
    label = F.concat(
        F.date_format(day, "yyyy-MM-dd (EEE, 'W'"),
        cal.week_of_month(day).cast("string"),
        F.lit(")"),
        sample_size_suffix(F.col("cohort_size")),
    )
    return named(cells, DAY, label.alias("cohort_label"))


def cohort_pivot(cells: DataFrame, ages: Iterable[int], grain: Grain = MONTH) -> DataFrame:
    """Cohort by age matrix of the retention, a column `<m|w|d><age>` for each age asked for.

    Naming the ages keeps columns nobody reached and saves a job to look for them; for all ages
    that occur, see `cohort_matrix`.
    """
    rows = [grain.cohort_column] + [c for c in ("cohort_label",) if c in cells.columns]
    ages = list(ages)
    letter = grain.name[0]
    wide = cells.groupBy(*rows).pivot(grain.age_column, ages).agg(F.max("retention"))
    return wide.select(*rows, *(F.col(str(age)).alias(f"{letter}{age}") for age in ages))


def cohort_matrix(cells: DataFrame, grain: Grain = MONTH) -> DataFrame:
    """Cohort by age matrix of the retention, each cohort's as an array from age 0 on.

    All arrays reach to the largest age of any cohort, null where there is no cell. The cells are
    made once: the largest age comes from a window over them, and there are only as many as
    cohorts times ages.
    """
    rows = [grain.cohort_column] + [c for c in ("cohort_label",) if c in cells.columns]
    age = F.col(grain.age_column)
    horizon = F.max(age).over(Window.partitionBy())
    by_age = F.map_from_entries(F.collect_list(F.struct(age, "retention")))
    listed = (
        cells.where(age.isNotNull())
        .withColumn("horizon", horizon)
        .groupBy(*rows, "horizon")
        .agg(by_age.alias("by_age"))
    )
    ages = F.sequence(F.lit(0), F.col("horizon"))
    return listed.select(
        *rows, F.transform(ages, lambda a: F.try_element_at("by_age", a)).alias("retention")
    )
