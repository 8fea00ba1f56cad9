"""How often customers buy, and who comes back: by month, season and weekday.

Items are one frame, or several that have no user in common (`sources.store`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.functions.spans import Day, day_range
from patronage.functions.values import ratio, status_is
from patronage.plans.cohorts import DAY, MONTH, active_periods, cohort_cells
from patronage.plans.keys import complete_keys
from patronage.schemas import require_columns
from patronage.sources.store import ByUser, on_parts, parts_of

COMPLETE = "Complete"
# Fixed value: the statuses that count as a purchase made, whatever became of it.
PURCHASE_STATUSES = ("Complete", "Returned", "Cancelled")


def orders_per_user(items: ByUser) -> DataFrame:
    """Distinct orders of each user: `user_id, num_orders`.

    Pairs are made distinct on the map side and shuffled by both columns before they are
    counted, so the orders of one large buyer are spread. A null order counts as none. Of several
    frames that have no user in common, each is counted for itself.
    """

    def counted(part: DataFrame) -> DataFrame:
        pairs = part.where(F.col("user_id").isNotNull()).select("user_id", "order_id").distinct()
        return pairs.groupBy("user_id").agg(F.count("order_id").alias("num_orders"))

    return reduce(DataFrame.unionAll, map(counted, parts_of(items)))


def frequency(per_user: DataFrame) -> DataFrame:
    """Users per number of orders."""
    return per_user.groupBy("num_orders").agg(F.count("*").alias("users")).orderBy("num_orders")


def _of_status(items: ByUser, status: str, normalize: str) -> ByUser:
    return on_parts(items, lambda part: part.where(status_is(F.col("status"), status, normalize)))


def purchase_frequency(
    items: ByUser, status: str = COMPLETE, normalize: str = "none"
) -> DataFrame:
    return frequency(orders_per_user(_of_status(items, status, normalize)))


def purchase_counts_by_user(
    items: ByUser, statuses: Sequence[str] = PURCHASE_STATUSES
) -> DataFrame:
    wanted = F.col("status").isin(list(statuses))
    return orders_per_user(on_parts(items, lambda part: part.where(wanted)))


def repeat_purchaser_monthly(
    items: ByUser,
    year: int | None,
    status: str = COMPLETE,
    normalize: str = "trim_lower",
) -> DataFrame:
    """Buyers of each month and how many of them had bought in an earlier month.

    The year is cut out after first months are known, so earlier purchases still count. A table
    without a status counts as completed.
    """

    def completed(part: DataFrame) -> DataFrame:
        require_columns(part, ("user_id", "created_at"), "order items")
        return _of_status(part, status, normalize) if "status" in part.columns else part

    active = active_periods(on_parts(items, completed), MONTH)
    if year is not None:
        active = active.where(F.year("period") == year)
    returning = (F.col("cohort") < F.col("period")).cast("int")
    by_month = active.groupBy(F.col("period").alias("order_month")).agg(
        F.sum(returning).alias("returning_users"), F.count("*").alias("purchasers")
    )
    raw = ratio(F.col("returning_users"), F.col("purchasers"))
    return (
        by_month.withColumn("rate_raw", raw)
        .withColumn("repeat_purchaser_rate", F.bround("rate_raw", 3))
        .orderBy("order_month")
    )


def repeat_rate_by_season(monthly: DataFrame) -> DataFrame:
    """Share of returning buyers, January–October against November–December."""
    late = F.month("order_month") >= 11
    season = F.when(late, F.lit("nov_dec")).otherwise(F.lit("jan_oct"))
    return monthly.groupBy(season.alias("season")).agg(
        F.sum("returning_users").alias("returning_users"),
        F.sum("purchasers").alias("purchasers"),
        (ratio(F.sum("returning_users"), F.sum("purchasers")) * 100).alias("rate_pct"),
    )


def _repeat_cells(
    items: ByUser, start: Day | None, end: Day | None, status: str, normalize: str
) -> DataFrame:
    """Observed daily cells of age 1 and up, with the day of the repeat purchase."""
    rows = on_parts(
        _of_status(items, status, normalize), lambda part: day_range(part, start, end)
    )
    return (
        cohort_cells(rows, DAY)
        .where(F.col("age") >= 1)
        .withColumn("repeat_day", F.date_add("cohort", F.col("age")))
    )


def _by_weekday(cells: DataFrame, day: Column) -> DataFrame:
    """All seven weekdays with repeats, exposure and rate; nothing if nobody came back."""
    found = cells.groupBy(cal.weekday_index(day).alias("weekday")).agg(
        F.sum("active_users").alias("repeats"), F.sum("cohort_size").alias("exposed")
    )
    # seven rows, hence the window over all of them
    any_repeat = F.sum("exposed").over(Window.partitionBy()) > 0
    return (
        complete_keys(found, "weekday", 7)
        .select("*", any_repeat.alias("any_repeat"))
        .where("any_repeat")
        .select(
            "weekday",
            cal.weekday_name(F.col("weekday")).alias("weekday_name"),
            F.coalesce("repeats", F.lit(0)).alias("repeat_orders"),
            F.coalesce("exposed", F.lit(0)).alias("exposure"),
            ratio(F.col("repeats"), F.col("exposed")).alias("repeat_rate"),
        )
        .orderBy("weekday")
    )


def repeat_by_order_weekday(
    items: ByUser,
    start: Day | None = None,
    end: Day | None = None,
    status: str = COMPLETE,
    normalize: str = "lower",
) -> DataFrame:
    """Repeat rate by the weekday of the repeat purchase.

    A cohort's size counts as exposure once for each day it was seen to come back.
    """
    cells = _repeat_cells(items, start, end, status, normalize)
    return _by_weekday(cells, F.col("repeat_day"))


def repeat_by_cohort_weekday(
    items: ByUser,
    start: Day | None = None,
    end: Day | None = None,
    status: str = COMPLETE,
    normalize: str = "lower",
) -> DataFrame:
    """Repeat rate by the weekday of the first purchase."""
    cells = _repeat_cells(items, start, end, status, normalize)
    return _by_weekday(cells, F.col("cohort"))


def repeat_weekday_vs_weekend(
    items: ByUser,
    start: Day | None = None,
    end: Day | None = None,
    status: str = COMPLETE,
    normalize: str = "lower",
) -> DataFrame:
    """Repeat rate of the working week against Saturday and Sunday; only what occurs."""
    cells = _repeat_cells(items, start, end, status, normalize)
    group = F.when(cal.is_weekend(F.col("repeat_day")), F.lit("weekend")).otherwise(
        F.lit("weekday")
    )
    rate = ratio(F.sum("active_users"), F.sum("cohort_size"))
    return cells.groupBy(group.alias("day_group")).agg(
        F.sum("active_users").alias("repeaters"),
        F.sum("cohort_size").alias("exposure"),
        F.bround(rate * 100, 3).alias("rate_pct"),
    )
