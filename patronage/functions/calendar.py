"""Calendar arithmetic on columns. Periods are DATEs: the first day of the month or week, or the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def month_start(when: Column) -> Column:
    return F.trunc(when, "MM")


def week_start(when: Column) -> Column:
    """The Monday of the week."""
    return F.trunc(when, "WEEK")


def day_start(when: Column) -> Column:
    return F.to_date(when)


def month_gap(later: Column, earlier: Column) -> Column:
    """Calendar months between two dates, whatever the day of the month."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def week_gap(later: Column, earlier: Column) -> Column:
    """Weeks between the Mondays of two dates."""
    return F.floor(F.datediff(week_start(later), week_start(earlier)) / 7).cast("int")


def week_index(when: Column) -> Column:
    """Number of the Monday-based week, counted from Monday 1970-01-05."""
    return week_gap(when, F.lit("1970-01-05").cast("date"))


def week_of_month(when: Column) -> Column:
    """Which Monday of its month the week's Monday is: 1..5."""
    return (F.floor((F.dayofmonth(week_start(when)) - 1) / 7) + 1).cast("int")


def iso_week_label(when: Column) -> Column:
    """ISO year and week, as in 2022-W52."""
    year = F.extract(F.lit("YEAROFWEEK"), when).cast("string")
    week = F.lpad(F.weekofyear(when).cast("string"), 2, "0")
    return F.concat(year, F.lit("-W"), week)


def month_label(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM")


def weekday_index(when: Column) -> Column:
    """0 is Monday, 6 is Sunday."""
    return F.weekday(when)


def weekday_name(index: Column) -> Column:
    """Short English name of a weekday index; 2024-01-01 is a Monday."""
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), index), "EEE")


def is_weekend(when: Column) -> Column:
    return F.weekday(when) >= 5


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, rounded down: one hour before is -1."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    whole = micros - F.pmod(micros, F.lit(DAY_MICROS))
    return F.call_function("div", whole, F.lit(DAY_MICROS)).cast("int")
