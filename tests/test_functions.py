"""Helpers against independent implementations on random input."""

import datetime as dt
import math
import textwrap

import numpy as np
import pytest
from frames import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.functions.values import Bins, ratio, ratio_or_zero, shorten, status_is
from patronage.plans.histogram import equal_width_histogram
from patronage.plans.keys import complete_keys, top_k
from patronage.plans.ranks import count_values, pick_ranks, quantile_summary


def test_calendar_against_datetime(spark):
    start = dt.date(1969, 12, 1)
    days = [start + dt.timedelta(days=7 * i + i % 7) for i in range(3_500)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    d = F.col("d")
    found = df.select(
        "d",
        cal.week_start(d),
        cal.week_index(d),
        cal.week_of_month(d),
        cal.iso_week_label(d),
        cal.weekday_index(d),
        cal.weekday_name(cal.weekday_index(d)),
        cal.is_weekend(d),
        cal.month_start(d),
        cal.month_gap(d, F.lit("2000-03-31").cast("date")),
    )
    for row in rows(found):
        day = row[0]
        monday = day - dt.timedelta(days=day.weekday())
        iso = day.isocalendar()
        assert row[1:] == (
            monday,
            (monday - dt.date(1970, 1, 5)).days // 7,
            (monday.day - 1) // 7 + 1,
            f"{iso.year}-W{iso.week:02d}",
            day.weekday(),
            day.strftime("%a"),
            day.weekday() >= 5,
            day.replace(day=1),
            day.year * 12 + day.month - 2000 * 12 - 3,
        )


def test_elapsed_days_floor(spark):
    base = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)
    gaps = [
        dt.timedelta(days=d, microseconds=m)
        for d in (-40_000, -366, -1, 0, 1, 365, 40_000)
        for m in (-1, 0, 1, 3_600_000_000, -3_600_000_000)
    ]
    df = spark.createDataFrame([(base + g, base) for g in gaps], "a timestamp, b timestamp")
    found = rows(df.select(cal.elapsed_days(F.col("a"), F.col("b"))))
    assert [r[0] for r in found] == [g // dt.timedelta(days=1) for g in gaps]


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["a", "of", "T-shirt", "pre-owned", "x" * 30, "jeans", "501", "slim-fit-cut",
                 "é-ñandú", "  ", "\t", "wordy" * 4, "-", "3-pack", "--", "501--Original", "---",
                 "a---b", "\xa0", "\u2003", "x-" * 20, "(new)--" * 5]
            ),
            max_size=8,
        ).map(" ".join),
        min_size=1,
        max_size=30,
    )
)
def test_shorten_like_textwrap(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows(df.select(shorten(F.col("t"))))]
    assert found == [textwrap.shorten(t, width=25, placeholder="...") for t in texts]


def _counts(spark, values):
    df = spark.createDataFrame([(int(v),) for v in values], "x bigint")
    return count_values(df, F.col("x"))


@pytest.mark.parametrize("spread", [1, 50, 10**7, 10**12])
@pytest.mark.parametrize("size", [1, 2, 97, 1_000])
def test_quantiles_and_ranks(spark, spread, size):
    rng = np.random.default_rng(size + spread)
    values = rng.integers(-spread, spread, size)
    values[: size // 3] = values[0]  # one value holds a third of all rows
    counts = _counts(spark, values)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    (found,) = quantile_summary(counts, wanted).collect()
    assert (found.total_n, int(found.total_sum)) == (size, int(values.sum()))
    for name, q in wanted.items():
        assert found[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-9)
    ordered = np.sort(values)
    picks = pick_ranks(counts, {"third": "ceil(total_n / 3)", "none": "total_n + 1"}).collect()
    assert [p.name for p in picks] == ["third"]
    value = ordered[math.ceil(size / 3) - 1]
    assert picks[0].value == value
    assert picks[0].below_n == int((values < value).sum())
    assert int(picks[0].below_sum) == int(values[values < value].sum())


def test_no_values_have_no_quantile(spark):
    (found,) = rows(quantile_summary(_counts(spark, []), {"median": 0.5}))
    assert found == (None, None, None)


@pytest.mark.parametrize("bins", [1, 15, 20])
def test_histogram_like_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    cases = (
        rng.integers(-10, 400, 500) / 1.0,
        rng.lognormal(5, 2, 700).round(2),
        np.linspace(0.1, 0.7, 61),
        np.array([3.25] * 9),
    )
    for values in cases:
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        counts = df.groupBy("v").agg(F.count("*").alias("n"))
        found = equal_width_histogram(counts, bins).orderBy("bin").collect()
        users, edges = np.histogram(values, bins=bins)
        assert [r.users for r in found] == users.tolist()
        assert [r.lo for r in found] == pytest.approx(edges[:-1].tolist())
        assert [r.hi for r in found] == pytest.approx(edges[1:].tolist())
        assert found[0].mean == pytest.approx(values.mean())


def test_small_helpers(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "k string, v double")
    assert [r.k for r in top_k(df, 2, "v", "k").collect()] == ["b", "c"]
    keyed = spark.createDataFrame([(1, 5)], "key int, n int")
    assert sorted(rows(complete_keys(keyed, "key", 3)), key=str) == [(0, None), (1, 5), (2, None)]
    zero = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)), ratio_or_zero(F.lit(1), F.lit(0)), ratio(F.lit(1), F.lit(4))
    )
    assert rows(zero) == [(None, 0.0, 0.25)]
    with pytest.raises(ValueError):
        Bins((0, 1), ("a", "b"))


def test_status_ignores_any_white_space(spark):
    blanks = ["", " ", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\t\n"]
    df = spark.createDataFrame([(b + "Complete" + b,) for b in blanks] + [("x",)], "s string")
    found = rows(df.select(status_is(F.col("s"), "complete", "trim_lower")))
    assert [r[0] for r in found] == [True] * len(blanks) + [False]


def test_ranks_over_a_huge_range(spark):
    values = [-(10**15), -5, 0, 3, 3, 10**15, 2**62, -(2**62)]
    got = {r["name"]: r["value"] for r in pick_ranks(
        _counts(spark, values), {f"r{k}": f"{k}L" for k in range(1, 9)}
    ).collect()}
    assert got == {f"r{k + 1}": v for k, v in enumerate(sorted(values))}
