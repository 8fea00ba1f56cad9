"""Sizes and bounds from the footers of Parquet files."""

import datetime as dt

import pytest
from frames import rows

from __spark_entry__ import queries
from patronage.session import configure
from patronage.sources import footers

SMALL = "/root/testdata/sf0.001"
KINDS = "a bigint, b int, day date, at timestamp_ntz, zone timestamp, name string, `a.b` smallint"


@pytest.fixture
def table(spark, tmp_path):
    """Two files with nulls and times before 1970."""
    configure(spark)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    early, late = dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29, 12)
    first = [
        (5, 1, early.date(), early, late, "x", 3),
        (-7, None, late.date(), late, None, "y", 4),
    ]
    second = [(None,) * 7] * 2 + [(0, 1, late.date(), late, late, None, 3)]
    for lines in (first, second):
        frame = spark.createDataFrame(lines, KINDS).coalesce(1)
        frame.write.mode("append").parquet(f"{tmp_path}/t")
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    return f"{tmp_path}/t"


def micros(time):
    return (time - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_bounds(spark, table):
    early, late = dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29, 12)
    days = (late.date() - dt.date(1970, 1, 1)).days
    zone = spark.read.parquet(table).selectExpr("unix_micros(max(zone))").first()[0]
    assert sorted(rows(footers.stored_bounds(spark, table))) == [
        ("a", 5, 3, -7, 5),
        ("a.b", 5, 3, 3, 4),
        ("at", 5, 3, micros(early), micros(late)),
        ("b", 5, 2, 1, 1),
        ("day", 5, 3, -1, days),
        ("zone", 5, 2, zone, zone),
    ]
    assert rows(footers.stored_bounds(spark, table, ["b"])) == [("b", 5, 2, 1, 1)]
    for column in ("day", "at"):
        assert rows(footers.stored_days(spark, table, column)) == [(early.date(), late.date())]


def test_columns_behind_a_nested_one_are_refused(spark, tmp_path):
    shape = "a bigint, pair struct<x: bigint, y: bigint>, b bigint"
    spark.createDataFrame([(1, (2, 3), 4)], shape).write.parquet(f"{tmp_path}/n")
    assert rows(footers.stored_bounds(spark, f"{tmp_path}/n")) == [("a", 1, 1, 1, 1)]
    with pytest.raises(ValueError, match="b"):
        footers.stored_bounds(spark, f"{tmp_path}/n", ["b"])


def test_a_file_without_any_value_is_scanned(spark, table):
    before = sorted(rows(footers.stored_bounds(spark, table)))
    spark.createDataFrame([(None,) * 7], KINDS).write.mode("append").parquet(table)  # 96-bit times
    assert rows(footers.stored_sizes(spark, {"t": table})) == [("t", 6, 7)]
    after = sorted(rows(footers.stored_bounds(spark, table)))
    assert after == [(name, n + 1, *rest) for name, n, *rest in before]


def test_columns_without_bounds_are_refused(spark, table):
    with pytest.raises(ValueError, match="name"):
        footers.stored_bounds(spark, table, ["a", "name"])
    with pytest.raises(ValueError, match="no columns"):
        footers.stored_bounds(spark, table, [])


def test_sizes(spark, table, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/none")
    found = footers.stored_sizes(spark, {"t": table, "none": f"{tmp_path}/none"})
    assert rows(found) == [("t", 5, 7), ("none", 0, 7)]
    empty = footers.stored_bounds(spark, f"{tmp_path}/none", ["a", "at"])
    assert rows(empty) == [("a", 0, 0, None, None), ("at", 0, 0, None, None)]
    assert rows(footers.stored_days(spark, f"{tmp_path}/none", "at")) == [(None, None)]


def test_the_other_source_is_used_only_here(spark, table):
    before = spark.conf.get(footers.V1_SOURCES)
    footers.stored(spark, table)
    assert spark.conf.get(footers.V1_SOURCES) == before
    plain = spark.read.parquet(table)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plain and "BatchScan" not in plain


@pytest.mark.parametrize("key", ["table_summary_stored", "stored_bounds", "date_bounds_stored"])
def test_no_column_is_read(spark, key):
    found = queries()[key](spark, SMALL)._jdf.queryExecution()
    text = found.executedPlan().toString()
    scans = [line for line in text.splitlines() if "BatchScan" in line]
    assert scans and "FileScan" not in text
    for line in scans:
        assert "PushedAggregation: [COUNT(*)" in line
