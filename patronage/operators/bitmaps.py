"""Distinct users under any filter, from bitmaps of users for each value of each dimension.

Users get numbers without gaps within buckets of some ten thousand, and each value of a dimension has a
bitmap of its users for each bucket. The index is made in one pass for all dimensions and kept. How
many users a choice has is then counted in the bitmaps that it combines, exactly, without users or
orders: values of one dimension by or, several dimensions by and.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.values import percent

BITS = 32_768  # of a bitmap
BUCKET_USERS = 16_384  # on average, so that one bitmap nearly always does
EVERYONE = "everyone"
PLACE = ("bucket", "page")


def numbered(users: DataFrame) -> DataFrame:
    """The users with a place: `bucket`, `page` and `bit`. Rows that repeat an id share one."""
    ids = users.select("id").where("id IS NOT NULL").distinct()
    buckets = max(1, -(-ids.count() // BUCKET_USERS))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    placed = ids.select("id", bucket).select(
        "id",
        "bucket",
        F.call_function("div", nth, F.lit(BITS)).cast("int").alias("page"),
        (nth % BITS).cast("bigint").alias("bit"),
    )
    return users.join(placed, "id")


def index_users(users: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """`dimension`, `value`, `bucket`, `page`, `bits`: who has which value, one pass for all.

    Values are text; a user without a value is in none of that dimension's bitmaps. Everyone is
    in that of `EVERYONE`. A bitmap holds 4 KB however many rows its users have, so the largest
    group is a bitmap, never a value's users.
    """
    pairs = [F.struct(F.lit(EVERYONE).alias("dimension"), F.lit("").alias("value"))]
    pairs += [
        F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
        for name, value in dimensions.items()
    ]
    held = numbered(users).select(*PLACE, "bit", F.inline(F.array(*pairs)))
    return (
        held.where("value IS NOT NULL")
        .groupBy("dimension", "value", *PLACE)
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def chosen(index: DataFrame, dimension: str, values: Sequence[str] | None = None) -> DataFrame:
    """`bucket`, `page`, `bits` of the users with any of the values; no choice: with any at all."""
    rows = index.where(F.col("dimension") == dimension)
    if values is not None:
        rows = rows.where(F.col("value").isin(list(values)))
    return rows.groupBy(*PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of `left` with only those bits that `right`, one row a place, has too."""
    keys = [c for c in left.columns if c != "bits"]
    two = left.join(right.select(*PLACE, F.col("bits").alias("other")), list(PLACE))
    each = two.select(*keys, F.explode(F.array("bits", "other")).alias("bits"))
    return each.groupBy(*keys).agg(F.bitmap_and_agg("bits").alias("bits"))


def by_dimension(index: DataFrame, *dimensions: str) -> DataFrame:
    """A row of bits for each combination of values that has users, a column for each dimension."""

    def one(name: str) -> DataFrame:
        rows = index.where(F.col("dimension") == name)
        return rows.select(F.col("value").alias(name), *PLACE, "bits")

    def cross(left: DataFrame, name: str) -> DataFrame:
        keys = [c for c in left.columns if c not in ("bits", *PLACE)]
        two = left.join(one(name).withColumnRenamed("bits", "other"), list(PLACE))
        each = two.select(*keys, name, *PLACE, F.explode(F.array("bits", "other")).alias("bits"))
        return each.groupBy(*keys, name, *PLACE).agg(F.bitmap_and_agg("bits").alias("bits"))

    return reduce(cross, dimensions[1:], one(dimensions[0]))


def count_users(bits: DataFrame, *keys: str, name: str = "users") -> DataFrame:
    return bits.groupBy(*keys).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name)
    )


def rates(
    index: DataFrame,
    dimensions: Sequence[str],
    hits: DataFrame,
    within: Sequence[DataFrame] = (),
) -> DataFrame:
    """Users of each combination of values, how many of them are in `hits`, and the rate.

    `within` are further choices, all of which count. Combinations without users do not appear.
    """
    rows = by_dimension(index, *dimensions)
    for choice in within:
        rows = both(rows, choice)
    totals = count_users(rows, *dimensions, name="total_users").where("total_users > 0")
    hit = count_users(both(rows, hits), *dimensions, name="activated_users")
    found = totals.join(hit, list(dimensions), "left").select(
        *dimensions, "total_users", F.coalesce("activated_users", F.lit(0)).alias("activated_users")
    )
    return found.withColumn(
        "activation_rate", percent(F.col("activated_users"), F.col("total_users"))
    )
