"""A repeatable sample of exactly n events of one year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.spans import calendar_year
from patronage.sources.tables import parsed_time, write_csv

# 16**5 buckets by the head of the hash: the most rows the running count can see.
HEAD = 5


def sample_rows(
    df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None
) -> DataFrame:
    """The n rows with the smallest seeded hash, or all rows if there are fewer.

    The choice depends on the rows alone, not on how they are partitioned. The hash is cut to a
    head and counted per head; the running count over the heads tells in which bucket the sample
    ends. The buckets before it are taken as they are, by all tasks, and only the rows of that one
    are ranked, equal rows as one row with a count; so n may be of any size.
    """
    columns = df.columns
    parts = [F.col(c).cast("string") for c in (key or columns)]
    ticket = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    drawn = df.withColumn("_ticket", ticket).withColumn("_head", F.substring("_ticket", 1, HEAD))
    heads = drawn.groupBy("_head").agg(F.count("*").alias("rows"))
    running = F.sum("rows").over(Window.orderBy("_head"))
    reached = heads.select("_head", running.alias("upto"), "rows")
    end = F.min(F.struct("_head", (F.lit(n) - F.col("upto") + F.col("rows")).alias("room")))
    ends = reached.where(F.col("upto") >= n).agg(end.alias("end"))
    # "g" comes after every head, for when there are fewer than n rows
    last_head = ends.select(F.coalesce("end._head", F.lit("g"))).scalar()
    room = ends.select(F.coalesce("end.room", F.lit(0).cast("bigint"))).scalar()
    whole = drawn.where(F.col("_head") < last_head).select(*columns)

    order = ["_ticket", *columns]
    copies = drawn.where(F.col("_head") == last_head).groupBy("_head", *order)
    earlier = Window.partitionBy("_head").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ahead = F.coalesce(F.sum("_copies").over(earlier), F.lit(0))
    taken = copies.agg(F.count("*").alias("_copies")).withColumn(
        "_take", F.least(F.col("_copies"), room - ahead)
    )
    some = (
        taken.where(F.col("_take") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_take"))))
        .select(*columns)
    )
    return whole.unionAll(some)


def sample_events(
    events: DataFrame,
    year: int,
    n: int = 50_000,
    seed: int = 42,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly n events of a calendar year, its last day included, without replacement."""
    return sample_rows(calendar_year(events, year), n, seed, key)


def sample_events_job(
    raw_events: DataFrame, path: str, year: int, n: int = 50_000, seed: int = 42
) -> None:
    """Parse the time of the raw events, sample them and write all their columns as CSV."""
    time = F.col("created_at")
    if isinstance(raw_events.schema["created_at"].dataType, T.StringType):
        raw_events = raw_events.withColumn("created_at", parsed_time(time))
    write_csv(sample_events(raw_events, year, n, seed), path)
