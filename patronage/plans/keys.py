"""Top rows and complete key sets over small grouped results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k rows with the largest `by`; equal ones in order of `tie`."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def complete_keys(df: DataFrame, key: str, size: int) -> DataFrame:
    """One row for each key 0..size-1, nulls where `df` has none.

    `df` is grouped by the key, so it has at most `size` rows and is safe to broadcast.
    """
    keys = df.sparkSession.range(0, size, 1, 1).select(F.col("id").cast("int").alias(key))
    return keys.join(F.broadcast(df), key, "left")
