"""Canonical tables: the columns and types every operator is written against."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        ("id", T.LongType()),
        ("created_at", T.TimestampType()),
        ("gender", T.StringType()),
        ("age", T.IntegerType()),
        ("traffic_source", T.StringType()),
    ),
    "products": _struct(
        ("id", T.LongType()),
        ("category", T.StringType()),
        ("brand", T.StringType()),
        ("name", T.StringType()),
    ),
    "orders": _struct(
        ("order_id", T.LongType()),
        ("user_id", T.LongType()),
        ("status", T.StringType()),
        ("created_at", T.TimestampType()),
        ("shipped_at", T.TimestampType()),
        ("delivered_at", T.TimestampType()),
        ("returned_at", T.TimestampType()),
    ),
    "order_items": _struct(
        ("order_id", T.LongType()),
        ("user_id", T.LongType()),
        ("product_id", T.LongType()),
        ("inventory_item_id", T.LongType()),
        ("status", T.StringType()),
        ("sale_price", MONEY),
        ("created_at", T.TimestampType()),
        ("shipped_at", T.TimestampType()),
        ("delivered_at", T.TimestampType()),
        ("returned_at", T.TimestampType()),
    ),
    "events": _struct(
        ("id", T.LongType()),
        ("user_id", T.LongType()),
        ("session_id", T.StringType()),
        ("event_type", T.StringType()),
        ("created_at", T.TimestampType()),
    ),
    "inventory_items": _struct(
        ("id", T.LongType()),
        ("product_id", T.LongType()),
        ("product_distribution_center_id", T.LongType()),
        ("created_at", T.TimestampType()),
        ("sold_at", T.TimestampType()),
    ),
}

# Columns without which no analysis on the table makes sense; the others may be absent.
REQUIRED: dict[str, tuple[str, ...]] = {
    "users": ("id", "created_at"),
    "products": ("id",),
    "orders": ("order_id", "user_id", "status", "created_at"),
    "order_items": ("order_id", "user_id", "created_at"),
    "events": ("created_at",),
    "inventory_items": ("product_id", "created_at"),
}


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """Return `df` unchanged, or raise naming the columns it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the required column(s): {', '.join(missing)}")
    return df
