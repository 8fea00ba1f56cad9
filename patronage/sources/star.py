"""Canonical views over a star schema (orders, line items, customers, parts) and an event log.

A view reads only the tables an analysis asks for. It keeps the source's time type, so that time
filters reach the Parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.spans import Day, closed_window
from patronage.functions.values import Bins
from patronage.schemas import MONEY

# The star schema has no age; the account balance takes its place, with its own bins.
BALANCE_BINS = Bins(
    (0, 2000, 4000, 6000, 8000, 10000),
    ("0-2k", "2k-4k", "4k-6k", "6k-8k", "8k-10k"),
)

# Declared, so that no job has to look into the files for them.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


class OrderShop:
    """Shop view. A user signs up with the first order of any status.

    With a `span`, every dated table is cut to that closed window; products carry no date.
    `item_time="l_shipdate"` gives items a time of their own, unlike their order's.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        span: tuple[Day, Day] | None = None,
        item_time: str = "o_orderdate",
    ) -> None:
        self._spark = spark
        self._base = base
        self._span = span
        self._item_time = item_time

    def _read(self, table: str) -> DataFrame:
        reader = self._spark.read.schema(STAR_SCHEMAS[table])
        return reader.parquet(f"{self._base}/{table}.parquet")

    def _within(self, df: DataFrame) -> DataFrame:
        return closed_window(df, *self._span) if self._span else df

    def _customers(self) -> DataFrame:
        # Grouped by nation, the names are known to be unique: where no analysis asks for them,
        # Spark leaves the join out.
        regions = (
            self._read("nation")
            .join(self._read("region"), F.expr("n_regionkey = r_regionkey"), "left")
            .groupBy("n_nationkey")
            .agg(F.max("r_name").alias("gender"))
        )
        return (
            self._read("customer")
            .join(regions, F.expr("c_nationkey = n_nationkey"), "left")
            .selectExpr(
                "c_custkey AS id", "gender", "c_acctbal AS age", "c_mktsegment AS traffic_source"
            )
        )

    def _signups(self) -> DataFrame:
        return (
            self._read("orders")
            .where("o_custkey IS NOT NULL")
            .groupBy(F.expr("o_custkey AS id"))
            .agg(F.expr("min(o_orderdate) AS created_at"))
        )

    @cached_property
    def users(self) -> DataFrame:
        return self._within(self._signups()).join(self._customers(), "id", "left")

    @cached_property
    def products(self) -> DataFrame:
        return self._read("part").selectExpr(
            "p_partkey AS id", "p_type AS category", "p_brand AS brand", "p_name AS name"
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._within(
            self._read("orders").selectExpr(
                "o_orderkey AS order_id",
                "o_custkey AS user_id",
                "o_orderstatus AS status",
                "o_orderdate AS created_at",
            )
        )

    @cached_property
    def orders_with_gaps(self) -> DataFrame:
        """Orders with two more columns, each unknown for some."""
        return self._within(
            self._read("orders").selectExpr(
                "o_orderkey AS order_id",
                "o_custkey AS user_id",
                "o_orderstatus AS status",
                "o_orderdate AS created_at",
                "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority",
                "CASE WHEN o_orderkey % 7 > 4 THEN o_totalprice END AS total",
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        lines = self._read("lineitem")
        orders = self._read("orders")
        return self._within(
            lines.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
                "l_orderkey AS order_id",
                "o_custkey AS user_id",
                "l_partkey AS product_id",
                "o_orderstatus AS status",
                f"CAST(l_extendedprice AS {MONEY.simpleString()}) AS sale_price",
                f"{self._item_time} AS created_at",
                "l_shipdate AS shipped_at",
            )
        )

    @cached_property
    def orders_with_items(self) -> DataFrame:
        """What `order_items` says of who ordered when, one row an order.

        Enough for analyses that count users, orders or periods. Line items come as distinct keys,
        deduplicated before the shuffle. That shuffle is the join's too: a broadcast would need
        another one.
        """
        keys = self._read("lineitem").selectExpr("l_orderkey AS order_id").distinct().hint("merge")
        return self.orders.join(keys, "order_id", "left_semi")

    def raw(self, table: str) -> DataFrame:
        """A table as it is stored, with all its columns."""
        return self._spark.read.parquet(f"{self._base}/{table}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._within(
            self._read("events").selectExpr(
                "event_id AS id", "user_id", "event_type", "ts AS created_at", "value"
            )
        )

    @cached_property
    def raw_events(self) -> DataFrame:
        """The events as an export has them: all text, with gaps, and here and there a wrong value."""
        return self._read("events").selectExpr(
            "CAST(event_id AS STRING) AS id",
            "CASE WHEN event_id % 11 > 0 THEN CAST(user_id AS STRING) END AS user_id",
            "concat(' ', CAST(CAST(value AS DECIMAL(18,2)) AS STRING)) AS amount",
            "concat(CAST(CAST(value AS DECIMAL(18,1)) AS STRING), 'e-1') AS ratio",
            "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS created_at",
            "CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE CAST(event_id % 7 AS STRING) END"
            " AS score",
            "CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(event_id AS STRING) END AS note",
            "CAST(NULL AS STRING) AS remark",
        )

    @cached_property
    def inventory_items(self) -> DataFrame:
        return self._within(
            self._read("lineitem").selectExpr(
                "l_partkey AS product_id",
                "l_suppkey AS product_distribution_center_id",
                "l_shipdate AS created_at",
            )
        )


class EventShop(OrderShop):
    """Event view with times inside the day: sign-up events are users, purchases are orders."""

    def _signups(self) -> DataFrame:
        return (
            self._read("events")
            .where("event_type = 'signup' AND user_id IS NOT NULL")
            .groupBy(F.expr("user_id AS id"))
            .agg(F.expr("min(ts) AS created_at"))
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.events.where(F.col("event_type") == "purchase").selectExpr(
            "id AS order_id",
            "user_id",
            "'Complete' AS status",
            f"CAST(value AS {MONEY.simpleString()}) AS sale_price",
            "created_at",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.order_items.select("order_id", "user_id", "status", "created_at")

    @cached_property
    def orders_with_items(self) -> DataFrame:
        return self.orders
