"""One entry per analysis, over the whole tables of a folder.

The plain keys take all rows, whatever their dates. Keys ending in `_1995` run the same analysis in
a one-year window, where earlier and later rows fall out as the analysis demands. Keys
ending in `_evt` use the event view, which has times within the day.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.operators import activation as act
from patronage.operators import bitmaps
from patronage.operators import cube as cub
from patronage.operators import overview as ovw
from patronage.operators import repeat as rep
from patronage.operators import retention as ret
from patronage.operators import revenue as rev
from patronage.operators import sampling as smp
from patronage.operators.cohort_state import CohortState
from patronage.plans.cohorts import DAY, MONTH, WEEK, named
from patronage.session import configure
from patronage.sources import footers, inference, store, tables
from patronage.sources.star import BALANCE_BINS, EventShop, OrderShop

Query = Callable[[SparkSession, str], DataFrame]

YEAR_1995 = ("1995-01-01", "1995-12-31")
YEAR_1996 = ("1996-01-01", "1996-12-31")
COMPLETE = "F"
DONE = (COMPLETE,)
SAMPLE_ROWS = 1_000
SAMPLE_ROWS_LARGE = 50_000


def published(df: DataFrame) -> DataFrame:
    """Decimals as doubles and doubles to six digits, as the SQL side has them."""

    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return F.round(column, 6).alias(field.name)
        return column

    return df.select(*map(shown, df.schema.fields))


def _shop(span: tuple[str, str] | None = None, item_time: str = "o_orderdate"):
    def shop(spark: SparkSession, base: str) -> OrderShop:
        return OrderShop(configure(spark), base, span, item_time)

    return shop


def _event_log(spark: SparkSession, base: str) -> EventShop:
    return EventShop(configure(spark), base)


def _query(shop, analysis: Callable[[OrderShop], DataFrame]) -> Query:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return published(analysis(shop(spark, base)))

    return run


def scope_of(s: OrderShop, **choices) -> rev.Scope:
    filters = rev.Filters(statuses=DONE, age_bins=BALANCE_BINS, **choices)
    return rev.revenue_scope(s.users, s.orders, s.order_items, s.products, filters)


CHOSEN = dict(
    months=(1, 2, 3, 4, 5, 6),
    gender="ASIA",
    age_groups=("0-2k", "4k-6k"),
    traffic_sources=("BUILDING", "MACHINERY"),
    categories=("MEDIUM", "SMALL", "ECONOMY"),
    brands=("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"),
)
ACTIVATION_CHOICE = dict(
    gender="ASIA", traffic_sources=("BUILDING", "MACHINERY"), months=(1, 2, 3)
)


def _monthly(s: OrderShop) -> DataFrame:
    return rep.repeat_purchaser_monthly(s.orders_with_items, 1996, COMPLETE)


def _users(s: OrderShop, **choices) -> DataFrame:
    return act.signed_up(s.users, **choices)


def _first(s: OrderShop) -> DataFrame:
    return act.first_order(_users(s), s.orders, DONE)


def _cohort_pivot(s: OrderShop) -> DataFrame:
    """The matrix of all ages as text, a row for each cohort."""
    matrix = ret.cohort_matrix(ret.cohort_monthly_sparse(s.orders_with_items, status=COMPLETE))
    shown = F.transform(
        "retention",
        lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.format_string("%.6f", F.round(x, 6))),
    )
    return matrix.withColumn("retention", F.array_join(shown, " "))


TABLES = ("customer", "orders", "lineitem", "events", "part")


def _stored_sizes(spark: SparkSession, base: str) -> DataFrame:
    paths = {name: f"{base}/{name}.parquet" for name in TABLES}
    return footers.stored_sizes(configure(spark), paths)


def _stored_bounds(spark: SparkSession, base: str) -> DataFrame:
    configure(spark)
    bounds = [
        footers.stored_bounds(spark, f"{base}/{name}.parquet").select(
            F.lit(name).alias("table_name"), "*"
        )
        for name in TABLES
    ]
    return reduce(DataFrame.unionAll, bounds)


def _dimension_values(s: OrderShop) -> DataFrame:
    sources = (
        (s.orders, "status"),
        (s.users, "traffic_source"),
        (s.products, "category"),
        (s.products, "brand"),
    )
    listed = [
        ovw.dimension_values(df, column).select(F.lit(column).alias("dimension"), "value")
        for df, column in sources
    ]
    return reduce(DataFrame.unionAll, listed)


TOLERANCE = 0.05
POINTS = 100
SPLITS = 4
BUCKETS = 8
SKETCHED = {"all": (None, None), "1995": ("1995-01-01", "1995-12-01"), "late": ("1996-06-01", None)}


def _inferred(s: OrderShop) -> DataFrame:
    found = inference.infer_types(s.raw_events, TOLERANCE)
    return found.withColumn("column_name", F.col("column")).drop("column")


def _typed_events(s: OrderShop) -> DataFrame:
    """What the export's columns add up to, once parsed in the types found for them.

    The sums are cast, since the columns of an empty export are text.
    """
    raw = s.raw_events
    typed = inference.parse(raw, inference.types_of(inference.infer_types(raw, TOLERANCE)))
    return typed.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("id").alias("ids"),
        F.sum("user_id").cast("bigint").alias("user_sum"),
        F.sum("amount").cast("double").alias("amount"),
        F.sum("ratio").cast("double").alias("ratio"),
        F.sum("score").cast("bigint").alias("score"),
        F.count("note").alias("notes"),
    )


def _through_csv(s: OrderShop) -> DataFrame:
    """The export written as CSV and loaded as the canonical table; columns without a place go."""
    spark = s.raw_events.sparkSession
    path = store.new_path(spark, "events-csv")
    kind = F.col("note").alias("event_type")
    tables.write_csv(s.raw_events.select("id", "user_id", "amount", "created_at", kind), path)
    loaded = tables.load_table(spark, path, "events", "csv")
    return loaded.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def _ttfp_sketch(s: OrderShop) -> DataFrame:
    """From one kept table of monthly summaries, the quantiles of several ranges of months."""
    kept = store.keep(act.ttfp_summaries(_users(s), s.orders, DONE, POINTS, SPLITS))
    found = []
    for name, (first, last) in SKETCHED.items():
        some = kept
        if first:
            some = some.where(F.col("signup_month") >= F.lit(first).cast("date"))
        if last:
            some = some.where(F.col("signup_month") <= F.lit(last).cast("date"))
        found.append(act.ttfp_sketch(some, POINTS).withColumn("months", F.lit(name)))
    return reduce(DataFrame.unionAll, found)


INDEXED = ("gender", "traffic_source", "age_group", "signup_month")


def _bitmap_rates(s: OrderShop) -> DataFrame:
    """Users and buyers by each dimension, from one kept index."""
    index = store.keep(act.activation_index(_users(s), s.orders, BALANCE_BINS, DONE))
    hits = bitmaps.chosen(index, "activated")
    found = [
        bitmaps.rates(index, [name], hits)
        .withColumnRenamed(name, "value")
        .withColumn("dimension", F.lit(name))
        for name in (bitmaps.EVERYONE, *INDEXED)
    ]
    return reduce(DataFrame.unionByName, found)


def _bitmap_choice(s: OrderShop) -> DataFrame:
    """Months by age group among the users of some sources and one gender."""
    index = store.keep(act.activation_index(_users(s), s.orders, BALANCE_BINS, DONE))
    hits = bitmaps.chosen(index, "activated")
    within = [
        bitmaps.chosen(index, "traffic_source", ACTIVATION_CHOICE["traffic_sources"]),
        bitmaps.chosen(index, "gender", [ACTIVATION_CHOICE["gender"]]),
    ]
    return bitmaps.rates(index, ["signup_month", "age_group"], hits, within)


def _clustered(df: DataFrame, user: str, *order: str) -> store.ByUser:
    path = store.new_path(df.sparkSession, "clustered")
    return store.write_clustered(df, path, user, BUCKETS, order)


def _clustered_orders(s: OrderShop) -> store.ByUser:
    return _clustered(s.orders_with_items, "user_id", "created_at", "order_id")


def _clustered_orders_any(s: OrderShop) -> store.ByUser:
    return _clustered(s.orders, "user_id", "created_at", "order_id")


def _clustered_users(s: OrderShop) -> DataFrame:
    (users,) = store.parts_of(_clustered(s.users, "id"))  # one row a user: none is heavy
    return users


def _report(s: OrderShop) -> DataFrame:
    """Several figures of the revenue report from one scope, written once."""
    scope = scope_of(s).kept()
    kpis = rev.revenue_kpis(scope).select(
        F.lit("revenue").alias("figure"), F.col("total_revenue").cast("double").alias("amount")
    )
    months = rev.revenue_monthly(scope).select(
        F.date_format("month", "yyyy-MM"), F.col("revenue").cast("double")
    )
    categories = rev.category_revenue_topk(scope, 10).select(
        "category", F.col("revenue").cast("double")
    )
    return kpis.unionAll(months).unionAll(categories)


def _cube(s: OrderShop) -> cub.RevenueCube:
    return cub.revenue_cube(s.users, s.orders, s.order_items, s.products, BALANCE_BINS).kept()


def _chosen_cube(s: OrderShop) -> cub.RevenueCube:
    return _cube(s).chosen(rev.Filters(statuses=DONE, age_bins=BALANCE_BINS, **CHOSEN))


def _cube_report(s: OrderShop) -> DataFrame:
    """Months and rankings of one choice and of none, from one kept cube."""
    cube = _cube(s)
    found = []
    for choice, more in (("none", {}), ("some", CHOSEN)):
        part = cube.chosen(rev.Filters(statuses=DONE, age_bins=BALANCE_BINS, **more))
        parts = {
            "month": cub.cube_monthly(part).select(F.date_format("month", "yyyy-MM"), "revenue"),
            "category": cub.cube_category_topk(part).select("category", "revenue"),
            "order value": cub.cube_category_aov_topk(part).select("category", "aov"),
            "product": cub.cube_product_topk(part).select("name", "revenue"),
        }
        found += [
            df.toDF("key", "amount").select(
                F.lit(choice).alias("choice"),
                F.lit(figure).alias("figure"),
                "key",
                F.col("amount").cast("double").alias("amount"),
            )
            for figure, df in parts.items()
        ]
    return reduce(DataFrame.unionAll, found)


STEPS = 4


def _cohort_steps(s: OrderShop) -> DataFrame:
    """Monthly cohorts from orders that come in steps, each with rows of all dates."""
    items = s.orders_with_items.where(F.col("status") == COMPLETE)
    spark = items.sparkSession
    state = CohortState(spark, store.new_path(spark, "cohorts"), MONTH).start()
    for step in range(1, STEPS + 1):
        state.advance(items.where(F.pmod("order_id", F.lit(STEPS)) == step - 1), step)
    return named(state.cells(), MONTH)


def _age_pivot(s: OrderShop) -> DataFrame:
    long = act.activation_age_by_month(_users(s), s.orders, BALANCE_BINS, DONE)
    return act.activation_age_pivot(long, BALANCE_BINS)


# Analyses of the shop view; each is registered for all dates.
SHOP: dict[str, Callable[[OrderShop], DataFrame]] = {
    "purchase_frequency": lambda s: rep.purchase_frequency(s.orders_with_items, COMPLETE),
    "purchase_counts_by_user": lambda s: rep.purchase_counts_by_user(
        s.orders_with_items, ("F", "O", "P")
    ),
    "cohort_monthly_sparse": lambda s: ret.cohort_monthly_sparse(
        s.orders_with_items, status=COMPLETE
    ),
    "cohort_monthly_from": lambda s: ret.cohort_monthly_sparse(
        s.orders_with_items, "1996-03-01", status=COMPLETE
    ),
    "cohort_monthly_by_category": lambda s: ret.cohort_monthly_by_category(
        s.order_items, s.products, "MEDIUM", COMPLETE
    ),
    "cohort_monthly_dense": lambda s: ret.cohort_monthly_dense(s.orders_with_items, 12, COMPLETE),
    "cohort_weekly_dense": lambda s: ret.cohort_weekly_dense(
        s.orders_with_items, "1995-02", 2, 52, COMPLETE
    ),
    "cohort_weekly_month": lambda s: ret.cohort_weekly_month(
        s.orders_with_items, "1995-02", 12, status=COMPLETE
    ),
    "cohort_daily_dense": lambda s: ret.cohort_daily_dense(
        s.orders_with_items, "1995-02", None, 60, COMPLETE
    ),
    "cohort_daily_dense_w5": lambda s: ret.cohort_daily_dense(
        s.orders_with_items, "1995-02", 5, 60, COMPLETE
    ),
    "cohort_pivot": _cohort_pivot,
    "cohort_pivot_dense": lambda s: ret.cohort_pivot(
        ret.cohort_monthly_dense(s.orders_with_items, 12, COMPLETE), range(1, 13)
    ),
    "cohort_pivot_weekly": lambda s: ret.cohort_pivot(
        ret.cohort_weekly_month(s.orders_with_items, "1995-02", 12, status=COMPLETE),
        range(1, 13),
        WEEK,
    ),
    "cohort_pivot_daily": lambda s: ret.cohort_pivot(
        ret.cohort_daily_dense(s.orders_with_items, "2001-07", None, 30, COMPLETE), range(1, 31), DAY
    ),
    "repeat_purchaser_monthly": _monthly,
    "repeat_rate_by_season": lambda s: rep.repeat_rate_by_season(_monthly(s)),
    "repeat_by_order_weekday": lambda s: rep.repeat_by_order_weekday(
        s.orders_with_items, status=COMPLETE
    ),
    "revenue_scope": lambda s: scope_of(s).items.select(
        "order_id", "user_id", "product_id", "sale_price", "created_at"
    ),
    "revenue_kpis": lambda s: rev.revenue_kpis(scope_of(s)),
    "revenue_monthly": lambda s: rev.revenue_monthly(scope_of(s)),
    "order_frequency": lambda s: rev.order_frequency(scope_of(s)),
    "top_decile_revenue_share": lambda s: rev.top_revenue_share(scope_of(s), 0.10),
    "customer_revenue_histogram": lambda s: rev.customer_revenue_histogram(scope_of(s), 15),
    "category_revenue_topk": lambda s: rev.category_revenue_topk(scope_of(s), 10),
    "category_aov_topk": lambda s: rev.category_aov_topk(scope_of(s), 10),
    "product_revenue_topk": lambda s: rev.product_revenue_topk(scope_of(s), 10),
    "activation_kpis": lambda s: act.activation_kpis(_users(s), s.orders, DONE),
    "ttfp_summary": lambda s: act.ttfp_summary(_users(s), s.orders, DONE),
    "activation_monthly": lambda s: act.activation_monthly(_users(s), s.orders, DONE),
    "activation_by_gender": lambda s: act.activation_by_gender(_users(s), s.orders, DONE),
    "activation_by_channel": lambda s: act.activation_by_channel(_users(s), s.orders, DONE),
    "activation_by_age_group": lambda s: act.activation_by_age_group(
        _users(s), s.orders, BALANCE_BINS, DONE
    ),
    "activation_age_by_month": lambda s: act.activation_age_by_month(
        _users(s), s.orders, BALANCE_BINS, DONE
    ),
    "activation_age_pivot": _age_pivot,
    "first_order": _first,
    "first_order_basket_value": lambda s: act.first_order_basket_value(
        _first(s), s.order_items, s.products
    ),
    "first_order_top_categories": lambda s: act.first_order_top_categories(
        _first(s), s.order_items, s.products, 5
    ),
    "ttfp_histogram": lambda s: act.ttfp_histogram(_users(s), s.orders, 20, DONE),
    "status_counts": lambda s: ovw.status_counts(s.orders),
    "dimension_values": _dimension_values,
    "available_months": lambda s: ovw.available_months(s.orders_with_items),
    "cohort_months_weekly": lambda s: ovw.cohort_months_weekly(s.orders_with_items),
    "date_bounds": lambda s: ovw.date_bounds(s.orders_with_items),
    "ttfp_sketch": _ttfp_sketch,
    "inferred_types": _inferred,
    "typed_events": _typed_events,
    "events_through_csv": _through_csv,
    "first_rows": lambda s: ovw.first_rows(s.raw("region"), 5),
    "revenue_report": _report,
    "revenue_cube": lambda s: cub.cube_by_value(_cube(s)),
    "revenue_cube_kpis": lambda s: cub.cube_kpis(_chosen_cube(s)),
    "revenue_cube_report": _cube_report,
    "cohort_monthly_steps": _cohort_steps,
    "activation_bitmaps": _bitmap_rates,
    "activation_bitmaps_chosen": _bitmap_choice,
    "first_known_per_user": lambda s: act.first_known_per_user(
        _users(s), s.orders_with_gaps, ["order_id", "priority", "total"], DONE
    ),
    "cohort_monthly_clustered": lambda s: ret.cohort_monthly_dense(
        _clustered_orders(s), 12, COMPLETE
    ),
    "activation_monthly_clustered": lambda s: act.activation_monthly(
        act.signed_up(_clustered_users(s)), _clustered_orders_any(s), DONE
    ),
}

# Those whose result turns on the window's edges, again for 1995 alone.
YEARLY = (
    "purchase_frequency",
    "cohort_monthly_dense",
    "revenue_kpis",
    "revenue_monthly",
    "top_decile_revenue_share",
    "customer_revenue_histogram",
    "activation_kpis",
    "ttfp_summary",
    "activation_monthly",
    "activation_by_gender",
    "activation_by_channel",
    "activation_by_age_group",
    "activation_age_by_month",
    "first_order",
    "first_order_basket_value",
    "first_order_top_categories",
    "ttfp_histogram",
)

# Analyses of the event view.
EVENT_LOG: dict[str, Callable[[OrderShop], DataFrame]] = {
    "cohort_weekly_dense_evt": lambda s: ret.cohort_weekly_dense(
        s.orders_with_items, "2024-01", None, 12
    ),
    "cohort_daily_dense_evt": lambda s: ret.cohort_daily_dense(s.orders_with_items, "2024-01", None, 30),
    "repeat_by_order_weekday_evt": lambda s: rep.repeat_by_order_weekday(
        s.orders_with_items
    ),
    "repeat_by_cohort_weekday": lambda s: rep.repeat_by_cohort_weekday(s.orders_with_items),
    "repeat_weekday_vs_weekend": lambda s: rep.repeat_weekday_vs_weekend(s.orders_with_items),
    "ttfp_summary_evt": lambda s: act.ttfp_summary(_users(s), s.orders),
    "ttfp_histogram_evt": lambda s: act.ttfp_histogram(_users(s), s.orders, 20),
}


def queries() -> dict[str, Query]:
    everything = _shop()
    found = {key: _query(everything, analysis) for key, analysis in SHOP.items()}
    found |= {f"{key}_1995": _query(_shop(YEAR_1995), SHOP[key]) for key in YEARLY}
    found |= {key: _query(_event_log, analysis) for key, analysis in EVENT_LOG.items()}
    # The order's month decides the scope, the item's own month the series.
    found["revenue_monthly_shipped"] = _query(
        _shop(None, "l_shipdate"), SHOP["revenue_monthly"]
    )
    found["revenue_kpis_chosen"] = _query(
        everything, lambda s: rev.revenue_kpis(scope_of(s, **CHOSEN))
    )
    found["activation_kpis_chosen"] = _query(
        everything,
        lambda s: act.activation_kpis(_users(s, **ACTIVATION_CHOICE), s.orders, DONE),
    )
    # Users who signed up before the year have left the scope by then.
    found["revenue_kpis_1996"] = _query(_shop(YEAR_1996), SHOP["revenue_kpis"])
    found["sample_events"] = _query(
        _shop(),
        lambda s: smp.sample_events(s.events, 2024, SAMPLE_ROWS, 42, ["id"]),
    )
    found["sample_events_50k"] = _query(
        _shop(),
        lambda s: smp.sample_events(s.events, 2024, SAMPLE_ROWS_LARGE, 42, ["id"]),
    )
    # Table sizes are those of the tables as they are stored.
    found["table_summary"] = _query(
        _shop(), lambda s: ovw.table_summary({name: s.raw(name) for name in TABLES})
    )
    found["table_summary_stored"] = _stored_sizes
    found["stored_bounds"] = _stored_bounds
    found["date_bounds_stored"] = lambda spark, base: footers.stored_days(
        configure(spark), f"{base}/orders.parquet", "o_orderdate"
    )
    return found
