"""From sign-up to the first completed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.functions.values import AGE_BINS, Bins, in_list_or_known, percent
from patronage.operators import bitmaps
from patronage.plans import sketch
from patronage.plans.histogram import equal_width_histogram
from patronage.plans.keys import complete_keys, top_k
from patronage.plans.ranks import count_values, merge_counts, quantile_summary
from patronage.sources.store import ByUser, parts_of

COMPLETE = ("Complete",)


def signed_up(
    users: DataFrame,
    gender: str | None = None,
    traffic_sources: Sequence[str] | None = None,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """The users of the report. Without a choice, an unknown source still falls out."""
    kept = users.where(in_list_or_known(F.col("traffic_source"), traffic_sources))
    if gender is not None:
        kept = kept.where(F.col("gender") == gender)
    if months is not None:
        kept = kept.where(F.month("created_at").isin(list(months)))
    return kept


def _bought(orders: DataFrame, statuses: Sequence[str]) -> DataFrame:
    wanted = F.col("status").isin(list(statuses))
    return orders.where(wanted & F.expr("user_id IS NOT NULL AND created_at IS NOT NULL"))


def first_order(
    users: DataFrame, orders: DataFrame, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """`user_id, order_id, created_at` of the first order of each of the given users.

    Of two orders at the same time the smaller id is first. The minimum per user is taken on
    the map side already, so no buyer is too large.
    """
    first = F.min(F.struct("created_at", "order_id")).alias("first")
    firsts = _bought(orders, statuses).groupBy("user_id").agg(first)
    ids = users.select(F.col("id").alias("user_id"))
    return firsts.select("user_id", "first.order_id", "first.created_at").join(
        ids, "user_id", "left_semi"
    )


def first_known_per_user(
    users: DataFrame,
    orders: DataFrame,
    columns: Sequence[str],
    statuses: Sequence[str] = COMPLETE,
) -> DataFrame:
    """`user_id` and, of each column, the first known value in the order of the user's orders.

    So the columns of a row may come from several orders, where the first has gaps. Orders at one
    time go by their id. One aggregate a column, taken on the map side already.
    """
    first = [
        F.expr(
            f"min_by(`{c}`, struct(created_at, order_id)) FILTER (WHERE `{c}` IS NOT NULL)"
        ).alias(c)
        for c in columns
    ]
    found = _bought(orders, statuses).groupBy("user_id").agg(*first)
    return found.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def activation_index(
    users: DataFrame,
    orders: ByUser,
    bins: Bins = AGE_BINS,
    statuses: Sequence[str] = COMPLETE,
) -> DataFrame:
    """Bitmaps of users by gender, traffic source, age group, sign-up month and activation.

    Kept once, it answers the totals and rates by any of them and by any choice of values
    (`operators.bitmaps`) without users or orders.
    """
    marked = _with_first(users, orders, statuses)
    return bitmaps.index_users(
        marked,
        {
            "gender": F.col("gender"),
            "traffic_source": F.col("traffic_source"),
            "age_group": bins.name(bins.position("age")),
            "signup_month": cal.month_label(F.col("created_at")),
            "activated": F.when(F.col("first_at").isNotNull(), F.lit("yes")),
        },
    )


def _with_first(users: DataFrame, orders: ByUser, statuses: Sequence[str]) -> DataFrame:
    """Users with `first_at`, null for those who never bought.

    Of orders in several frames that have no user in common, each meets the users for itself.
    """
    for turn, part in enumerate(parts_of(orders)):
        first = (
            _bought(part, statuses)
            .groupBy(F.col("user_id").alias("id"))
            .agg(F.min("created_at").alias("other_at" if turn else "first_at"))
        )
        users = users.join(first, "id", "left")
        if turn:
            known = F.coalesce("first_at", "other_at")
            users = users.withColumn("first_at", known).drop("other_at")
    return users


def activation_kpis(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """Users, buyers among them, and the rate; a null rate when there are no users."""
    people = users.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("created_at"))
    totals = _with_first(people, orders, statuses).agg(
        F.count("*").alias("total_users"), F.count("first_at").alias("activated_users")
    )
    return totals.withColumn(
        "activation_rate", percent(F.col("activated_users"), F.col("total_users"))
    )


def days_to_first(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """Whole days from sign-up to first order, counted: `v` days, `n` users."""
    met = _with_first(users, orders, statuses).where(F.col("first_at").isNotNull())
    return count_values(met, cal.elapsed_days(F.col("first_at"), F.col("created_at")))


def ttfp_summary(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """Mean, median, quartiles and maximum of the days to the first order.

    Exact: the percentiles run over day counts, of which there are only as many as days.
    """
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return (
        days_to_first(users, orders, statuses)
        .agg(
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_days"),
            quartiles.alias("q"),
            F.max("v").alias("max_days"),
        )
        .select(
            "mean_days",
            F.col("q")[1].alias("median_days"),
            F.col("q")[0].alias("q25_days"),
            F.col("q")[2].alias("q75_days"),
            "max_days",
        )
    )


def ttfp_summaries(
    users: DataFrame,
    orders: ByUser,
    statuses: Sequence[str] = COMPLETE,
    points: int = sketch.POINTS,
    splits: int = sketch.SPLITS,
) -> DataFrame:
    """Summaries of the days to the first order for each sign-up month, to be kept.

    `ttfp_sketch` of any choice of months then needs no orders. Users are dealt out by their id.
    """
    month = cal.month_start(F.col("created_at")).alias("signup_month")
    days = cal.elapsed_days(F.col("first_at"), F.col("created_at"))
    met = _with_first(users, orders, statuses).where(F.col("first_at").isNotNull())
    rows = met.select("id", month, days.alias("days"))
    return sketch.summarise(rows, F.col("days"), ["signup_month"], points, splits, F.col("id"))


def ttfp_sketch(summaries: DataFrame, points: int = sketch.POINTS) -> DataFrame:
    """Buyers, median and quartiles of the days to the first order, from summaries of months.

    `rank_error` is what the rank of any of them is off by at most, less than 1/points of the
    buyers and a few for each month. The maximum is exact.
    """
    wanted = {"median_days": 0.5, "q25_days": 0.25, "q75_days": 0.75, "max_days": 1.0}
    found = sketch.quantiles(summaries, wanted).drop("total_sum")
    off = sketch.rank_error(summaries, ["signup_month"], points)
    return found.withColumnRenamed("total_n", "buyers").withColumn("rank_error", off.scalar())


def ttfp_histogram(
    users: DataFrame, orders: ByUser, bins: int = 20, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """Buyers by days to the first order, in bins of equal width."""
    return equal_width_histogram(days_to_first(users, orders, statuses), bins)


def _rates(marked: DataFrame, *keys: str) -> DataFrame:
    return marked.groupBy(*keys).agg(
        F.countDistinct("id").alias("total_users"),
        F.count("first_at").alias("activated_users"),
    )


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "activation_rate", percent(F.col("activated_users"), F.col("total_users"))
    )


def activation_monthly(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """Users and buyers by month of sign-up."""
    month = cal.month_start(F.col("created_at"))
    marked = _with_first(users, orders, statuses).withColumn("signup_month", month)
    known = marked.where(F.col("signup_month").isNotNull())
    return _with_rate(_rates(known, "signup_month")).orderBy("signup_month")


def activation_by(
    users: DataFrame,
    orders: ByUser,
    dimension: str,
    statuses: Sequence[str] = COMPLETE,
    best_first: bool = True,
) -> DataFrame:
    """Users and buyers by any user attribute; unknown values left out."""
    known = users.where(F.col(dimension).isNotNull())
    rates = _with_rate(_rates(_with_first(known, orders, statuses), dimension))
    order = [F.col("activation_rate").desc()] if best_first else []
    return rates.orderBy(*order, dimension)


def activation_by_gender(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    return activation_by(users, orders, "gender", statuses, best_first=False)


def activation_by_channel(
    users: DataFrame, orders: ByUser, statuses: Sequence[str] = COMPLETE
) -> DataFrame:
    """By traffic source, the best rate first."""
    return activation_by(users, orders, "traffic_source", statuses)


def _binned(
    users: DataFrame, orders: ByUser, bins: Bins, statuses: Sequence[str]
) -> DataFrame:
    return _with_first(users, orders, statuses).withColumn("bin", bins.position("age"))


def activation_by_age_group(
    users: DataFrame,
    orders: ByUser,
    bins: Bins = AGE_BINS,
    statuses: Sequence[str] = COMPLETE,
) -> DataFrame:
    """Users and buyers by age group; every group is there, an empty one without a rate."""
    marked = _binned(users, orders, bins, statuses).where(F.col("bin").isNotNull())
    full = complete_keys(_rates(marked, "bin"), "bin", len(bins.labels)).select(
        "bin",
        bins.name(F.col("bin")).alias("age_group"),
        F.coalesce("total_users", F.lit(0)).alias("total_users"),
        F.coalesce("activated_users", F.lit(0)).alias("activated_users"),
    )
    return _with_rate(full).orderBy("bin").drop("bin")


def activation_age_by_month(
    users: DataFrame,
    orders: ByUser,
    bins: Bins = AGE_BINS,
    statuses: Sequence[str] = COMPLETE,
) -> DataFrame:
    """Every sign-up month with every age group; buyers and rate are null where no user is.

    Each month carries an array of its groups, so that the missing ones need no join.
    """
    month = cal.month_start(F.col("created_at"))
    marked = _binned(users, orders, bins, statuses).withColumn("signup_month", month)
    # Users without a group still make their month appear: they count under group -1.
    grouped = _rates(
        marked.where(F.col("signup_month").isNotNull()).withColumn(
            "bin", F.coalesce("bin", F.lit(-1))
        ),
        "signup_month",
        "bin",
    )
    first_of_month = F.row_number().over(Window.partitionBy("signup_month").orderBy("bin")) == 1
    blanks = F.array(
        *(
            F.struct(
                F.lit(i).alias("bin"),
                F.lit(0).cast("bigint").alias("total_users"),
                F.lit(None).cast("bigint").alias("activated_users"),
            )
            for i in range(len(bins.labels))
        )
    )
    itself = F.array(F.struct("bin", "total_users", "activated_users"))
    padded = grouped.withColumn("lead", first_of_month).select(
        "signup_month", F.inline(F.when(F.col("lead"), F.concat(itself, blanks)).otherwise(itself))
    )
    full = (
        padded.where(F.col("bin") >= 0)
        .groupBy("signup_month", "bin")
        .agg(
            F.sum("total_users").alias("total_users"),
            F.sum("activated_users").alias("activated_users"),
        )
        .withColumn("age_group", bins.name(F.col("bin")))
    )
    return (
        _with_rate(full)
        .orderBy("signup_month", "bin")
        .select("signup_month", "age_group", "total_users", "activated_users", "activation_rate")
    )


def activation_age_pivot(long: DataFrame, bins: Bins = AGE_BINS) -> DataFrame:
    """Sign-up month by age group matrix of the rate."""
    wide = long.groupBy("signup_month").pivot("age_group", list(bins.labels))
    return wide.agg(F.max("activation_rate"))


def _of_first_orders(first: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(first.select("order_id"), "order_id", "left_semi")


def _with_category(
    df: DataFrame, products: DataFrame, categories: Sequence[str] | None
) -> DataFrame:
    """Rows of products in the chosen categories; no choice means every known one."""
    chosen = products.where(in_list_or_known(F.col("category"), categories))
    return df.join(chosen.select(F.col("id").alias("product_id"), "category"), "product_id")


def first_order_basket_value(
    first: DataFrame, items: DataFrame, products: DataFrame, categories: Sequence[str] | None = None
) -> DataFrame:
    """Mean and median price of the items in first orders, both exact.

    Items are counted per product and price before they meet the products.
    """
    priced = _of_first_orders(first, items).where(F.col("sale_price").isNotNull())
    by_price = priced.groupBy("product_id", "sale_price").agg(F.count("*").alias("n"))
    cents = (F.col("sale_price") * 100).cast("bigint").alias("v")
    counts = merge_counts(_with_category(by_price, products, categories).select(cents, "n"))
    return quantile_summary(counts, {"median": 0.5}).selectExpr(
        "CAST(total_sum AS DOUBLE) / total_n / 100 AS mean_price", "median / 100 AS median_price"
    )


def first_order_top_categories(
    first: DataFrame,
    items: DataFrame,
    products: DataFrame,
    k: int = 5,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Categories by the number of users who have them in their first order."""
    bought = _of_first_orders(first, items).where(F.col("user_id").isNotNull())
    pairs = bought.select("user_id", "product_id").distinct()
    users = _with_category(pairs, products, categories).select("category", "user_id").distinct()
    counted = users.groupBy("category").agg(F.count("*").alias("users"))
    return top_k(counted, k, "users", "category")
