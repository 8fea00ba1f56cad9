"""Revenue of a filtered scope: totals, months, customers, categories and products.

Each analysis first brings the scope to the grain it needs, with partial sums on the map
side, and only then joins or counts, so hot users and products arrive already summed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import calendar as cal
from patronage.functions.values import (
    AGE_BINS,
    Bins,
    in_list_or_known,
    ratio,
    ratio_or_zero,
    shorten,
)
from patronage.operators.repeat import frequency, orders_per_user
from patronage.plans.histogram import equal_width_histogram
from patronage.plans.keys import top_k
from patronage.plans.ranks import count_values, pick_ranks
from patronage.sources.store import keep

MONEY_SUM = "decimal(38,2)"


@dataclass(frozen=True)
class Filters:
    """The choices of the revenue report; None stands for no choice."""

    months: Sequence[int] | None = None
    statuses: Sequence[str] = ("Complete",)
    gender: str | None = None
    age_groups: Sequence[str] | None = None
    traffic_sources: Sequence[str] | None = None
    categories: Sequence[str] | None = None
    brands: Sequence[str] | None = None
    age_bins: Bins = AGE_BINS


@dataclass(frozen=True)
class Scope:
    """What passes the filters: users, products, and the items of kept orders.

    `ordered` is not yet cut to the kept products and users. An analysis sums it up to the grain
    it needs, joins the products and asks for the buyers in scope, so that a hot product or user
    is summed before that join.
    """

    ordered: DataFrame
    users: DataFrame
    products: DataFrame

    @property
    def items(self) -> DataFrame:
        """The items that pass every filter, row by row."""
        return self.by_kept_users(self.sold)

    @property
    def sold(self) -> DataFrame:
        """Items of kept orders and products."""
        ids = self.products.select(F.col("id").alias("product_id"))
        return self.ordered.join(ids, "product_id", "left_semi")

    def sums(self, *keys: str | Column, attribute: str | None = None) -> DataFrame:
        """`revenue` per product and `keys` of what is sold, summed before the product join.

        With an `attribute`, the product's comes along, for one join instead of two.
        """
        summed = self.ordered.groupBy("product_id", *keys).agg(money().alias("revenue"))
        if attribute is None:
            ids = self.products.select(F.col("id").alias("product_id"))
            return summed.join(ids, "product_id", "left_semi")
        known = self.products.where(F.col(attribute).isNotNull())
        return summed.join(known.select(F.col("id").alias("product_id"), attribute), "product_id")

    def kept(self) -> Scope:
        """The same scope with its parts written once, for callers of several analyses.

        The parts go to the folder of spark.checkpoint.dir, which all executors reach.
        """
        return Scope(*map(keep, (self.ordered, self.users, self.products)))

    def by_kept_users(self, df: DataFrame) -> DataFrame:
        """Rows of kept users, for frames where one user may have many rows.

        In a sort-merge join Spark can split the partition of a hot user.
        """
        ids = self.users.select(F.col("id").alias("user_id"))
        return df.join(ids, "user_id", "left_semi")

    def sums_of_kept_users(self, df: DataFrame) -> DataFrame:
        """The same for sums with few rows per user.

        Spark moves a semi join below the sums when it takes the users for small. An inner join
        with distinct ids stays above them, so items are always summed before the shuffle.
        """
        ids = self.users.select(F.col("id").alias("user_id")).distinct()
        return df.join(ids, "user_id")


def revenue_scope(
    users: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    filters: Filters = Filters(),
) -> Scope:
    """Apply the report's filters.

    Without a choice, unknown age groups, sources, categories and brands still fall out;
    gender alone lets nulls pass. Users are those given, so sales to anyone who signed up
    outside the period are not in scope.
    """
    f = filters
    kept_orders = orders.where(F.col("status").isin(list(f.statuses)))
    if f.months is not None:
        kept_orders = kept_orders.where(F.month("created_at").isin(list(f.months)))
    kept_users = users.where(
        f.age_bins.within("age", f.age_groups)
        & in_list_or_known(F.col("traffic_source"), f.traffic_sources)
    )
    if f.gender is not None:
        kept_users = kept_users.where(F.col("gender") == f.gender)
    kept_products = products.where(
        in_list_or_known(F.col("category"), f.categories)
        & in_list_or_known(F.col("brand"), f.brands)
    )
    # Broadcast or sort-merge is left to Spark, which goes by the measured size of each side
    # and splits a hot key's partition in the sort-merge case.
    ordered = items.join(kept_orders.select("order_id"), "order_id", "left_semi")
    return Scope(ordered, kept_users, kept_products)


def money(column: str = "sale_price") -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY_SUM)


def revenue_kpis(scope: Scope) -> DataFrame:
    """One row of totals and averages per user, per buyer and per order."""
    by_order = scope.sums("order_id", "user_id").groupBy("user_id", "order_id")
    kept = scope.by_kept_users(by_order.agg(money("revenue").alias("revenue")))
    # Each pair counts for its order and for its buyer. Two groups by one key, in one exchange:
    # a branch for each would repeat the joins, and two distinct counts would triple the rows.
    order = F.struct("order_id", F.lit(None).cast(kept.schema["user_id"].dataType).alias("user_id"))
    buyer = F.struct(F.lit(None).cast(kept.schema["order_id"].dataType).alias("order_id"), "user_id")
    zero = F.lit(0).cast(kept.schema["revenue"].dataType)
    sides = F.inline(
        F.array(
            F.struct(order.alias("of"), F.col("revenue").alias("revenue")),
            F.struct(buyer.alias("of"), zero.alias("revenue")),
        )
    )
    totals = (
        kept.select(sides)
        .groupBy("of.order_id", "of.user_id")
        .agg(money("revenue").alias("revenue"))
        .agg(
            money("revenue").alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            F.count("user_id").alias("purchasing_users"),
        )
        .withColumn("total_users", scope.users.agg(F.countDistinct("id")).scalar())
    )
    return with_averages(totals)


def with_averages(totals: DataFrame) -> DataFrame:
    """The totals with revenue per user, per buyer and per order."""
    revenue = F.col("total_revenue")
    return totals.select(
        "*",
        ratio_or_zero(revenue, F.col("total_users")).alias("arpu"),
        ratio_or_zero(revenue, F.col("purchasing_users")).alias("arppu"),
        ratio_or_zero(revenue, F.col("total_orders")).alias("aov"),
    )


def revenue_monthly(scope: Scope) -> DataFrame:
    """Revenue by the month of the item's own time."""
    month = cal.month_start(F.col("created_at")).alias("month")
    sums = scope.sums("user_id", month).where(F.col("month").isNotNull())
    by_user = sums.groupBy("user_id", "month").agg(money("revenue").alias("revenue"))
    return (
        scope.sums_of_kept_users(by_user)
        .groupBy("month")
        .agg(money("revenue").alias("revenue"))
        .orderBy("month")
    )


def order_frequency(scope: Scope) -> DataFrame:
    """Users in scope per number of orders."""
    return frequency(scope.sums_of_kept_users(orders_per_user(scope.sums("order_id", "user_id"))))


def user_revenue(scope: Scope) -> DataFrame:
    by_user = scope.sums("user_id").where(F.col("user_id").isNotNull()).groupBy("user_id")
    return scope.sums_of_kept_users(by_user.agg(money("revenue").alias("revenue")))


def top_revenue_share(scope: Scope, fraction: float = 0.10) -> DataFrame:
    """What the best-paying fraction of the buyers brings in: at least one buyer, at most all."""
    cents = (F.col("revenue") * 100).cast("bigint")
    counts = count_values(user_revenue(scope), cents)

    # The k-th largest revenue; all above it belong to the top, and as many equal to it as
    # are needed to make up k.
    k = f"least(total_n, greatest(1L, CAST(ceil(total_n * {float(fraction)}D) AS BIGINT)))"
    above_n = "(total_n - below_n - value_n)"
    above = "(total_sum - below_sum - CAST(value AS DECIMAL(38,0)) * value_n)"
    picked = pick_ranks(counts, {"top": f"total_n - {k} + 1"}).selectExpr(
        f"{k} AS k", f"{above} + value * ({k} - {above_n}) AS top_cents", "total_sum AS cents"
    )
    # no buyers leave no pick: one row of zeros then
    whole = picked.agg(
        F.expr("coalesce(max(k), 0L) AS top_count"),
        F.expr(f"CAST(coalesce(max(top_cents), 0) / 100 AS {MONEY_SUM}) AS top_revenue"),
        F.expr(f"CAST(coalesce(max(cents), 0) / 100 AS {MONEY_SUM}) AS total_revenue"),
    )
    share = ratio_or_zero(F.col("top_revenue"), F.col("total_revenue")) * 100
    return whole.withColumn("share_pct", share)


def customer_revenue_histogram(scope: Scope, bins: int = 15) -> DataFrame:
    """Buyers by revenue, in bins of equal width."""
    revenue = F.col("revenue").alias("v")
    counts = user_revenue(scope).groupBy(revenue).agg(F.count("*").alias("n"))
    return equal_width_histogram(counts, bins)


def _revenue_by(scope: Scope, attribute: str) -> DataFrame:
    by_user = scope.sums("user_id", attribute=attribute).groupBy("user_id", attribute)
    kept = scope.sums_of_kept_users(by_user.agg(money("revenue").alias("revenue")))
    return kept.groupBy(attribute).agg(money("revenue").alias("revenue"))


def labelled_top(df: DataFrame, k: int, by: str, key: str) -> DataFrame:
    return top_k(df, k, by, key).withColumn("label", shorten(F.col(key)))


def category_revenue_topk(scope: Scope, k: int = 10) -> DataFrame:
    return labelled_top(_revenue_by(scope, "category"), k, "revenue", "category")


def category_aov_topk(scope: Scope, k: int = 10) -> DataFrame:
    """Revenue per distinct order within a category."""
    by_category = (
        scope.by_kept_users(scope.sums("order_id", "user_id", attribute="category"))
        .groupBy("category", "order_id")
        .agg(money("revenue").alias("revenue"))
        .groupBy("category")
        .agg(ratio(money("revenue"), F.count("order_id")).alias("aov"))
    )
    return labelled_top(by_category.where(F.col("aov").isNotNull()), k, "aov", "category")


def product_revenue_topk(scope: Scope, k: int = 10) -> DataFrame:
    """Revenue by product name; products of one name count together."""
    return labelled_top(_revenue_by(scope, "name"), k, "revenue", "name")
