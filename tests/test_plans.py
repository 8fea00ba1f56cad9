"""What the plans must and must not contain, and how a hot key is dealt with."""

import re

import pytest
from frames import rows
from pyspark.sql import functions as F

from patronage.operators import activation, repeat, retention, revenue
from patronage.plans.cohorts import MONTH, dense_cells
from patronage.registry.queries import queries

SMALL = "/root/testdata/sf0.001"
KEYS = sorted(queries())
# Windows over everything that see a bounded number of rows: blocks of values, hash heads,
# a cohort grid, seven weekdays.
BOUNDED = re.compile(r"AS total_n|upto|AS horizon|exposed")


def plan_of(df):
    """The plan with whole filter lists."""
    spark = df.sparkSession
    key = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def nodes(text, name):
    return [line for line in text.splitlines() if re.search(rf"(?<![A-Za-z]){name}\b", line)]


@pytest.mark.parametrize("key", KEYS)
def test_no_python_no_products_no_wide_windows(spark, key):
    text = plan_of(queries()[key](spark, SMALL))
    for banned in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RDDScan"):
        assert banned not in text
    for line in nodes(text, "Window"):
        # Window [expressions], [partition keys], [order], the last two only if there are any
        found = re.search(r"\](?:, \[([^\]]*)\])?(?:, \[([^\]]*)\])?$", line)
        keys = found.group(1)
        partitioned = keys is not None and not re.search(r" (ASC|DESC)\b", keys)
        assert partitioned or BOUNDED.search(line), line


def test_only_needed_columns_and_dates_reach_the_scan(spark):
    text = plan_of(queries()["cohort_monthly_sparse"](spark, SMALL))
    assert any("ReadSchema: struct<l_orderkey:bigint>" in x for x in nodes(text, "FileScan"))
    assert "EqualTo(o_orderstatus,F)" in text
    dated = plan_of(queries()["cohort_monthly_dense_1995"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01" in dated
    text = plan_of(queries()["revenue_kpis"](spark, SMALL))
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in text and "LessThan(c_acctbal,10000.0)" in text


def test_unused_lookup_join_is_left_out(spark):
    assert "n_nationkey" not in plan_of(queries()["activation_monthly"](spark, SMALL))
    assert "n_nationkey" in plan_of(queries()["activation_by_gender"](spark, SMALL))


def test_one_scan_for_cohorts(spark):
    text = plan_of(queries()["cohort_daily_dense_evt"](spark, SMALL))
    assert len(nodes(text, "FileScan")) == 1
    assert not nodes(text, r"\w*Join")


@pytest.fixture
def unbroadcast(spark):
    """Settings of a table too large to broadcast, at test size."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of all items belong to one buyer, one product and one order."""
    folder = tmp_path_factory.mktemp("hot")
    third = F.expr("id % 3 = 0")
    items = spark.range(0, 300_000, 1, 12).select(
        F.when(third, 1).otherwise(F.col("id") % 20_011).alias("order_id"),
        F.when(third, 5).otherwise(F.col("id") % 5_003).alias("user_id"),
        F.when(third, 3).otherwise(F.col("id") % 907).alias("product_id"),
        F.lit("Complete").alias("status"),
        ((F.col("id") % 9_973 + 1) / 100).cast("decimal(18,2)").alias("sale_price"),
        F.expr("timestamp'2023-01-01' + make_interval(0,0,0,id % 364)").alias("created_at"),
    )
    orders = spark.range(20_011).selectExpr(
        "id AS order_id", "id % 5003 AS user_id", "'Complete' AS status",
        "timestamp'2023-01-01' + make_interval(0,0,0,id % 364) AS created_at",
    )
    users = spark.range(5_003).selectExpr(
        "id", "timestamp'2023-01-01' AS created_at", "'F' AS gender", "30 AS age",
        "'Search' AS traffic_source",
    )
    products = spark.range(907).selectExpr(
        "id", "concat('c', id % 12) AS category", "'b' AS brand", "concat('n', id % 100) AS name"
    )
    found = {}
    for name, df in dict(items=items, orders=orders, users=users, products=products).items():
        df.write.parquet(f"{folder}/{name}")
        found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def scope_of(t):
    return revenue.revenue_scope(t["users"], t["orders"], t["items"], t["products"])


def test_hot_partitions_are_split(unbroadcast, hot):
    items = scope_of(hot).items
    total = items.agg(F.count("*"), F.sum("sale_price"))
    (found,) = rows(total)
    text = plan_of(total)
    assert text.count("SortMergeJoin(skew=true)") >= 3
    assert found == rows(hot["items"].agg(F.count("*"), F.sum("sale_price")))[0]


ANALYSES = {
    "revenue_kpis": lambda t: revenue.revenue_kpis(scope_of(t)),
    "revenue_monthly": lambda t: revenue.revenue_monthly(scope_of(t)),
    "order_frequency": lambda t: revenue.order_frequency(scope_of(t)),
    "top_revenue_share": lambda t: revenue.top_revenue_share(scope_of(t)),
    "customer_revenue_histogram": lambda t: revenue.customer_revenue_histogram(scope_of(t)),
    "category_revenue_topk": lambda t: revenue.category_revenue_topk(scope_of(t)),
    "category_aov_topk": lambda t: revenue.category_aov_topk(scope_of(t)),
    "product_revenue_topk": lambda t: revenue.product_revenue_topk(scope_of(t)),
    "cohort_by_category": lambda t: retention.cohort_monthly_by_category(
        t["items"], t["products"], "c3"
    ),
    "cohort_dense": lambda t: retention.cohort_monthly_dense(t["items"]),
    "purchase_frequency": lambda t: repeat.purchase_frequency(t["items"]),
    "first_order_basket": lambda t: activation.first_order_basket_value(
        activation.first_order(t["users"], t["orders"]), t["items"], t["products"]
    ),
    "ttfp_histogram": lambda t: activation.ttfp_histogram(t["users"], t["orders"]),
}


@pytest.mark.parametrize("name", ANALYSES)
def test_results_do_not_turn_on_the_join_strategy(spark, hot, name):
    plain = sorted(rows(ANALYSES[name](hot)), key=str)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "7",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        assert sorted(rows(ANALYSES[name](hot)), key=str) == plain
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_user_is_summed_before_the_user_join(unbroadcast, hot):
    """Of 300 000 items, the hot buyer's third arrives at the join as a few rows."""
    df = revenue.revenue_monthly(scope_of(hot))
    text = plan_of(df)
    join = text.index("SortMergeJoin [user_id")
    below = text[join:]
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L?, \d+\)", below)
    assert below.index("partial_sum(sale_price") > below.index("Exchange hashpartitioning")
    assert "sum(sale_price" in below


def test_cohort_rows_collapse_before_the_shuffle(spark, hot):
    text = plan_of(dense_cells(hot["items"], MONTH, 12))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert re.search(r"hashpartitioning\(user_id#\d+L?, period#\d+", exchanges[-1])
    assert "HashAggregate(keys=[user_id" in text.split(exchanges[-1])[1]


def test_orders_and_buyers_are_counted_without_expand(unbroadcast, hot):
    text = plan_of(revenue.revenue_kpis(scope_of(hot)))
    assert not nodes(text, "Expand")


@pytest.mark.parametrize("name", ["revenue_kpis", "revenue_monthly", "category_revenue_topk", "category_aov_topk"])
def test_items_are_summed_below_the_product_join(unbroadcast, hot, name):
    text = plan_of(ANALYSES[name](hot))
    join = text.index("SortMergeJoin [product_id")
    assert "partial_sum(sale_price" in text[join:]
    assert "partial_sum(sale_price" not in text[:join]


@pytest.mark.parametrize("key", ["date_bounds", "available_months", "purchase_frequency"])
def test_existence_needs_only_distinct_line_keys(spark, key):
    text = plan_of(queries()[key](spark, SMALL))
    assert "l_partkey" not in text and re.search(r"HashAggregate\(keys=\[order_id", text)


def test_sampled_rows_are_not_ranked_in_one_task(spark):
    text = plan_of(queries()["sample_events_50k"](spark, SMALL))
    windows = [line for line in text.splitlines() if re.search(r"(?<!Group)\bWindow\b", line)]
    assert windows
    for line in windows:  # over hash heads, or within one of them
        assert "_copies" not in line or re.search(r"\], \[_head#\d+\]", line)
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text
