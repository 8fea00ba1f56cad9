"""Hand-made frames, one for each rule that decides a result."""

import datetime as dt

import pytest
from frames import rows

from patronage.functions.spans import calendar_year, closed_window, day_range
from patronage.functions.values import AGE_BINS, status_is
from patronage.operators import activation, overview, repeat, retention, revenue, sampling
from patronage.plans.cohorts import MONTH, cohort_cells, dense_cells
from patronage.registry.queries import queries
from pyspark.sql import functions as F

ITEM = "user_id bigint, order_id bigint, status string, created_at ts"


def day(text):
    return dt.date.fromisoformat(text)


def test_year_window_ends_at_midnight(frame):
    df = frame(
        "created_at ts",
        [("2023-12-31 00:00:00",), ("2023-12-31 10:00:00",), ("2024-01-01 00:00:00",), (None,)],
    )
    assert closed_window(df, "2023-01-01", "2023-12-31").count() == 1
    assert day_range(df, "2023-01-01", "2023-12-31").count() == 2
    assert calendar_year(df, 2023).count() == 2
    assert calendar_year(df, 2024).count() == 1


def test_status_rules(frame):
    df = frame(
        "status string",
        [("Complete",), (" complete ",), ("\tCOMPLETE\n",), ("COMPLETE",), (None,), ("nan",)],
    )
    found = [
        df.where(status_is(F.col("status"), "Complete", rule)).count()
        for rule in ("none", "lower", "trim_lower")
    ]
    assert found == [1, 2, 4]
    with pytest.raises(ValueError):
        status_is(F.col("status"), "Complete", "upper")


def test_age_bins(frame):
    ages = (0, 19, 20, 59, 60, 99, 100, -1, None)
    df = frame("age int", [(a,) for a in ages])
    labels = [r[0] for r in rows(df.select(AGE_BINS.name(AGE_BINS.position("age"))))]
    assert labels == ["<20", "<20", "20s", "50s", "60+", "60+", None, None, None]
    assert df.where(AGE_BINS.within("age")).count() == 6
    assert df.where(AGE_BINS.within("age", ["20s", "60+"])).count() == 3
    assert df.where(AGE_BINS.within("age", [])).count() == 0


VISITS = [
    (1, 1, "Complete", "2023-01-05 10:00:00"),
    (1, 2, "Complete", "2023-03-09 10:00:00"),
    (1, 3, "Complete", "2023-03-10 10:00:00"),
    (2, 4, "Complete", "2023-02-01 00:00:00"),
    (3, 5, "Returned", "2023-05-01 00:00:00"),
    (None, 6, "Complete", "2023-06-01 00:00:00"),
]


def test_sparse_cells_are_the_observed_ones(frame):
    found = rows(retention.cohort_monthly_sparse(frame(ITEM, VISITS)))
    assert sorted(found) == [
        (day("2023-01-01"), 0, 1, 1, 1.0),
        (day("2023-01-01"), 2, 1, 1, 1.0),
        (day("2023-02-01"), 0, 1, 1, 1.0),
    ]


def test_dense_cells_fill_up_to_the_horizon(frame):
    cells = dense_cells(frame(ITEM, VISITS).where("status = 'Complete'"), MONTH, 2)
    found = sorted((str(r.cohort)[:7], r.age, r.active_users) for r in cells.collect())
    assert found == [
        ("2023-01", 0, 1),
        ("2023-01", 1, 0),
        ("2023-01", 2, 1),
        ("2023-02", 0, 1),
        ("2023-02", 1, 0),
    ]


def test_dense_agrees_with_sparse_where_seen(frame):
    items = frame(ITEM, VISITS).where("status = 'Complete'")
    seen = {(r.cohort, r.age, r.active_users) for r in cohort_cells(items, MONTH).collect()}
    filled = dense_cells(items, MONTH, 12).where("active_users > 0").collect()
    assert {(r.cohort, r.age, r.active_users) for r in filled} == seen


def test_first_purchase_is_the_first_in_range(frame):
    items = frame(ITEM, VISITS)
    found = rows(retention.cohort_monthly_sparse(items, "2023-03-01", "2023-03-09"))
    assert found == [(day("2023-03-01"), 0, 1, 1, 1.0)]


def test_weekly_cohort_month_is_the_mondays(frame):
    items = frame(ITEM, [(1, 1, "complete", "2023-01-01 12:00:00")])
    assert retention.cohort_weekly_dense(items, "2023-01").count() == 0
    found = rows(retention.cohort_weekly_dense(items, "2022-12", 4))
    assert found == [
        (day("2022-12-26"), 2764, "2022-12 W4 (2022-W52) · N=1", 0, 1, 1, 1.0)
    ]
    months = rows(overview.cohort_months_weekly(items))
    assert [m[1] for m in months] == ["2022-12"]


def test_daily_cohort_takes_the_week_from_its_monday(frame):
    items = frame(ITEM, [(1, 1, "Complete", "1995-02-01 08:00:00")])
    assert retention.cohort_daily_dense(items, "1995-02", 1).count() == 0
    found = rows(retention.cohort_daily_dense(items, "1995-02", 5))
    assert found == [(day("1995-02-01"), "1995-02-01 (Wed, W5) · N=1", 0, 1, 1, 1.0)]


def test_pivot_keeps_cohorts_and_columns_nobody_reached(frame):
    cells = retention.cohort_monthly_dense(frame(ITEM, VISITS), 3)
    wide = retention.cohort_pivot(cells, range(1, 4))
    assert wide.columns == ["cohort_month", "cohort_label", "m1", "m2", "m3"]
    assert sorted(r[1:] for r in rows(wide)) == [
        ("2023-01 · N=1", 0.0, 1.0, None),
        ("2023-02 · N=1", 0.0, None, None),
    ]


def test_exposure_counts_a_cohort_once_per_day_seen(frame):
    # three buyers on Monday 2 January; one comes back on Tuesday, two on Saturday
    items = frame(
        ITEM,
        [(u, u, "COMPLETE", "2023-01-02 09:00:00") for u in (1, 2, 3)]
        + [(1, 9, "Complete", "2023-01-03 09:00:00")]
        + [(u, 10 + u, "Complete", "2023-01-07 23:59:59") for u in (2, 3)],
    )
    span = ("2023-01-01", "2023-01-07")
    by_order = rows(repeat.repeat_by_order_weekday(items, *span))
    assert [r[1] for r in by_order] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert [r[2:] for r in by_order if r[3]] == [(1, 3, 1 / 3), (2, 3, 2 / 3)]
    assert all(r[4] is None for r in by_order if not r[3])
    by_cohort = rows(repeat.repeat_by_cohort_weekday(items, *span))
    assert by_cohort[0][2:] == (3, 6, 0.5)
    groups = rows(repeat.repeat_weekday_vs_weekend(items, *span))
    assert sorted(groups) == [("weekday", 1, 3, 33.333), ("weekend", 2, 3, 66.667)]
    assert repeat.repeat_by_order_weekday(items, "2023-01-02", "2023-01-02").count() == 0


def test_repeat_purchasers_know_earlier_years(frame):
    items = frame(
        ITEM,
        [
            (1, 1, "Complete", "2022-12-01 00:00:00"),
            (1, 2, "Complete", "2023-01-01 00:00:00"),
            (1, 3, "Complete", "2023-01-09 00:00:00"),
            (2, 4, "Complete", "2023-01-01 00:00:00"),
            (2, 5, " complete", "2023-11-01 00:00:00"),
        ],
    )
    monthly = repeat.repeat_purchaser_monthly(items, 2023)
    assert rows(monthly) == [
        (day("2023-01-01"), 1, 2, 0.5, 0.5),
        (day("2023-11-01"), 1, 1, 1.0, 1.0),
    ]
    assert sorted(rows(repeat.repeat_rate_by_season(monthly))) == [
        ("jan_oct", 1, 2, 50.0),
        ("nov_dec", 1, 1, 100.0),
    ]


def shop_frames(frame, buyers=11, age=30, source="Search"):
    users = frame(
        "id bigint, created_at ts, gender string, age int, traffic_source string",
        [(u, "2023-01-01 00:00:00", "F", age, source) for u in range(buyers)],
    )
    products = frame(
        "id bigint, category string, brand string, name string",
        [(1, "Jeans", "Acme", "blue"), (2, "Jeans", None, "grey"), (3, None, "Acme", "red")],
    )
    orders = frame(
        "order_id bigint, user_id bigint, status string, created_at ts",
        [(u, u, "Complete", "2023-02-01 00:00:00") for u in range(buyers)],
    )
    items = frame(
        "order_id bigint, user_id bigint, product_id bigint, status string, sale_price money,"
        " created_at ts",
        [
            (u, u, p, "Complete", f"{u + 1}.50", "2023-03-01 00:00:00")
            for u in range(buyers)
            for p in (1, 2, 3)
        ],
    )
    return users, orders, items, products


@pytest.mark.parametrize("buyers, top, revenue_top", [(1, 1, 1.5), (10, 1, 10.5), (11, 2, 22.0)])
def test_top_share(frame, buyers, top, revenue_top):
    scope = revenue.revenue_scope(*shop_frames(frame, buyers))
    (found,) = revenue.top_revenue_share(scope).collect()
    total = sum(u + 1.5 for u in range(buyers))
    assert (found.top_count, float(found.top_revenue)) == (top, revenue_top)
    assert float(found.total_revenue) == total
    assert found.share_pct == pytest.approx(revenue_top / total * 100)


def test_unknown_brand_and_category_fall_out_without_a_choice(frame):
    scope = revenue.revenue_scope(*shop_frames(frame, 3))
    assert {r.product_id for r in scope.items.collect()} == {1}


@pytest.mark.parametrize("hole", [{"age": None}, {"age": 100}, {"source": None}])
def test_unknown_age_or_source_leaves_zeros(frame, hole):
    scope = revenue.revenue_scope(*shop_frames(frame, 3, **hole))
    (kpis,) = revenue.revenue_kpis(scope).collect()
    assert [float(v) for v in kpis] == [0.0] * 7
    (share,) = revenue.top_revenue_share(scope).collect()
    assert [float(v) for v in share] == [0.0] * 4
    assert revenue.customer_revenue_histogram(scope).count() == 0


def test_kpis(frame):
    scope = revenue.revenue_scope(*shop_frames(frame, 4))
    (kpis,) = revenue.revenue_kpis(scope).collect()
    assert [float(v) for v in kpis] == [12.0, 4.0, 4.0, 4.0, 3.0, 3.0, 3.0]


def test_one_distinct_value_is_widened(frame):
    scope = revenue.revenue_scope(*shop_frames(frame, 1))
    bins = revenue.customer_revenue_histogram(scope, 4).collect()
    assert [r.users for r in bins] == [0, 0, 1, 0]
    assert (bins[0].lo, bins[-1].hi) == (1.0, 2.0)


def test_equal_sums_rank_by_name(frame):
    users, orders, items, _ = shop_frames(frame, 2)
    products = frame(
        "id bigint, category string, brand string, name string",
        [(1, "B", "x", "n"), (2, "A", "x", "n"), (3, "C", "x", "m")],
    )
    scope = revenue.revenue_scope(users, orders, items, products)
    assert [r.category for r in revenue.category_revenue_topk(scope, 2).collect()] == ["A", "B"]
    assert [r.name for r in revenue.product_revenue_topk(scope).collect()] == ["n", "m"]


USERS = "id bigint, created_at ts, gender string, age int, traffic_source string"
ORDERS = "order_id bigint, user_id bigint, status string, created_at ts"


def test_days_to_first_order_round_down(frame):
    users = frame(USERS, [(u, "2023-06-01 12:00:00", "F", 30, "Search") for u in (1, 2, 3)])
    orders = frame(
        ORDERS,
        [
            (1, 1, "Complete", "2023-06-01 11:00:00"),
            (2, 2, "Complete", "2023-06-01 13:00:00"),
            (3, 3, "Complete", "2023-06-02 13:00:00"),
            (4, 3, "Complete", "2023-06-09 13:00:00"),
            (5, 1, "Cancelled", "2023-05-01 00:00:00"),
        ],
    )
    days = activation.days_to_first(users, orders)
    assert sorted(rows(days)) == [(-1, 1), (0, 1), (1, 1)]
    (summary,) = rows(activation.ttfp_summary(users, orders))
    assert summary == (0.0, 0.0, -0.5, 0.5, 1)


def test_first_order_tie_goes_to_the_smaller_id(frame):
    users = frame(USERS, [(1, "2023-01-01 00:00:00", "F", 30, "Search")])
    orders = frame(
        ORDERS,
        [
            (8, 1, "Complete", "2023-06-01 11:00:00"),
            (7, 1, "Complete", "2023-06-01 11:00:00"),
            (9, 2, "Complete", "2023-06-01 11:00:00"),
        ],
    )
    (found,) = activation.first_order(users, orders).collect()
    assert (found.user_id, found.order_id) == (1, 7)


def test_no_users_have_no_rate(frame):
    users, orders = frame(USERS, []), frame(ORDERS, [])
    assert rows(activation.activation_kpis(users, orders)) == [(0, 0, None)]
    assert rows(activation.ttfp_summary(users, orders)) == [(None,) * 5]
    groups = rows(activation.activation_by_age_group(users, orders))
    assert [g[0] for g in groups] == list(AGE_BINS.labels)
    assert {g[1:] for g in groups} == {(0, 0, None)}


def test_every_month_has_every_age_group(frame):
    users = frame(
        USERS,
        [
            (1, "2023-01-09 00:00:00", "F", 30, "Search"),
            (2, "2023-01-10 00:00:00", "F", 10, "Search"),
            # nobody of February has a group, the month is there all the same
            (3, "2023-02-01 00:00:00", "F", None, "Search"),
        ],
    )
    orders = frame(ORDERS, [(1, 1, "Complete", "2023-06-01 11:00:00")])
    long = activation.activation_age_by_month(users, orders)
    found = {(r[0].month, r[1]): r[2:] for r in rows(long)}
    assert len(found) == 12
    assert found[1, "30s"] == (1, 1, 100.0)
    assert found[1, "<20"] == (1, 0, 0.0)
    assert found[1, "60+"] == found[2, "30s"] == (0, None, None)
    wide = activation.activation_age_pivot(long)
    assert wide.columns == ["signup_month", *AGE_BINS.labels]
    assert wide.count() == 2


def test_gender_alone_lets_unknowns_pass(frame):
    users = frame(
        USERS,
        [
            (1, "2023-01-09 00:00:00", None, 30, "Search"),
            (2, "2023-02-10 00:00:00", "F", 10, None),
        ],
    )
    assert [r.id for r in activation.signed_up(users).collect()] == [1]
    assert activation.signed_up(users, gender="F").count() == 0
    assert activation.signed_up(users, months=[2]).count() == 0
    assert rows(activation.activation_by(users, frame(ORDERS, []), "gender")) == [("F", 1, 0, 0.0)]


def test_first_basket(frame):
    users = frame(USERS, [(u, "2023-01-01 00:00:00", "F", 30, "Search") for u in (1, 2)])
    orders = frame(ORDERS, [(u, u, "Complete", "2023-06-01 11:00:00") for u in (1, 2)])
    items = frame(
        "order_id bigint, user_id bigint, product_id bigint, sale_price money",
        [(1, 1, 1, "10.00"), (1, 1, 1, "10.00"), (2, 2, 2, "40.01"), (2, 2, 3, "99"), (5, 2, 1, "7")],
    )
    products = frame(
        "id bigint, category string", [(1, "Jeans"), (2, "Socks"), (3, None)]
    )
    first = activation.first_order(users, orders)
    (basket,) = rows(activation.first_order_basket_value(first, items, products))
    assert basket == (pytest.approx(60.01 / 3), 10.0)
    (socks,) = rows(activation.first_order_basket_value(first, items, products, ["Socks"]))
    assert socks == (40.01, 40.01)
    top = rows(activation.first_order_top_categories(first, items, products, 5))
    assert top == [("Jeans", 1), ("Socks", 1)]


def test_purchase_counts(frame):
    items = frame(
        ITEM,
        VISITS + [(4, None, "Complete", "2023-01-01 00:00:00")],
    )
    assert rows(repeat.purchase_frequency(items)) == [(0, 1), (1, 1), (3, 1)]
    counts = repeat.purchase_counts_by_user(items)
    assert sorted(rows(counts)) == [(1, 3), (2, 1), (3, 1), (4, 0)]


def test_missing_column_is_named(frame):
    items = frame("user_id bigint, created_at ts", [(1, "2023-01-05 10:00:00")])
    with pytest.raises(ValueError, match="status"):
        retention.cohort_daily_dense(items, "2023-01")
    with pytest.raises(ValueError, match="created_at"):
        retention.cohort_monthly_dense(items.drop("created_at"))
    with pytest.raises(ValueError, match="user_id"):
        repeat.repeat_purchaser_monthly(items.drop("user_id"), 2023)
    # three analyses take a table without a status as it is
    assert retention.cohort_monthly_dense(items).count() == 1
    assert retention.cohort_weekly_month(items, "2023-01").count() == 1
    assert repeat.repeat_purchaser_monthly(items, 2023).count() == 1


def test_status_counts_and_sizes(frame):
    orders = frame(ORDERS, [(i, 1, s, None) for i, s in enumerate("BAAB") ] + [(9, 1, None, None)])
    assert rows(overview.status_counts(orders)) == [("A", 2), ("B", 2)]
    assert rows(overview.dimension_values(orders, "status")) == [("A",), ("B",)]
    assert overview.first_rows(orders).count() == 5
    assert rows(overview.table_summary({"orders": orders})) == [("orders", 5, 4)]


def test_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(5_000).withColumn("created_at", F.lit("2023-12-31 23:00:00").cast("timestamp"))
    one = sampling.sample_events(df, 2023, 300, 7)
    two = sampling.sample_events(df.repartition(13), 2023, 300, 7)
    ids = {r.id for r in one.collect()}
    assert len(ids) == 300 and ids == {r.id for r in two.collect()}
    assert ids != {r.id for r in sampling.sample_events(df, 2023, 300, 8).collect()}
    assert sampling.sample_events(df, 2023, 9_999).count() == 5_000
    assert sampling.sample_events(df, 2024, 10).count() == 0


@pytest.mark.parametrize("n", [1, 5, 30, 60, 61, 100])
def test_sample_of_copies_keeps_their_number(spark, n):
    # one row takes a third of the table
    df = spark.range(40).unionAll(spark.range(20).select(F.lit(7).cast("bigint").alias("id")))
    found = [r.id for r in sampling.sample_rows(df, n).collect()]
    assert len(found) == min(n, 60)
    assert all(found.count(i) <= (21 if i == 7 else 1) for i in set(found))


ITEMS = "order_id bigint,user_id bigint,status string,created_at ts"


def test_either_bound_alone(frame):
    items = frame(ITEMS, [(1, 1, "Complete", "2022-05-01"), (2, 2, "Complete", "2023-05-01"),
                          (3, 3, "Complete", None)])
    months = lambda **span: sorted(
        str(r[0])[:4] for r in retention.cohort_monthly_sparse(items, **span).collect()
    )
    assert months() == ["2022", "2023"]
    assert months(start="2023-01-01") == ["2023"]
    assert months(end="2022-12-31") == ["2022"]


@pytest.mark.parametrize("fraction, count, brought", [(0.1, 1, 30), (1.0, 2, 46), (1.5, 2, 46)])
def test_fractions_up_to_all(frame, fraction, count, brought):
    users = frame("id bigint,created_at ts,gender string,age int,traffic_source string",
                  [(i, "2023-01-01", "F", 30, "Search") for i in (1, 2)])
    orders = frame(ITEMS, [(i, i, "Complete", "2023-01-02") for i in (1, 2)])
    items = frame("order_id bigint,user_id bigint,product_id bigint,sale_price money,created_at ts",
                  [(1, 1, 1, 30, "2023-01-02"), (2, 2, 1, 16, "2023-01-02")])
    products = frame("id bigint,category string,brand string,name string", [(1, "c", "b", "n")])
    scope = revenue.revenue_scope(users, orders, items, products)
    (row,) = revenue.top_revenue_share(scope, fraction).collect()
    found = (row.top_count, float(row.top_revenue), float(row.total_revenue))
    assert found == (count, brought, 46)


def test_a_kept_scope_gives_the_same(spark, frame, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    users = frame("id bigint,created_at ts,gender string,age int,traffic_source string",
                  [(1, "2023-01-01", "F", 30, "Search")])
    orders = frame(ITEMS, [(1, 1, "Complete", "2023-01-02")])
    items = frame("order_id bigint,user_id bigint,product_id bigint,sale_price money,created_at ts",
                  [(1, 1, 1, 30, "2023-01-02")])
    products = frame("id bigint,category string,brand string,name string", [(1, "c", "b", "n")])
    scope = revenue.revenue_scope(users, orders, items, products)
    kept = scope.kept()
    for analysis in (revenue.revenue_kpis, revenue.product_revenue_topk):
        assert rows(analysis(kept)) == rows(analysis(scope))


def test_plain_keys_take_rows_of_any_date(spark, tmp_path):
    """Orders of 1990, 2005, 2023 and without a date count wherever the date is not asked for."""
    dates = ["1990-01-05", "2005-06-07", "2023-12-31 23:59:59", None]
    keys = range(len(dates))
    write = lambda name, df: df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write("orders", spark.createDataFrame(
        [(k, k, "F", 1.0, d, "x") for k, d in zip(keys, dates)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate string, o_orderpriority string",
    ).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")))
    write("lineitem", spark.createDataFrame(
        [(k, 1, 1, 1, 1.0, 5.0, 0.0, 0.0, "N", "F") for k in keys],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string",
    ).withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz")))
    run = lambda key: queries()[key](spark, str(tmp_path)).collect()
    assert run("purchase_frequency")[0].users == 4
    assert run("status_counts")[0].orders == 4
    assert [str(r.cohort_month)[:4] for r in sorted(run("cohort_monthly_sparse"))] == ["1990", "2005", "2023"]
    assert len(run("cohort_pivot")) == 3 and len(run("available_months")) == 3
    (bounds,) = run("date_bounds")
    assert (bounds.first_day.year, bounds.last_day.year) == (1990, 2023)
