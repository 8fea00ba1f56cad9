"""Cohorts moved on step by step, and revenue of any choice from one cube."""

import datetime as dt
import itertools
import random
import re

import pytest
from frames import rows
from pyspark.sql import functions as F

from patronage.functions.values import AGE_BINS, Bins
from patronage.operators import cube as cub
from patronage.operators import revenue as rev
from patronage.operators.cohort_state import CohortState
from patronage.plans.cohorts import DAY, MONTH, WEEK, cohort_cells


def day(n: int) -> dt.datetime:
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=n, hours=n % 24)


ITEMS = "user_id bigint, created_at timestamp_ntz, day int"


@pytest.mark.parametrize("grain", [MONTH, WEEK, DAY], ids=lambda g: g.name)
def test_any_order_of_steps(spark, tmp_path, grain):
    draw = random.Random(3)
    # one user has a third of the rows; some rows lack the user or the time
    made = [(draw.choice([1, draw.randrange(2, 30), draw.randrange(2, 30)]), draw.randrange(200)) for _ in range(400)]
    made = [(user, day(n), n % 4) for user, n in made] + [(None, day(1), 0), (5, None, 2)]
    items = spark.createDataFrame(made, ITEMS)
    whole = sorted(rows(cohort_cells(items, grain)))
    for order in itertools.islice(itertools.permutations(range(4)), 0, 24, 9):
        state = CohortState(spark, str(tmp_path / f"{grain.name}{order}"), grain).start()
        assert rows(state.cells()) == []
        for step, part in enumerate(order, 1):
            state.advance(items.where(f"day = {part}"), step)
        assert sorted(rows(state.cells())) == whole


def test_a_step_may_be_repeated(spark, tmp_path):
    items = spark.createDataFrame([(1, day(40), 1), (1, day(3), 2), (2, day(50), 2)], ITEMS)
    state = CohortState(spark, str(tmp_path / "s"), MONTH).start()
    state.advance(items.where("day = 1"), 1)
    state.advance(items.where("day = 1"), 2)  # nothing new
    state.advance(items.where("day = 2 AND user_id = 1"), 3)
    state.advance(items.where("day = 2"), 3)  # again, with more
    again = CohortState(spark, str(tmp_path / "s"), MONTH)  # from the folder alone
    assert sorted(rows(again.cells())) == sorted(rows(cohort_cells(items, MONTH)))
    with pytest.raises(ValueError):
        again.advance(items, 2)
    part = str(tmp_path / "s" / "pairs" / "step=4")
    spark.createDataFrame([(9, dt.date(2023, 1, 1))], "user_id bigint, period date").write.parquet(part)
    with pytest.raises(ValueError):  # as if step 4 had been stopped after its pairs
        again.advance(items, 5)
    again.advance(items, 4)
    assert sorted(rows(again.cells())) == sorted(rows(cohort_cells(items, MONTH)))


@pytest.fixture(scope="module")
def shop(spark):
    draw = random.Random(5)

    def one(*values):
        return draw.choice(values)

    users = [
        (n, one("F", "M", None), one(15, 25, 35, 59, 99, 100, None), one("Search", "Email", None))
        for n in range(60)
    ]
    orders = [
        (n - 40, one("Complete", "Shipped", None), one(None, *map(day, range(0, 300, 7))))
        for n in range(300)
    ]
    buyer = {order: one(0, draw.randrange(70), None) for order, *_ in orders}
    products = [(n, one("Hats", "Coats", None), one("A", "B", None), one("hat", "cap", None)) for n in range(25)]
    items = [
        (order, buyer[order], draw.randrange(30), one(None, draw.randrange(1, 9000) / 100), when)
        for order, _, when in (orders[draw.randrange(300)] for _ in range(1500))
    ]
    frame = spark.createDataFrame
    return (
        frame(users, "id bigint, gender string, age int, traffic_source string"),
        frame(orders, "order_id bigint, status string, created_at timestamp_ntz"),
        frame(items, "order_id bigint, user_id bigint, product_id bigint, sale_price double,"
              " created_at timestamp_ntz").withColumn("sale_price", cents()),
        frame(products, "id bigint, category string, brand string, name string"),
    )


def cents():
    return F.col("sale_price").cast("decimal(18,2)")


CHOICES = [
    rev.Filters(),
    rev.Filters(statuses=("Complete", "Shipped"), gender="F", months=(1, 2, 9)),
    rev.Filters(age_groups=("20s", "60+"), brands=("A",)),
    rev.Filters(traffic_sources=("Email",), categories=("Hats", "Coats")),
    rev.Filters(categories=("none such",)),
]


@pytest.mark.parametrize("filters", CHOICES)
def test_a_choice_of_the_cube_is_the_direct_result(spark, shop, filters, cube):
    scope, part = rev.revenue_scope(*shop, filters), cube.chosen(filters)
    pairs = [
        (rev.revenue_kpis, cub.cube_kpis),
        (rev.revenue_monthly, cub.cube_monthly),
        (rev.category_revenue_topk, cub.cube_category_topk),
        (rev.category_aov_topk, cub.cube_category_aov_topk),
        (rev.product_revenue_topk, cub.cube_product_topk),
    ]
    for direct, kept in pairs:
        theirs, ours = direct(scope), kept(part)
        assert rows(ours.select(theirs.columns)) == rows(theirs)


@pytest.fixture(scope="module")
def cube(shop):
    return cub.revenue_cube(*shop, AGE_BINS).kept()


def test_other_age_groups_are_refused(cube):
    with pytest.raises(ValueError):
        cube.chosen(rev.Filters(age_bins=Bins((0, 1), ("x",))))


def test_a_choice_reads_the_cube_alone(spark, cube):
    plan = cub.cube_kpis(cube.chosen(CHOICES[1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "product_id" not in plan and "order_id" not in plan


@pytest.mark.parametrize("rows_a_task", [1 << 18, 2])
def test_the_cube_counts_in_tasks_of_bounded_size(monkeypatch, cube, rows_a_task):
    monkeypatch.setattr(cub, "ROWS_A_TASK", rows_a_task, raising=False)
    values = cub.cube_by_value(cube)
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    size = 1 + cube.members.count() // rows_a_task
    # Nothing that a task sorts whole: bits are joined in words, in as many tasks as the cube asks for.
    assert "bitmap_construct_agg" not in plan
    dealt = re.findall(r"RepartitionByExpression \[word#\d+L?\], (\d+)", plan)
    assert dealt == [str(size)] * 2 and (size > 20 or rows_a_task > 2)
    whole = cub.cube_by_value(cub.RevenueCube(cube.cells, cube.members, cube.users, AGE_BINS))
    assert sorted(rows(values)) == sorted(rows(whole)) != []
    ids = cube.members.where("kind = 'buyer'").selectExpr(
        "status", "page", "explode(bits) AS bit"
    )
    want = {r["status"]: r["n"] for r in ids.groupBy("status").agg(F.countDistinct("page", "bit").alias("n")).collect()}
    got = {r["value"]: r["buyers"] for r in values.where("dimension = 'status'").collect()}
    assert got == want


@pytest.mark.parametrize("words, most", [(1 << 17, 1 << 63), (0, 1)])
def test_the_cube_moves_numbers_instead_of_names(monkeypatch, spark, shop, cube, words, most):
    # With few rows sent to all tasks and cells too many for one number, the results are the same.
    monkeypatch.setattr(cub, "BROADCAST_WORDS", words, raising=False)
    monkeypatch.setattr(cub, "LONG", most, raising=False)
    own = cub.revenue_cube(*shop, AGE_BINS).kept()
    values = cub.cube_by_value(own)
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    moved = re.findall(r"RepartitionByExpression \[word#.*\n.*?Project \[(.*)\]", plan)
    assert len(moved) == 2 and not any(d in m for m in moved for d in cub.DIMENSIONS)
    whole = cub.RevenueCube(own.cells, own.members, own.users, AGE_BINS)
    for other in (cube, whole):
        assert sorted(rows(values)) == sorted(rows(cub.cube_by_value(other))) != []
    for filters in CHOICES:
        direct, part = rev.revenue_scope(*shop, filters), own.chosen(filters)
        want = rev.revenue_kpis(direct)
        assert rows(cub.cube_kpis(part).select(want.columns)) == rows(want)
        assert rows(cub.cube_product_topk(part)) == rows(rev.product_revenue_topk(direct))


def test_ids_far_apart_and_below_zero_keep_their_numbers(spark, shop):
    users, orders, items, products = shop
    apart = lambda c: (F.col(c) * 1_000_003 - 5_000_000).alias(c)
    moved = (
        users.withColumn("id", apart("id")),
        orders.withColumn("order_id", apart("order_id")),
        items.withColumns({c: apart(c) for c in ("order_id", "user_id", "product_id")}),
        products.withColumn("id", apart("id")),
    )
    want = cub.cube_by_value(cub.revenue_cube(*shop, AGE_BINS).kept())
    got = cub.cube_by_value(cub.revenue_cube(*moved, AGE_BINS).kept())
    assert sorted(rows(got)) == sorted(rows(want)) != []
