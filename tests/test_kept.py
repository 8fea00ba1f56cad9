"""Types found in text, kept summaries of quantiles, tables clustered by user."""

import bisect
import datetime as dt
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from patronage.operators import activation, bitmaps, repeat, retention
from patronage.plans import sketch
from patronage.plans.cohorts import MONTH, cohort_cells
from patronage.sources import inference, store
from patronage.sources.tables import write_csv


# ---- types


def inferred(spark, columns: dict[str, list], tolerance=0.0):
    names = list(columns)
    df = spark.createDataFrame(
        list(zip(*columns.values())), ", ".join(f"`{n}` string" for n in names)
    )
    found = inference.infer_types(df, tolerance).orderBy("place").collect()
    assert [r["column"] for r in found] == names
    return {r["column"]: (r["type"], r["nulls"], r["rejects"]) for r in found}, df


def test_the_narrowest_type_that_holds(spark):
    found, df = inferred(
        spark,
        {
            "a.b": ["1", "-20", None],
            "cents": ["0.5", "007.25", "-3"],
            "wide": ["1" * 30, "1." + "2" * 20, "3"],
            "power": ["1e3", "2", "-.5E-2"],
            "time": ["2024-01-31 10:00:00", "2024-02-01", "Feb 3, 2024"],
            "year": ["2024", "2023", "1999"],
            "name": ["1", "x", "2024-01-01"],
            "gone": [None, None, None],
            "longest": ["9" * 18, "9" * 19, "0"],
        },
    )
    assert found == {
        "a.b": ("bigint", 1, 0),
        "cents": ("decimal(3,2)", 0, 0),
        "wide": ("double", 0, 0),
        "power": ("double", 0, 0),
        "time": ("timestamp", 0, 0),
        "year": ("bigint", 0, 0),
        "name": ("string", 0, 0),
        "gone": ("string", 3, 0),
        "longest": ("decimal(19,0)", 0, 0),
    }
    typed = inference.parse(df, {n: t for n, (t, _, _) in found.items()})
    assert [t for _, t in typed.dtypes] == [found[n][0] for n in typed.columns]
    assert rows(typed.selectExpr("sum(`a.b`)", "sum(cents)", "sum(power)", "max(longest)")) == [
        (-19, pytest.approx(4.75), pytest.approx(1001.995), 10**19 - 1)
    ]


def test_rejects_within_the_tolerance_become_null(spark):
    values = ["%d" % i for i in range(95)] + ["?"] * 5
    found, df = inferred(spark, {"n": values}, 0.05)
    assert found["n"] == ("bigint", 0, 5)
    assert rows(inference.parse(df, {"n": "bigint"}).agg(F.count("n"))) == [(95,)]
    assert inferred(spark, {"n": values}, 0.04)[0]["n"] == ("string", 0, 0)


def test_one_scan_finds_all_types(spark, tmp_path):
    spark.range(50).selectExpr("id AS a", "id / 7 AS b", "concat('x', id) AS c").write.csv(
        str(tmp_path / "t"), header=True
    )
    raw = spark.read.option("header", True).csv(str(tmp_path / "t"))
    plan = inference.infer_types(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    typed = inference.read_typed_csv(spark, str(tmp_path / "t"), declared={"a": "bigint"}, text=["b"])
    assert typed.dtypes == [("a", "bigint"), ("b", "string"), ("c", "string")]


def test_typed_csv_there_and_back(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a, \"b\"", dt.datetime(2024, 1, 2, 3, 4, 5)), (None, None, None)],
        "id long, name string, at timestamp",
    )
    write_csv(df, str(tmp_path / "t"))
    back = inference.read_typed_csv(spark, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and sorted(rows(back), key=str) == sorted(rows(df), key=str)
    empty = spark.createDataFrame([], "id string, name string")
    assert rows(inference.infer_types(empty).select("type", "nulls", "rejects")) == [("string", 0, 0)] * 2


# ---- quantiles


@pytest.mark.parametrize("points, splits, size", [(20, 3, 4_000), (50, 1, 3_000), (1_000, 4, 500)])
def test_ranks_from_summaries_are_near(spark, points, splits, size):
    rng = random.Random(points)
    data = [(i, i % 5, int(rng.choice([rng.gauss(0, 90), rng.expovariate(1e-3), 7]))) for i in range(size)]
    data += [(i, 2, 13) for i in range(size // 2)]  # a hot value in a hot group
    data += [(0, 1, None), (1, None, 5)]
    df = spark.createDataFrame(data, "id long, g int, v long")
    kept = store.keep(sketch.summarise(df, F.col("v"), ["g"], points, splits))
    assert kept.groupBy("g", "part").count().agg(F.max("count")).first()[0] <= points
    qs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    for chosen in ([0], [2], [1, 3], [0, 1, 2, 3, 4, None]):
        match = F.col("g").isin([c for c in chosen if c is not None])
        if None in chosen:
            match = match | F.col("g").isNull()
        some = kept.where(match)
        values = sorted(v for _, g, v in data if g in chosen and v is not None)
        off = sketch.rank_error(some, ["g"], points).first()[0]
        assert off <= len(values) / points + 2 * splits * len(chosen)
        found = sketch.quantiles(some, qs).first()
        assert found["total_n"] == len(values) and found["q100"] == values[-1]
        for name, q in qs.items():
            rank = (len(values) - 1) * q + 1
            least = bisect.bisect_left(values, found[name]) + 1
            most = bisect.bisect_right(values, found[name])
            assert least - off - 1 <= rank <= most + off + 1


def test_summaries_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g int, v long")
    kept = sketch.summarise(df, F.col("v"), ["g"])
    assert rows(kept) == [] and rows(sketch.rank_error(kept, ["g"])) == [(0,)]
    assert rows(sketch.quantiles(kept, {"m": 0.5}).select("m")) == [(None,)]


# ---- tables clustered by user


@pytest.fixture(scope="module")
def orders(spark):
    def rows_of(hot):
        user = f"CASE WHEN id % 3 = 0 AND {hot} THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 900 END"
        return spark.range(0, 30_000, 1, 6).selectExpr(
            "id AS order_id", f"CAST({user} AS BIGINT) AS user_id", "'Complete' AS status",
            "timestamp'2023-01-01' + make_interval(0, 0, 0, CAST(id % 400 AS INT)) AS created_at",
        )

    return {hot: store.keep(rows_of(hot)) for hot in (True, False)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [True, False])
def test_clustered_tables_give_the_same_results(spark, orders, hot, tmp_path):
    plain = orders[hot]
    users = plain.groupBy(F.col("user_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    users = users.withColumn("traffic_source", F.lit("x")).where("id IS NOT NULL")
    parts = store.write_clustered(plain, str(tmp_path / "o"), "user_id", 16, ["created_at"])
    again = store.read_clustered(spark, str(tmp_path / "o"))
    for clustered in (parts, again):
        frames = store.parts_of(clustered)
        assert len(frames) == 2  # those without a user stand apart in any case
        everything = sorted(rows(frames[0].unionAll(frames[1])), key=str)
        assert everything == sorted(rows(plain), key=str)
        biggest = frames[0].groupBy("user_id").count().agg(F.max("count")).first()[0]
        assert biggest <= 30_000 / 16
        for analysis in (
            lambda t: retention.cohort_monthly_sparse(t, "2023-02-01"),
            lambda t: retention.cohort_weekly_dense(t, "2023-05"),
            lambda t: repeat.repeat_purchaser_monthly(t, 2023),
            lambda t: repeat.repeat_by_order_weekday(t),
            lambda t: activation.activation_monthly(users, t),
            lambda t: activation.activation_kpis(users, t),
            lambda t: activation.ttfp_summary(users, t),
        ):
            assert sorted(rows(analysis(clustered)), key=str) == sorted(rows(analysis(plain)), key=str)


def test_no_exchange_below_the_cohort_window(spark, orders, tmp_path):
    known = orders[False].where("user_id IS NOT NULL")
    clustered = store.write_clustered(known, str(tmp_path / "o"), "user_id", 16, ["created_at"])
    assert len(store.parts_of(clustered)) == 1
    plan = plan_of(cohort_cells(clustered, MONTH))
    below = plan[plan.index("windowspecdefinition(user_id") :]
    assert "Exchange" not in below and "Bucketed: true" in below
    assert "Exchange" in plan_of(cohort_cells(known, MONTH)).split("windowspecdefinition(user_id")[1]
    users = known.selectExpr("user_id AS id", "created_at").groupBy("id").agg(
        F.min("created_at").alias("created_at")
    )
    people = store.write_clustered(users, str(tmp_path / "u"), "id", 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(activation._with_first(people, clustered, ("Complete",)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_folder(Elsewhere)


# ---- bitmaps of users


def test_bitmaps_count_users_of_any_choice(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "BUCKET_USERS", 60_000)  # so that buckets have a second page
    users = spark.range(0, 100_000, 1, 8).selectExpr(
        "id * 1000003 AS id",
        "CASE WHEN id % 3 > 0 THEN concat('g', id % 3) END AS g",
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id % 7 AS STRING) END AS s",
        "id % 5 = 0 AS hit",
    )
    users = users.unionAll(users.where("id % 10 = 0")).unionAll(
        spark.sql("SELECT CAST(NULL AS BIGINT), 'g1', 'hot', true")
    )
    index = store.keep(
        bitmaps.index_users(
            users,
            {"g": F.col("g"), "s": F.col("s"), "hit": F.when(F.col("hit"), F.lit("yes"))},
        )
    )
    assert index.agg(F.max("page"), F.max(F.length("bits"))).first()[:] == (1, 4_096)
    known = users.where("id IS NOT NULL").distinct()
    hits = bitmaps.chosen(index, "hit")
    within = [bitmaps.chosen(index, "s", ["hot", "3"])]
    for dimensions, kept, choice in (
        (["g"], known, []),
        (["g", "s"], known, []),
        (["g"], known.where("s IN ('hot', '3')"), within),
    ):
        expected = kept.where(" AND ".join(f"{d} IS NOT NULL" for d in dimensions)).groupBy(
            *dimensions
        ).agg(F.count("*").alias("n"), F.count_if("hit").alias("m"))
        found = bitmaps.rates(index, dimensions, hits, choice).drop("activation_rate")
        assert sorted(rows(found)) == sorted(rows(expected))
    everyone = bitmaps.chosen(index, bitmaps.EVERYONE)
    assert rows(bitmaps.count_users(everyone)) == [(100_000,)]
    assert rows(bitmaps.count_users(bitmaps.both(everyone, hits))) == [(20_000,)]
    assert rows(bitmaps.count_users(bitmaps.chosen(index, "s", ["nobody"]))) == [(0,)]


def test_one_scan_for_all_dimensions(spark, orders):
    users = orders[False].select(F.col("user_id").alias("id"), "status")
    index = bitmaps.index_users(users, {"a": F.col("status"), "b": F.upper("status")})
    assert not [x for x in plan_of(index).split("\n") if "Expand" in x or "Union" in x]
