"""Reading CSV and Parquet into canonical form, and writing the sample."""

import csv
import datetime as dt

import pytest
from frames import rows

from patronage.operators.retention import cohort_monthly_dense
from patronage.operators.sampling import sample_events_job
from patronage.schemas import SCHEMAS
from patronage.sources.tables import load_table, load_tables, memoise, read_csv, write_csv

HEADERS = {
    "users": "id,first_name,email,age,gender,traffic_source,created_at",
    "products": "id,cost,category,name,brand,department",
    "orders": "order_id,user_id,status,gender,created_at,returned_at,shipped_at,delivered_at",
    "order_items": "id,order_id,user_id,product_id,inventory_item_id,status,created_at,sale_price",
    "events": "id,user_id,sequence_number,session_id,created_at,event_type",
    "inventory_items": "id,product_id,created_at,sold_at,cost",
}


def write(folder, table, *lines):
    (folder / f"{table}.csv").write_text("\n".join([HEADERS[table], *lines]) + "\n")


def test_columns_are_found_by_name(spark, tmp_path):
    for table in HEADERS:
        write(tmp_path, table)
    write(tmp_path, "users", "7,Ann,a@b.c,31,F,Search,2023-01-02 03:04:05+00:00")
    tables = load_tables(spark, str(tmp_path))
    assert set(tables) == set(SCHEMAS)
    assert tables["users"].columns == ["id", "created_at", "gender", "age", "traffic_source"]
    (user,) = tables["users"].collect()
    assert user.asDict() == {
        "id": 7,
        "created_at": dt.datetime(2023, 1, 2, 3, 4, 5),
        "gender": "F",
        "age": 31,
        "traffic_source": "Search",
    }
    kinds = {f.name: f.dataType for f in tables["order_items"].schema.fields}
    wanted = {f.name: f.dataType for f in SCHEMAS["order_items"].fields}
    assert all(wanted[name] == kind for name, kind in kinds.items())


def test_each_timestamp_is_parsed_on_its_own(spark, tmp_path):
    write(
        tmp_path,
        "events",
        "1,,1,s,x,view",
        "2,,1,s,,view",
        "3,17.0,1,s,2023-01-01 00:00:00+00:00,view",
        "4,18,1,s,2023-01-01 00:00:00.123+00:00,view",
        "5,no,1,s,2023-01-02,view",
    )
    events = load_table(spark, f"{tmp_path}/events.csv", "events").orderBy("id").collect()
    assert [e.created_at for e in events] == [
        None,
        None,
        dt.datetime(2023, 1, 1),
        dt.datetime(2023, 1, 1, 0, 0, 0, 123_000),
        dt.datetime(2023, 1, 2),
    ]
    assert [e.user_id for e in events] == [None, None, 17, 18, None]


def test_prices_become_cents(spark, tmp_path):
    write(
        tmp_path,
        "order_items",
        "1,1,1,1,1,Complete,2023-01-01 00:00:00 UTC,0.0199999996",
        "2,1,1,1,1,Complete,2023-01-01 00:00:00 UTC,free",
    )
    items = load_table(spark, f"{tmp_path}/order_items.csv", "order_items")
    assert [None if v is None else str(v) for (v,) in rows(items.select("sale_price"))] == [
        "0.02",
        None,
    ]


def test_missing_column_and_format(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,user_id,created_at\n1,1,2023-01-01\n")
    with pytest.raises(ValueError, match="orders lacks .* status"):
        load_table(spark, f"{tmp_path}/orders.csv", "orders")
    with pytest.raises(ValueError, match="format"):
        load_table(spark, str(tmp_path), "orders", "xml")


def test_parquet_round_trip_pushes_filters(spark, tmp_path):
    write(tmp_path, "orders", "1,2,Complete,F,2023-05-06 07:08:09,,,")
    orders = load_table(spark, f"{tmp_path}/orders.csv", "orders")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    again = load_table(spark, f"{tmp_path}/orders.parquet", "orders", "parquet")
    assert again.schema == orders.schema and rows(again) == rows(orders)
    plan = again.where("created_at >= '2023-01-01'").select("order_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in text


def test_sample_job_writes_csv(spark, tmp_path):
    write(
        tmp_path,
        "events",
        *(f"{i},1,1,s,2023-{1 + i % 12:02d}-28 10:00:00,view" for i in range(60)),
        *(f"{i},1,1,s,2022-12-31 10:00:00,view" for i in range(60, 90)),
        "91,1,1,s,2023-12-31 23:59:59,view",
    )
    raw = spark.read.option("header", True).csv(f"{tmp_path}/events.csv")
    sample_events_job(raw, f"{tmp_path}/sample", 2023, 20)
    back = load_table(spark, f"{tmp_path}/sample", "events")
    assert back.count() == 20
    assert back.where("year(created_at) = 2023").count() == 20


def test_memoise_needs_and_uses_the_shared_folder(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:  # earlier tests may have set one
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            memoise(spark.range(3))
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    kept = memoise(spark.range(3).selectExpr("id * 2 AS twice"))
    assert sorted(rows(kept)) == [(0,), (2,), (4,)]


NASTY = ['36" inseam, blue "slim" jean', "two\nlines", "back\\slash", "a,b", "plain", "é ñ"]


def test_csv_agrees_with_a_standard_reader(spark, tmp_path):
    with open(tmp_path / "products.csv", "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(["id", "category", "brand", "name"])
        writer.writerows([i, "NA", "NULL" if i else "b", text] for i, text in enumerate(NASTY))
    path = f"{tmp_path}/products.csv"
    table = load_table(spark, path, "products", multiline=True).orderBy("id")
    assert rows(table.select("name")) == [(t,) for t in NASTY]
    assert rows(table.select("category").distinct()) == [(None,)]
    assert table.where("brand IS NULL").count() == len(NASTY) - 1
    kept = load_table(spark, path, "products", multiline=True, null_markers=())
    assert kept.where("brand = 'NULL'").count() == len(NASTY) - 1

    write_csv(table.coalesce(1), f"{tmp_path}/out")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with open(part, newline="") as file:
        assert [r["name"] for r in csv.DictReader(file)] == NASTY
    back = read_csv(spark, f"{tmp_path}/out", multiline=True).orderBy("id")
    assert rows(back.select("name")) == [(t,) for t in NASTY]


def test_layouts_of_dates(spark, tmp_path):
    texts = ["01/02/2023", "1/2/2023 3:04", "Jan 3 2023", "3 Jan 2023", "2023/01/04", "12:30", "2023"]
    write(tmp_path, "events", *(f"{i},1,1,s,{t},view" for i, t in enumerate(texts)))
    found = load_table(spark, f"{tmp_path}/events.csv", "events").orderBy("id")
    day = lambda *d: (dt.datetime(2023, *d),)
    assert rows(found.select("created_at")) == [
        day(1, 2), day(1, 2, 3, 4), day(1, 3), day(1, 3), day(1, 4), (None,), day(1, 1),
    ]


def test_items_need_no_status(spark, tmp_path):
    (tmp_path / "order_items.csv").write_text(
        "order_id,user_id,created_at\n1,1,2023-01-01\n2,1,2023-02-01\n"
    )
    items = load_table(spark, f"{tmp_path}/order_items.csv", "order_items")
    assert cohort_monthly_dense(items).count() == 2


def test_sample_job_keeps_all_columns(spark, tmp_path):
    raw = spark.createDataFrame(
        [(str(i), "2023-05-06 07:08:09", "Chrome", f"/p/{i}") for i in range(30)],
        "id string, created_at string, browser string, uri string",
    )
    sample_events_job(raw, f"{tmp_path}/all", 2023, 12)
    back = read_csv(spark, f"{tmp_path}/all")
    assert back.columns == raw.columns and back.count() == 12
