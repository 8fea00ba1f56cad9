"""Every registered query agrees with its SQL: on the given tables and on hostile ones."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, difference

from __spark_entry__ import entry
from patronage.registry.oracle import oracle_sql
from patronage.registry.queries import queries

SMALL = "/root/testdata/sf0.001"
KEYS = sorted(queries())


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_given_tables(spark, key):
    assert difference(queries()[key](spark, SMALL), connect(SMALL), oracle_sql()[key]) is None


def _write(folder, name, table: dict):
    fields = []
    for column, values in table.items():
        if column in ("o_orderdate", "l_shipdate", "ts"):
            stamps = pd.Series(values).dt.as_unit("us")
            fields.append((column, pa.array(stamps, pa.timestamp("us"))))
        else:
            fields.append((column, pa.array(values)))
    pq.write_table(pa.table(dict(fields)), f"{folder}/{name}.parquet")


def _gaps(rng, values, share):
    """Some of the values replaced by None."""
    lost = rng.random(len(values)) < share
    return [None if gone else value for gone, value in zip(lost, values)]


def _hot(rng, high, size):
    """Keys of which one holds a third of all rows."""
    keys = rng.integers(0, high, size)
    keys[rng.random(size) < 0.34] = 7
    return keys.tolist()


def _stamps(rng, first, days, size, step="s"):
    unit = {"s": 1, "D": 86_400}[step]
    seconds = rng.integers(0, days * 86_400 // unit, size) * unit
    return pd.to_datetime(first) + pd.to_timedelta(seconds, unit="s")


@pytest.fixture(scope="module")
def hostile(tmp_path_factory):
    """Star tables with nulls, ties, times of day and a hot customer, part and order."""
    folder = tmp_path_factory.mktemp("hostile")
    rng = np.random.default_rng(11)
    people, parts, orders, lines, events = 120, 40, 1_500, 6_000, 3_000
    _write(folder, "region", {
        "r_regionkey": pa.array(range(3), pa.int32()),
        "r_name": ["ASIA", "EUROPE", None],
    })
    _write(folder, "nation", {
        "n_nationkey": pa.array(range(6), pa.int32()),
        "n_name": [f"N{i}" for i in range(6)],
        "n_regionkey": pa.array([0, 1, 2, 0, 1, None], pa.int32()),
    })
    _write(folder, "customer", {
        "c_custkey": pa.array(range(people), pa.int64()),
        "c_name": [f"C{i}" for i in range(people)],
        "c_nationkey": pa.array(_gaps(rng, rng.integers(0, 8, people).tolist(), 0.1), pa.int32()),
        "c_acctbal": _gaps(rng, rng.choice([-5, 0, 1999.99, 2000, 5000, 9999, 10000.0], people).tolist(), 0.1),
        "c_mktsegment": _gaps(rng, rng.choice(["BUILDING", "MACHINERY", "OTHER"], people).tolist(), 0.1),
    })
    names = ["red ring", "blue bolt", "a very long product name indeed", "pre-owned hat", None]
    _write(folder, "part", {
        "p_partkey": pa.array(range(parts), pa.int64()),
        "p_name": rng.choice(np.array(names[:4], dtype=object), parts).tolist(),
        "p_brand": _gaps(rng, rng.choice(["Brand#1", "Brand#2", "Brand#9"], parts).tolist(), 0.1),
        "p_type": _gaps(rng, rng.choice(["MEDIUM", "SMALL", "LARGE"], parts).tolist(), 0.1),
        "p_size": pa.array(rng.integers(1, 50, parts), pa.int32()),
        "p_retailprice": rng.random(parts),
    })
    _write(folder, "orders", {
        "o_orderkey": pa.array(range(orders), pa.int64()),
        "o_custkey": pa.array(_gaps(rng, _hot(rng, people + 20, orders), 0.03), pa.int64()),
        "o_orderstatus": _gaps(rng, rng.choice(["F", "O", "P", " F ", "f"], orders, p=[0.5, 0.2, 0.1, 0.1, 0.1]).tolist(), 0.03),
        "o_totalprice": rng.random(orders),
        # whole days in the first half of the rows make for ties
        "o_orderdate": pd.Series(np.concatenate([
            _stamps(rng, "1994-12-20", 800, orders // 2, "D"),
            _stamps(rng, "1994-12-20", 800, orders - orders // 2),
        ])).where(rng.random(orders) > 0.03),
        "o_orderpriority": ["x"] * orders,
    })
    _write(folder, "lineitem", {
        "l_orderkey": pa.array(_gaps(rng, _hot(rng, orders + 50, lines), 0.02), pa.int64()),
        "l_partkey": pa.array(_gaps(rng, _hot(rng, parts + 5, lines), 0.02), pa.int64()),
        "l_suppkey": pa.array(rng.integers(0, 9, lines), pa.int64()),
        "l_linenumber": pa.array(rng.integers(1, 8, lines), pa.int32()),
        "l_quantity": rng.random(lines),
        "l_extendedprice": (rng.integers(1, 3_000_000, lines) / 100).tolist(),
        "l_discount": rng.random(lines),
        "l_tax": rng.random(lines),
        "l_returnflag": ["N"] * lines,
        "l_linestatus": ["F"] * lines,
        "l_shipdate": pd.Series(_stamps(rng, "1995-01-10", 800, lines)),
    })
    _write(folder, "events", {
        "event_id": pa.array(range(events), pa.int64()),
        "ts": pd.Series(_stamps(rng, "2023-12-28", 45, events)),
        "user_id": pa.array(_gaps(rng, _hot(rng, people, events), 0.05), pa.int64()),
        "event_type": _gaps(rng, rng.choice(["signup", "purchase", "view"], events).tolist(), 0.02),
        "value": rng.integers(0, 9_999, events) / 100,
        "props": ["{}"] * events,
    })
    return str(folder)


@pytest.mark.parametrize("key", KEYS)
def test_hostile_tables(spark, hostile, key):
    assert difference(queries()[key](spark, hostile), connect(hostile), oracle_sql()[key]) is None


@pytest.fixture(scope="module")
def nothing(tmp_path_factory, hostile):
    """The same tables without a row."""
    folder = tmp_path_factory.mktemp("nothing")
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        table = pq.read_table(f"{hostile}/{name}.parquet")
        pq.write_table(table.slice(0, 0), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("key", KEYS)
def test_no_rows(spark, nothing, key):
    assert difference(queries()[key](spark, nothing), connect(nothing), oracle_sql()[key]) is None
