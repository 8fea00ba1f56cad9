"""Run registered queries against their SQL on one folder of tables.

`python tests/compare.py <sf_dir> [key ...]` prints one line per key.
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    """Rows as text, columns by name, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(spark_df.columns) != sorted(result.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(result.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} != {b}"
    kinds = dict(spark_df.dtypes)
    for name, kind in zip(result.columns, map(str, result.types)):
        if KINDS.get(kind, kind.lower()) != kinds[name]:
            return f"type of {name}: {kinds[name]} != {kind}"
    return None


KINDS = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "TIMESTAMP": "timestamp_ntz",
}


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from patronage.session import build_session

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, found, sql = connect(sf_dir), queries(), oracle_sql()
    bad = 0
    for key in keys or found:
        began = time.time()
        try:
            if key in sql:
                wrong = difference(found[key](spark, sf_dir), con, sql[key])
            else:
                wrong = None if found[key](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # report every key
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        bad += wrong is not None
        print(f"{'ok ' if wrong is None else 'BAD'} {key} {time.time() - began:.2f}s {wrong or ''}")
    print(f"{bad} of {len(keys or found)} differ; without SQL: {sorted(set(found) - set(sql))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
