"""Sizes and bounds of stored Parquet tables from the statistics in the files' footers.

No column is read: Spark pushes the counts, least and greatest values down to the footers, a task
for some files. Where some file's footer does not say (one written without statistics, a column
without any value in it, an empty file, times of the old 96-bit kind), bounds come from a scan of
the asked columns; whether they do is seen by asking the footers once, for one row. A table without
rows has null bounds.

Spark finds a column's footer entry by its place. So a table is always read with its files' own
schema, columns behind a nested one have no bounds, and all files must have the same columns in the
same order, as files of one writer do. Row counts need none of this.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.session import configure

V1_SOURCES = "spark.sql.sources.useV1SourceList"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


@contextmanager
def _pushing_source(spark: SparkSession) -> Iterator[None]:
    """Within it, Parquet is read by the source that takes aggregates."""
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(V1_SOURCES, before)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table for aggregates over whole files. Times are whole numbers, as they are stored.

    Footers keep the bounds of times only as numbers, and Spark leaves those of time types alone.
    """
    return _stored(spark, path, spark.read.parquet(path).schema)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    configure(spark)
    plain = T.StructType(
        [
            T.StructField(f.name, T.LongType() if isinstance(f.dataType, TIMES) else f.dataType)
            for f in schema.fields
        ]
    )
    with _pushing_source(spark):
        return spark.read.schema(plain).parquet(path)


def stored_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Rows and columns of each table, as `table_summary` has them."""

    def size(name: str, path: str) -> DataFrame:
        df = stored(spark, path)
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), _counted("rows"), F.lit(len(df.columns)).alias("cols")
        )

    return reduce(DataFrame.unionAll, (size(*table) for table in paths.items()))


def stored_bounds(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """`column_name, rows, known, least, greatest` of the table's whole numbers, dates and times.

    `known` counts what is not null. Bounds are whole numbers: of a date its days since 1970, of a
    time what is stored (microseconds since 1970, unless the writer was told otherwise).
    """
    schema = spark.read.parquet(path).schema
    flat = itertools.takewhile(lambda f: not isinstance(f.dataType, NESTED), schema.fields)
    kinds = (*WHOLE, *TIMES, T.DateType)
    able = [f.name for f in flat if isinstance(f.dataType, kinds)]
    chosen = able if columns is None else list(columns)
    if not set(chosen) <= set(able) or not chosen:
        raise ValueError(f"no footer bounds for {sorted(set(chosen) - set(able)) or 'no columns'}")
    found = [F.count("*").alias("rows")]
    for i, c in enumerate(map(_named, chosen)):
        found += [F.count(c).alias(f"known_{i}"), F.min(c).alias(f"least_{i}")]
        found.append(F.max(c).alias(f"greatest_{i}"))

    def whole(name: str, kind: T.DataType) -> Column:
        bound = F.col(name)
        return (F.unix_date(bound) if isinstance(kind, T.DateType) else bound).cast("bigint")

    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            _counted("rows"),
            _counted(f"known_{i}").alias("known"),
            whole(f"least_{i}", schema[c].dataType).alias("least"),
            whole(f"greatest_{i}", schema[c].dataType).alias("greatest"),
        )
        for i, c in enumerate(chosen)
    ]
    totals = _stored(spark, path, schema).agg(*found)
    if not _answered(totals):
        totals = _plain(spark, path, chosen).agg(*found)
    return totals.select(F.inline(F.array(*lines)))


def _answered(totals: DataFrame) -> bool:
    """Whether the footers of all files have what is asked; any other failure is raised."""
    try:
        totals.collect()  # one row
    except (Py4JJavaError, PySparkException) as failure:
        if "FAILED_READ_FILE" not in str(failure):
            raise
        return False
    return True


def _plain(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns by an ordinary scan, times in microseconds."""
    df = spark.read.parquet(path)

    def whole(name: str) -> Column:
        column = _named(name)
        if isinstance(df.schema[name].dataType, TIMES):
            column = F.unix_micros(column.cast("timestamp"))
        return column.alias(name)

    return df.select(*map(whole, columns))


def stored_days(spark: SparkSession, path: str, column: str) -> DataFrame:
    """First and last day of a date column, or of a time column in microseconds."""
    kind = spark.read.parquet(path).schema[column].dataType
    found = stored_bounds(spark, path, [column])

    def day(name: str) -> Column:
        if isinstance(kind, T.DateType):
            return F.date_from_unix_date(F.col(name).cast("int"))
        return F.to_date(F.timestamp_micros(name))

    return found.select(day("least").alias("first_day"), day("greatest").alias("last_day"))


def _counted(name: str) -> Column:
    """The pushed count, which is null where there are no files; `coalesce` would be optimised away."""
    return F.greatest(F.col(name), F.lit(0).cast("bigint")).alias(name)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")
