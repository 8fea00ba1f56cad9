"""Canonical tables from CSV or Parquet, and the CSV sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.schemas import REQUIRED, SCHEMAS, require_columns


# Texts that stand for a missing value in CSV files.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Layouts of dates besides year-month-day: month first where only numbers tell.
LAYOUTS = tuple(
    f"{day}[ H:mm[:ss]]"
    for day in ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy")
)


def parsed_time(column: Column) -> Column:
    """A text as a timestamp, in the first layout that fits; a time without a date is null."""
    text = F.trim(column)
    dated = text.rlike(r"^\d{4}(-\d|$)")
    iso = F.when(dated, text).try_cast("timestamp")
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(x)) for x in LAYOUTS))


def _typed(name: str, have: T.DataType, want: T.DataType) -> Column:
    """The column in its canonical type; a value that does not parse becomes null."""
    column = F.col(name)
    if have == want or (have == T.TimestampNTZType() and want == T.TimestampType()):
        return column
    if isinstance(want, (T.LongType, T.IntegerType)) and isinstance(have, T.StringType):
        # through a decimal, so that an id written as 17.0 still reads as 17
        column = column.try_cast("decimal(20,0)")
    if isinstance(want, T.TimestampType) and isinstance(have, T.StringType):
        return parsed_time(column).alias(name)
    return column.try_cast(want).alias(name)


def clean(df: DataFrame, table: str) -> DataFrame:
    """The canonical columns `df` has, in canonical type, each row parsed on its own."""
    require_columns(df, REQUIRED[table], table)
    kinds = {field.name: field.dataType for field in df.schema.fields}
    return df.select(
        *(
            _typed(field.name, kinds[field.name], field.dataType)
            for field in SCHEMAS[table].fields
            if field.name in kinds
        )
    )


def read_csv(
    spark: SparkSession,
    path: str,
    multiline: bool = False,
    null_markers: Iterable[str] = NULL_MARKERS,
) -> DataFrame:
    """A CSV file with a header line, all columns as text; quotes in quoted values are doubled.

    Values may hold line breaks with `multiline`; a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    raw = reader.option("multiLine", multiline).csv(path)
    markers = list(null_markers)
    if not markers:
        return raw
    return raw.select(
        *(F.when(~F.col(f"`{c}`").isin(markers), F.col(f"`{c}`")).alias(c) for c in raw.columns)
    )


def load_table(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "csv",
    multiline: bool = False,
    null_markers: Iterable[str] = NULL_MARKERS,
) -> DataFrame:
    """One canonical table. CSV needs a header line; its columns are found by name."""
    if fmt == "csv":
        raw = read_csv(spark, path, multiline, null_markers)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}")
    return clean(raw, table)


def load_tables(
    spark: SparkSession,
    base: str,
    tables: Iterable[str] = tuple(SCHEMAS),
    fmt: str = "csv",
) -> dict[str, DataFrame]:
    """`<base>/<table>.<fmt>` for each table. A Parquet copy is the better form at scale."""
    return {name: load_table(spark, f"{base}/{name}.{fmt}", name, fmt) for name in tables}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a folder of CSV parts with a header line each; quotes in values are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def memoise(df: DataFrame) -> DataFrame:
    """Keep a frame that several analyses share, in the cluster's checkpoint folder.

    The folder outlives executors, so losing one never recomputes the shared frame. A `file:`
    folder is taken on a local master only: executors of a cluster would not share it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    place = spark.sparkContext.getCheckpointDir()
    if place.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must be a folder all executors share")
    return df.checkpoint()
