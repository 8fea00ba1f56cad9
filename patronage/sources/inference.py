"""Types of text columns, found in one pass over all rows.

For each column a handful of counters say how many of its known values read as a whole number, a
decimal, a double or a time, and how many digits they need. The counters of all columns are one row,
added up per task first; a column's type follows from them. Nothing is sampled, so the type holds
for the whole table, and the result has one row a column however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.sources.tables import parsed_time, read_csv

# From narrow to wide; a column has the first that its values read as, else it stays text.
ORDER = ("long", "decimal", "double", "timestamp")
LONG = r"^[+-]?[0-9]{1,18}$"
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
DOUBLE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
MOST_DIGITS = 38


def _digits(text: Column) -> tuple[Column, Column]:
    """Digits before (leading zeros apart) and behind the point of a decimal."""
    whole = F.length(F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1))
    behind = F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1))
    return whole, behind


def _counters(name: str) -> Column:
    """A struct of what one column's values read as."""
    text = F.trim(F.col(f"`{name}`"))
    decimal = text.rlike(DECIMAL)
    whole, behind = (F.max(F.when(decimal, n)) for n in _digits(text))
    return F.struct(
        F.lit(name).alias("column"),
        F.count("*").alias("rows"),
        F.count(text).alias("known"),
        F.count_if(text.rlike(LONG)).alias("long"),
        F.count_if(decimal).alias("decimal"),
        F.count_if(text.rlike(DOUBLE)).alias("double"),
        F.count_if(parsed_time(text).isNotNull()).alias("timestamp"),
        F.coalesce(whole, F.lit(0)).alias("whole"),
        F.coalesce(behind, F.lit(0)).alias("behind"),
    )


def infer_types(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """`column`, `type`, `nulls` and `rejects` of each text column, in the frame's order.

    A column's type is the first of whole number, decimal, double and time that all known values
    read as, but for a share of `tolerance`; those are its rejects and become null when the
    column is parsed. Decimals have the digits the values need; of more than 38 they are doubles.
    Blanks around a value do not count. A column without a known value stays text. An empty frame's
    columns are text with no nulls.
    """
    names = [f.name for f in df.schema.fields]
    texts = df.select(*(F.col(f"`{n}`").cast("string").alias(n) for n in names))
    # one row, so it can be laid out by column in place
    found = texts.agg(F.array(*map(_counters, names)).alias("columns"))
    columns = found.select(F.posexplode("columns").alias("place", "c")).select("place", "c.*")

    def reads(kind: str) -> Column:
        enough = F.ceil(F.col("known") * F.lit(1 - tolerance).cast("decimal(9,6)"))
        return (F.col("known") > 0) & (F.col(kind) >= enough)

    short = F.col("whole") + F.col("behind") <= MOST_DIGITS
    precise = F.greatest(F.col("whole") + F.col("behind"), F.lit(1)).cast("string")
    kinds = {
        "long": (reads("long"), F.lit("bigint"), F.col("long")),
        "decimal": (
            reads("decimal") & short,
            F.concat(F.lit("decimal("), precise, F.lit(","), F.col("behind").cast("string"), F.lit(")")),
            F.col("decimal"),
        ),
        "double": (reads("double"), F.lit("double"), F.col("double")),
        "timestamp": (reads("timestamp"), F.lit("timestamp"), F.col("timestamp")),
    }
    kind, good = F.lit("string"), F.col("known")
    for name in reversed(ORDER):
        fits, shown, count = kinds[name]
        kind, good = F.when(fits, shown).otherwise(kind), F.when(fits, count).otherwise(good)
    return columns.select(
        "place",
        "column",
        kind.alias("type"),
        (F.col("rows") - F.col("known")).alias("nulls"),
        (F.col("known") - good).alias("rejects"),
    )


def types_of(inferred: DataFrame) -> dict[str, str]:
    """The inferred types by column name: a row a column reaches the driver."""
    rows = inferred.select("place", "column", "type").collect()
    return {r["column"]: r["type"] for r in sorted(rows)}


def parse(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The text columns in the given types, each value on its own; one that does not read is null.

    Columns without a type stay as they are.
    """

    def typed(name: str) -> Column:
        text = F.trim(F.col(f"`{name}`"))
        kind = types.get(name, "string")
        if kind == "string":
            return F.col(f"`{name}`")
        if kind == "timestamp":
            return parsed_time(text).alias(name)
        shape = {"bigint": LONG, "double": DOUBLE}.get(kind, DECIMAL)
        return F.when(text.rlike(shape), text.try_cast(kind)).alias(name)

    return df.select(*map(typed, df.columns))


def read_typed_csv(
    spark: SparkSession,
    path: str,
    tolerance: float = 0.0,
    declared: Mapping[str, str] | None = None,
    text: Sequence[str] = (),
) -> DataFrame:
    """A CSV file in the types its values have.

    `declared` types are taken as they are and `text` columns stay text; only the others are
    looked through, and if there are none the file is not read to find types.
    """
    raw = read_csv(spark, path)
    types = dict(declared or {})
    asked = [c for c in raw.columns if c not in types and c not in text]
    if asked:
        types |= types_of(infer_types(raw.select(*(f"`{c}`" for c in asked)), tolerance))
    return parse(raw, types)
