"""Exact order statistics without sorting everything in one place.

Values are integers (cents, days). They are first counted per distinct value, then per block of
2**20 neighbouring values, and those per block of 2**22 blocks. A rank is looked for from the widest
blocks down: each step sees at most 2**22 blocks, the last at most 2**20 values, whatever the range
of the values. Values below 2**42 have one widest block.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 20
WIDER_BITS = 22
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
AMOUNT = "CAST(v AS DECIMAL(38,0)) * n"
REACHED = "rank > below_n AND rank <= below_n + value_n"


def count_values(df: DataFrame, value: Column) -> DataFrame:
    """Distinct non-null values `v` with their number of rows `n`."""
    return merge_counts(df.select(value.cast("bigint").alias("v"), F.lit(1).alias("n")))


def merge_counts(rows: DataFrame) -> DataFrame:
    """Values `v` that stand for `n` rows each, brought together per distinct value.

    Declaring `v` never null keeps later joins from adding a null check of their own, so that
    every use of the counts has the same plan and Spark computes them once.
    """
    known = rows.where("v IS NOT NULL").selectExpr("coalesce(v, 0L) AS v", "n")
    return known.groupBy("v").agg(F.sum("n").alias("n"))


def pick_ranks(counts: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """The value at each ascending rank (from 1), given counted values `v, n`.

    `ranks` maps a name to an expression over `total_n`, the number of rows. Result, one row
    per name that exists: `name, rank, total_n, total_sum, value, value_n, below_n, below_sum`,
    where `below_*` cover the rows with a smaller value.
    """
    values = counts.selectExpr(
        "v", "n", f"CAST({AMOUNT} AS DECIMAL(38,0)) AS amount",
        f"shiftright(v, {BLOCK_BITS}) AS block",
    )
    blocks = _blocks(values).withColumn("block", F.expr(f"shiftright(v, {WIDER_BITS})"))
    levels = [values, blocks]
    widest = _blocks(blocks)  # a 64-bit value has 2**22 of them
    wanted = ", ".join(
        f"struct('{name}' AS name, CAST({rank} AS BIGINT) AS rank)"
        for name, rank in ranks.items()
    )
    found = (
        widest.selectExpr(
            "v AS value",
            "n AS value_n",
            f"coalesce(sum(n) OVER (ORDER BY v {BEFORE}), 0) AS below_n",
            f"CAST(coalesce(sum(amount) OVER (ORDER BY v {BEFORE}), 0) AS DECIMAL(38,0))"
            " AS below_sum",
            f"sum(n) OVER (ORDER BY v {ALL}) AS total_n",
            f"CAST(sum(amount) OVER (ORDER BY v {ALL}) AS DECIMAL(38,0)) AS total_sum",
        )
        .selectExpr("*", f"inline(array({wanted}))")
        .where(REACHED)
    )
    for level in reversed(levels):
        # one row per requested rank: the bound on what is broadcast
        above = F.broadcast(
            found.selectExpr(
                "name", "rank", "total_n", "total_sum", "value AS block",
                "below_n AS before_n", "below_sum AS before_sum",
            )
        )
        found = (
            level.join(above, "block")
            .selectExpr(
                "name",
                "rank",
                "total_n",
                "total_sum",
                "v AS value",
                "n AS value_n",
                f"before_n + coalesce(sum(n) OVER (PARTITION BY name ORDER BY v {BEFORE}), 0)"
                " AS below_n",
                f"CAST(before_sum + coalesce(sum(amount) OVER"
                f" (PARTITION BY name ORDER BY v {BEFORE}), 0) AS DECIMAL(38,0)) AS below_sum",
            )
            .where(REACHED)
        )
    return found


def _blocks(level: DataFrame) -> DataFrame:
    """The blocks of a level as values of the next."""
    return level.groupBy(F.col("block").alias("v")).agg(
        F.sum("n").alias("n"), F.expr("CAST(sum(amount) AS DECIMAL(38,0)) AS amount")
    )


def quantile_summary(counts: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """One row: `total_n`, `total_sum` and a column per quantile, linear between neighbours."""
    ranks = {}
    for name, q in quantiles.items():
        ranks[f"{name}_low"] = f"floor((total_n - 1) * {float(q)}D) + 1"
        ranks[f"{name}_high"] = f"ceil((total_n - 1) * {float(q)}D) + 1"

    def picked(name: str) -> str:
        return f"CAST(max(value) FILTER (WHERE name = '{name}') AS DOUBLE)"

    columns = [
        f"{picked(f'{name}_low')}"
        f" + ({picked(f'{name}_high')} - {picked(f'{name}_low')})"
        f" * ((max(total_n) - 1) * {float(q)}D - floor((max(total_n) - 1) * {float(q)}D))"
        f" AS {name}"
        for name, q in quantiles.items()
    ]
    return pick_ranks(counts, ranks).agg(
        F.max("total_n").alias("total_n"),
        F.max("total_sum").alias("total_sum"),
        *map(F.expr, columns),
    )
