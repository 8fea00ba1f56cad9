"""Quantiles from small summaries that can be kept by group and put together for any of them.

A summary stands for the values of a group by `points` of them: the k-th has the rank k/points of the
way and the weight of the ranks since the one before. Counted up to any value, its weights differ
from the true rank by less than a point's share of the group and one. Summaries are added by putting
their rows together, and the errors add up: over any choice of groups the rank is off by less than
1/points of all the rows chosen, and one for each summary.

A large group is summarised in `splits` parts, each by a task of its own, with the same error.
Unlike randomised sketches the result depends on the rows alone, whatever task saw them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.plans.ranks import merge_counts, quantile_summary

POINTS = 1_000
SPLITS = 8


def summarise(
    df: DataFrame,
    value: Column,
    groups: Sequence[str] = (),
    points: int = POINTS,
    splits: int = SPLITS,
    spread: Column | None = None,
) -> DataFrame:
    """`groups`, `part`, `v` and the weight `n`: at most `points` rows for each group and part.

    `value` is a whole number; rows without one take no part, a null group is a group. `spread`, a
    whole number, deals the rows out over `splits` parts; without it their own hash does.
    """
    if spread is None:
        spread = F.xxhash64(*df.columns)
    rows = df.select(
        *groups,
        F.coalesce(F.pmod(spread, F.lit(splits)), F.lit(0)).cast("int").alias("part"),
        value.cast("bigint").alias("v"),
    ).where("v IS NOT NULL")
    counts = rows.groupBy(*groups, "part", "v").agg(F.count("*").alias("n"))
    whole = f"PARTITION BY {', '.join([*groups, 'part'])}"
    ranked = counts.selectExpr(
        "*", f"sum(n) OVER ({whole} ORDER BY v) AS upto", f"sum(n) OVER ({whole}) AS total"
    )
    # Points up to a rank, the k-th of which has the rank ceil(k * total / points).
    last, before = (f"(({r}) * {points}L DIV total)" for r in ("upto", "upto - n"))
    weight = " - ".join(f"({k} * total + {points - 1}) DIV {points}L" for k in (last, before))
    return ranked.selectExpr(*groups, "part", "v", f"{weight} AS n").where("n > 0")


def quantiles(summaries: DataFrame, wanted: Mapping[str, float]) -> DataFrame:
    """One row: `total_n` and a column per quantile of all the rows that the summaries stand for.

    Take those of the groups asked for, `summaries.where(...)`, or of several tables together.
    """
    return quantile_summary(merge_counts(summaries.select("v", "n")), wanted)


def rank_error(summaries: DataFrame, groups: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """One row: `rank_error`, what any rank of `quantiles` over these summaries is off by at most."""
    sizes = summaries.groupBy(*groups, "part").agg(F.sum("n").alias("n"))
    # a group of no more rows than points is kept whole
    off = F.when(F.col("n") > points, F.ceil(F.col("n") / points) + 1).otherwise(0)
    return sizes.agg(F.coalesce(F.sum(off), F.lit(0)).cast("bigint").alias("rank_error"))
