"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.plans.keys import complete_keys


def equal_width_histogram(counts: DataFrame, bins: int, out: str = "users") -> DataFrame:
    """`bin, lo, hi, <out>, mean` over values `v` that stand for `n` rows each.

    Bins are numbered from 1 and closed below; the last is closed above as well. A single
    distinct value is widened by half a unit both ways. No values, no rows.
    """
    known = counts.where("v IS NOT NULL")
    least, most = (end.cast("double") for end in (F.min("v"), F.max("v")))
    half = F.when(least == most, F.lit(0.5)).otherwise(F.lit(0.0))
    lo, hi = least - half, most + half
    # the sum is taken in the values' own type: exact for money and days
    total = F.sum(F.col("v") * F.col("n")).cast("double")
    shape = known.agg(
        F.struct(
            lo.alias("lo"),
            hi.alias("hi"),
            ((hi - lo) / bins).alias("step"),
            (total / F.sum("n")).alias("mean"),
        )
    ).scalar()

    def edge(index: Column) -> Column:
        return F.col("shape.lo") + index * F.col("shape.step")

    value, last = F.col("v"), F.lit(bins - 1)
    place = (value - F.col("shape.lo")) / (F.col("shape.hi") - F.col("shape.lo")) * bins
    values = known.select(value.cast("double").alias("v"), "n")
    shaped = values.withColumn("shape", shape).withColumn(
        "guess", F.least(F.floor(place).cast("int"), last)
    )
    # The edges decide, not the division: move a value the rounding put next door.
    guess = F.col("guess")
    slot = (
        F.when(value < edge(guess), guess - 1)
        .when((guess < last) & (value >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    filled = shaped.groupBy(slot.alias("slot")).agg(F.sum("n").alias(out))
    at = F.col("slot")
    return (
        complete_keys(filled, "slot", bins)
        .withColumn("shape", shape)
        .where(F.col("shape.lo").isNotNull())
        .select(
            (at + 1).alias("bin"),
            edge(at).alias("lo"),
            F.when(at == last, F.col("shape.hi")).otherwise(edge(at + 1)).alias("hi"),
            F.coalesce(F.col(out), F.lit(0)).alias(out),
            F.col("shape.mean").alias("mean"),
        )
    )
