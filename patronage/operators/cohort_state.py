"""Cohort cells kept up to date: each step brings new rows, late ones included.

Two tables grow by a part for each step: the (user, period) pairs not seen before, and by how much that
step changes each cell. A late row may move a user's first period back; the user's cells then go from
the old cohort to the new one. A step reads its own rows and the pairs of the users in them, never
the rows of earlier steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.plans.cohorts import Grain, active_pairs, cells_of_counts

PAIRS = "user_id bigint, period date, step int"
CHANGES = "cohort date, age int, change bigint, step int"


@dataclass(frozen=True)
class CohortState:
    """The state under a folder that all executors reach; any session can go on with it."""

    spark: SparkSession
    path: str
    grain: Grain

    def _pairs(self) -> DataFrame:
        return self.spark.read.schema(PAIRS).parquet(f"{self.path}/pairs")

    def _changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.path}/changes")

    def _write(self, df: DataFrame, table: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/step={step}")

    def start(self) -> CohortState:
        """Write an empty state, as step 0."""
        for table, schema in (("pairs", PAIRS), ("changes", CHANGES)):
            self._write(self.spark.createDataFrame([], schema).drop("step"), table, 0)
        return self

    def advance(self, items: DataFrame, step: int) -> CohortState:
        """Take in the rows of a step, from 1 and rising.

        The last step may be repeated, after a failure or with more rows: it replaces what it
        wrote. Rows that earlier steps had already change nothing.
        """
        last, unfinished = self._progress()
        if step < max(1, last):
            raise ValueError(f"step {step} comes after step {last}")
        if unfinished not in (None, step):
            raise ValueError(f"step {unfinished} has not come to its end and must be repeated")
        earlier = self._pairs().where(F.col("step") < step).drop("step")
        seen = active_pairs(items, self.grain).select(
            F.col("user_id").cast("bigint").alias("user_id"), F.col("period").cast("date")
        )
        self._write(seen.join(earlier, ["user_id", "period"], "left_anti"), "pairs", step)

        fresh = self._pairs().where(F.col("step") == step).drop("step")
        before = earlier.join(fresh, "user_id", "left_semi")
        user = Window.partitionBy("user_id")  # a row a period
        old = F.min(F.when(~F.col("is_new"), F.col("period"))).over(user)
        both = (
            before.withColumn("is_new", F.lit(False))
            .unionAll(fresh.withColumn("is_new", F.lit(True)))
            .withColumn("old", old)
            .withColumn("first", F.min("period").over(user))
            .where("is_new OR old <> first")
        )
        into = self._cell("first", 1)
        out = F.when(~F.col("is_new"), self._cell("old", -1))
        cells = both.select(F.explode(F.array(into, out)).alias("cell")).select("cell.*")
        changes = (
            cells.where("cohort IS NOT NULL")
            .groupBy("cohort", "age")
            .agg(F.sum("change").alias("change"))
            .where("change <> 0")
        )
        self._write(changes, "changes", step)
        return self

    def _progress(self) -> tuple[int, int | None]:
        """The last step that brought something, and the one that has written only its pairs.

        What a step adds to all cells together is the number of its pairs.
        """
        pairs = self._pairs().groupBy("step").agg(F.count("*").alias("n"))
        changes = self._changes().groupBy("step").agg(F.sum("change").alias("changed"))
        done = F.coalesce("n", F.lit(0)) == F.coalesce("changed", F.lit(0))
        row = (
            pairs.join(changes, "step", "full")
            .agg(F.coalesce(F.max("step"), F.lit(0)), F.max(F.when(~done, F.col("step"))))
            .first()
        )
        return row[0], row[1]

    def _cell(self, first: str, change: int) -> Column:
        return F.struct(
            F.col(first).alias("cohort"),
            self.grain.gap(F.col("period"), F.col(first)).cast("int").alias("age"),
            F.lit(change).cast("bigint").alias("change"),
        )

    def cells(self) -> DataFrame:
        """As `cohort_cells` of all rows taken in, whatever the order of the steps."""
        counts = self._changes().groupBy("cohort", "age").agg(F.sum("change").alias("active_users"))
        return cells_of_counts(counts.where("active_users > 0"))
