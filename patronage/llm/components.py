"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.work import written


def components(links: DataFrame) -> DataFrame:
    """`id` and `component` (the least id reachable) of all ids in `links` (`a`, `b`).

    Each round passes the least label to the neighbours, then to the label's own label, so paths
    halve; every round is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    labels = written(
        both.groupBy(F.col("a").alias("id")).agg(
            F.least(F.col("id"), F.min("b")).alias("component")
        ),
        "labels",
    )
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).select(
            F.col("a").alias("id"), "component"
        )
        least = heard.union(labels).groupBy("id").agg(F.min("component").alias("component"))
        least = written(least, "labels")
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = least.join(jump, "component").select("id", F.col("next").alias("component"))
        new = written(jumped, "labels")
        moved = new.join(labels.withColumnRenamed("component", "old"), "id")
        if not moved.where("component <> old").limit(1).count():
            return new
        labels = new
