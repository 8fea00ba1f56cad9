"""Tables kept in the folder that all executors share, plain or clustered by user."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An analysis by user takes one frame, or several that have no user in common.
ByUser = DataFrame | Sequence[DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="patronage-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """The frame as Parquet at `path`, or under a name of its own in the shared folder."""
    spark = df.sparkSession
    path = path or new_path(spark, "kept")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    Its cleaner does so once the driver has collected their plans, which may otherwise be long after.
    """
    spark.sparkContext._jvm.System.gc()


def parts_of(df: ByUser) -> list[DataFrame]:
    return [df] if isinstance(df, DataFrame) else list(df)


def on_parts(df: ByUser, change: Callable[[DataFrame], DataFrame]) -> ByUser:
    """The frame changed, or each of the frames."""
    return change(df) if isinstance(df, DataFrame) else [change(part) for part in df]


def write_clustered(
    df: DataFrame, path: str, user: str, buckets: int, order: Sequence[str] = ()
) -> ByUser:
    """Write the frame in buckets of users, sorted by user and `order`; returns it as read back.

    Grouping by user, windows by user and joins of two such tables with equally many buckets then
    need no exchange. A user with more rows than a bucket should have would make one task do the
    others' work, so the rows of such users (fewer than there are buckets), and those without a
    user, stand apart in a table that is not bucketed. If there are any, two frames are returned.
    """
    spark = df.sparkSession
    known = df.where(F.col(user).isNotNull())
    counts = keep(known.groupBy(F.col(user).alias("_user")).agg(F.count("*").alias("_rows")))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    heavy = keep(counts.where(F.col("_rows") > max(1, total // buckets)).select("_user"))
    heavy = F.broadcast(heavy)  # fewer rows than buckets
    same = F.col(user) == F.col("_user")
    cold = known.join(heavy, same, "left_anti")
    hot = known.join(heavy, same, "left_semi").unionAll(df.where(F.col(user).isNull()))
    name = f"clustered_{uuid.uuid4().hex}"
    (
        cold.repartition(buckets, user)
        .write.format("parquet")
        .bucketBy(buckets, user)
        .sortBy(user, *order)
        .option("path", f"{path}/buckets")
        .saveAsTable(name)
    )
    hot.write.parquet(f"{path}/apart")
    layout = spark.range(1).select(
        F.lit(user).alias("user"),
        F.lit(buckets).alias("buckets"),
        F.array(*map(F.lit, order)).cast("array<string>").alias("order"),
        F.lit(df.schema.json()).alias("schema"),
    )
    layout.coalesce(1).write.parquet(f"{path}/layout")
    return _opened(spark, path, name, df.schema)


def read_clustered(spark: SparkSession, path: str) -> ByUser:
    """A table that `write_clustered` has written, in this session or another."""
    row = spark.read.parquet(f"{path}/layout").first()
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    name = f"clustered_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sort = ", ".join(f"`{c}`" for c in [row["user"], *row["order"]])
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{row['user']}`)"
        f" SORTED BY ({sort}) INTO {row['buckets']} BUCKETS LOCATION '{path}/buckets'"
    )
    return _opened(spark, path, name, schema)


def _opened(spark: SparkSession, path: str, name: str, schema: T.StructType) -> ByUser:
    hot = spark.read.schema(schema).parquet(f"{path}/apart")
    cold = spark.table(name)
    return [cold, hot] if hot.limit(1).count() else cold
