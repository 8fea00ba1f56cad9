"""Where intermediate tables go, and how rows reach Python tasks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Texts are long: batches to Python tasks are kept to some megabytes on either side.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
# A sieve of keys has so many bits, whatever the keys; of them, one bitmap of Spark's holds 2^15.
SIEVE_BITS, _MAP_BITS = 1 << 24, 1 << 15
_PREPARED: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def prepare(spark: SparkSession) -> None:
    """Set the size of batches, once a session."""
    if spark not in _PREPARED:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        _PREPARED.add(spark)


def small_batches(spark: SparkSession) -> None:
    """From now on batches of few megabytes, for jobs whose executors hold much already."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="patronage-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later failures do not compute it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    prepare(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sifted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among `keys` (columns of `rows`), and those whose key is not.

    The keys' hashes are marked in bitmaps of 2 MB in all, which go to all tasks. So long texts that
    a join has nothing for stay where they are; the others, with a few that only share a bit, are
    to be joined as they would be anyway.
    """
    names, kinds = keys.columns, {f.name: f.dataType for f in keys.schema.fields}
    place, own = "place", "bits"
    while {place, own} & {*rows.columns}:
        place, own = f"{place}_", f"{own}_"

    def bit_of(frame: DataFrame) -> F.Column:
        hashed = F.xxhash64(*(frame[c].cast(kinds[c]) for c in names))
        return F.pmod(hashed, F.lit(SIEVE_BITS))

    def map_of(bit: F.Column) -> F.Column:
        return F.floor(bit / _MAP_BITS).cast("int")

    bit = bit_of(keys)
    marked = keys.select(map_of(bit).alias(place), F.pmod(bit, F.lit(_MAP_BITS)).alias("bit"))
    maps = marked.repartition(place).groupBy(place).agg(F.bitmap_construct_agg("bit").alias(own))
    maps = F.broadcast(written(maps, "sieve"))
    bit = bit_of(rows)
    inside = F.pmod(bit, F.lit(_MAP_BITS)).cast("int")
    byte = F.substring(F.col(own), F.floor(inside / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(value, inside % 8) == 1, F.lit(False))
    met = rows.join(maps, map_of(bit) == F.col(place), "left")
    return met.where(hit).select(*rows.columns), met.where(~hit).select(*rows.columns)


def give_back() -> None:
    """Return freed memory to the system; idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The task, giving its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as str, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]
