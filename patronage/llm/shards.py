"""A uniform shuffle into shards of exact sizes, with one exchange.

How many rows of each input partition go to each cell of the output (a stretch of a shard's slots)
is drawn first: the counts of a random permutation, a matrix with the partitions' sizes as row sums
and the cells' as column sums (multivariate hypergeometric). The draw splits the partitions in
halves down a tree whose nodes have seeds of their own, so each task draws its own row of the matrix
without seeing the others. It permutes the cells among its rows, the rows are exchanged by cell, and
each cell is put into a random order again. Law `rows`: shard sizes differ by one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronage.llm.work import lean

# A cell is put in order within one task; there are at most MOST_CELLS of them, or a few more.
CELL_ROWS = 1_000
MOST_CELLS = 1 << 17


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    """At most one apart, the larger ones first."""
    return np.full(n_shards, n_rows // n_shards) + (np.arange(n_shards) < n_rows % n_shards)


def cells(n_rows: int, n_shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: its shard, its first slot, its size."""
    shards, firsts, sizes = [], [], []
    for shard, size in enumerate(shard_sizes(n_rows, n_shards).tolist()):
        parts = shard_sizes(size, max(1, -(-size // cell_rows)))
        shards.append(np.full(len(parts), shard))
        sizes.append(parts)
        firsts.append(np.cumsum(parts) - parts)
    return np.concatenate(shards), np.concatenate(firsts), np.concatenate(sizes)


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """How many rows of one partition go to each cell, of the matrix that the seed fixes."""
    low, high, left = 0, len(counts), sizes
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        first = _hypergeometric(rng, left, int(counts[low:middle].sum()))
        if part < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def _hypergeometric(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n balls, drawn without putting back, have each colour; by halves of colours."""
    out = np.zeros(len(left), np.int64)
    before = np.concatenate([[0], np.cumsum(left)])
    todo = [(0, len(left), n)]
    while todo:
        low, high, n = todo.pop()
        if n == 0:
            continue
        if high - low == 1:
            out[low] = n
            continue
        middle = (low + high) // 2
        good, bad = before[middle] - before[low], before[high] - before[middle]
        first = _draw(rng, int(good), int(bad), n)
        todo += [(low, middle, first), (middle, high, n - first)]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number; beyond the size numpy takes, by the ratio of uniforms."""
    if not good or not bad:
        return n if good else 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * (total - n) / (total - 1) + 0.5)
    height = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)

    def weight(x: int) -> float:
        return -sum(math.lgamma(v + 1) for v in (x, good - x, n - x, bad - n + x))

    best = weight(int((n + 1) * (good + 1) / (total + 2)))
    while True:
        u, v = rng.random(2)
        x = math.floor(mean + 0.5 + height * (v - 0.5) / max(u, 1e-300))
        if max(0, n - bad) <= x <= min(n, good) and 2 * math.log(u) <= weight(x) - best:
            return x


def shuffle_to_shards(
    docs: DataFrame, n_shards: int, seed: int = 0, cell_rows: int | None = None
) -> DataFrame:
    """The rows with `shard` (from 0) and `slot` (their place in the shard, gapless from 0).

    All rows take part, whatever they hold, and equal rows are placed each for itself. `docs` must
    be a scan of files: its partitions are read twice and must hold the same rows both times; a task
    that finds another number of rows fails. Columns called `shard` or `slot` are replaced.
    """
    rows = docs.drop("shard", "slot")
    found = rows.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()
    counts = np.zeros(max([r["part"] for r in found], default=-1) + 1, np.int64)
    for r in found:  # one number for each partition
        counts[r["part"]] = r["count"]
    n_rows = int(counts.sum())
    wide = cell_rows or max(CELL_ROWS, -(-n_rows // MOST_CELLS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng([seed, part])
        shard, first, size = cells(n_rows, n_shards, wide)
        own = np.zeros(0, np.int32)
        if part < len(counts):
            row = matrix_row(counts, size, part, seed)
            own = rng.permutation(np.repeat(np.arange(len(size), dtype=np.int32), row))
        for batch in batches:
            n = batch.num_rows
            if at + n > len(own):
                raise RuntimeError("the partitions of the input changed between two reads")
            keys = rng.integers(0, 1 << 62, n)
            cell = own[at : at + n]
            made = (cell, shard[cell].astype(np.int32), first[cell], keys)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, made)],
                names=[*batch.schema.names, "_cell", "shard", "_first", "_key"],
            )
            at += n
        if at != len(own):
            raise RuntimeError("the partitions of the input changed between two reads")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(lean(deal), f"{schema}, _cell int, shard int, _first bigint, _key bigint")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_key")) - 1
    slot = (F.col("_first") + place).cast("bigint")
    return dealt.withColumn("slot", slot).drop("_cell", "_first", "_key")
