"""Exact top-k by inner product over a bit-sliced index.

The components of a block of vectors are quantised and kept as slices: a bitmap of the block's
rows for each attribute and binary digit. A query's scores are sums of slices, weighted by the binary
digits of its own components, and are added up for all rows at once with bitmap full adders. The
result is slices again; the top rows are taken from the most significant slice downward, and rows
that tie at the boundary are resolved exactly, by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronage.llm.work import lean, written

BLOCK_ROWS = 1 << 14
QUERY_ROWS = 64
_INDEX = "size int, block bigint, ids binary, values binary, digits int, slices binary"
# Quantised components are longs; a finite one that is not fails the query, as it does its SQL.
LIMIT = float(1 << 63)


def quantised(embedding: str = "embedding", scale: int = 256) -> F.Column:
    """floor(scale * x) of each component as an array of long; null where a vector takes no part."""
    def long(x: F.Column) -> F.Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        wide = F.raise_error(F.lit("a vector's component times the scale is no long")).cast("bigint")
        return F.when(F.abs(scaled) < LIMIT, F.floor(scaled)).otherwise(wide)

    whole = F.transform(embedding, long)
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.when(~bad & (F.size(embedding) > 0), whole)


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps (attribute, digit, 64-row words) of rows of whole numbers.

    Digits count from each attribute's least value, so none is negative.
    """
    low = values.min(axis=0)
    above = (values.view(np.uint64) - low.view(np.uint64)).T  # attribute, row
    digits = max(1, int(above.max()).bit_length())
    rows = -(-values.shape[0] // 64) * 64
    out = np.zeros((above.shape[0], digits, rows // 8), np.uint8)
    for d in range(digits):
        bits = (above >> np.uint64(d) & np.uint64(1)).astype(np.uint8)
        out[:, d, : -(-values.shape[0] // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view(np.uint64)


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Digits, least first, of a number for each row that orders the rows as their scores do.

    A negative weight counts the missing digits instead, which differs by a constant.
    """
    columns: dict[int, list[np.ndarray]] = {}
    for bits, weight in zip(slices, query.tolist()):
        own = bits if weight >= 0 else ~bits
        weight, shift = abs(weight), 0
        while weight >> shift:
            if weight >> shift & 1:
                for d in range(len(own)):
                    columns.setdefault(shift + d, []).append(own[d])
            shift += 1
    out: list[np.ndarray] = []
    place, top = 0, max(columns, default=-1)
    words = slices.shape[2]
    while place <= top:
        stack = columns.pop(place, [])
        bits = np.array(stack) if stack else np.zeros((1, words), np.uint64)
        carried = []
        while len(bits) > 1:
            third = len(bits) // 3
            if third:
                a, b, c = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third]
                half = a ^ b
                carried.append(a & b | half & c)
                bits = np.concatenate([half ^ c, bits[3 * third :]])
            else:
                carried.append((bits[0] & bits[1])[None])
                bits = (bits[0] ^ bits[1])[None]
        out.append(bits[0])
        if carried:
            columns.setdefault(place + 1, []).extend(np.concatenate(carried))
            top = max(top, place + 1)
        place += 1
    return out


def top_rows(digits: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely among the k highest, and of those that tie for what is left."""
    sure, tied = np.zeros_like(allowed), allowed
    for bits in reversed(digits):
        high = tied & bits
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure |= high
            tied = tied & ~bits
            if n == k:
                return sure, np.zeros_like(tied)
    return sure, tied


def _members(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    found = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return found if most is None else found[:most]


def _index(block: pd.DataFrame) -> pd.DataFrame:
    """One row: the block's ids (ascending), values and slices."""
    block = block.sort_values("vec_id", kind="stable")
    values = np.stack(block["q"].to_numpy()).astype(np.int64)
    slices = slices_of(values)
    narrow = values.astype(np.int32)
    kept = narrow if (narrow == values).all() else values
    return pd.DataFrame(
        {
            "size": [values.shape[1]],
            "block": [block["block"].iloc[0]],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "values": [kept.tobytes()],
            "digits": [slices.shape[1]],
            "slices": [slices.tobytes()],
        }
    )


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                size = len(row["queries"][0])
                kind = np.int32 if len(row["values"]) == 4 * len(ids) * size else np.int64
                values = np.frombuffer(row["values"], kind).reshape(len(ids), -1)
                most = max(abs(int(values.min())), int(values.max()))
                slices = np.frombuffer(row["slices"], np.uint64)
                slices = slices.reshape(values.shape[1], row["digits"], -1)
                everyone = np.zeros(slices.shape[2] * 8, np.uint8)
                everyone[: -(-len(ids) // 8)] = np.packbits(
                    np.ones(len(ids), np.uint8), bitorder="little"
                )
                everyone = everyone.view(np.uint64)
                out: list[tuple[int, int, int]] = []
                for query_id, q in zip(row["query_ids"], row["queries"]):
                    query = np.array(q, np.int64)
                    allowed = everyone.copy()
                    low, high = np.searchsorted(ids, [query_id, query_id + 1])
                    for own in range(low, high):
                        allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    sure, tied = top_rows(score_slices(slices, query), allowed, k)
                    some = _members(sure)
                    some = np.concatenate([some, _members(tied, k - len(some))])
                    exact = np.int64
                    if most * sum(map(abs, q)) >= 1 << 63:
                        exact = object  # whole numbers of any size; a top score must be a long
                    scores = values[some].astype(exact) @ query.astype(exact)
                    out += zip([query_id] * len(some), ids[some].tolist(), scores.tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
                    names=["query_id", "vec_id", "score"],
                )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` of each query's k highest inner products.

    Both frames have `vec_id` and `q`, an array of whole numbers (`quantised`). Rows with a null in
    either take no part, and vectors meet only queries of their own length. A query's own row, known
    by its `vec_id`, is no candidate. Of queries that share an id the least vector counts; rows that
    repeat a `vec_id` are candidates each for itself. Ties go to the smaller `vec_id`.

    The index is of blocks of about `block_rows` rows. The queries, in blocks of `query_rows`, meet
    each index block once: the work is their number times the rows, and a task holds one pair of
    blocks.
    """
    rows = vectors.select("vec_id", "q").where("vec_id IS NOT NULL AND q IS NOT NULL")
    asked = queries.select("vec_id", "q").where("vec_id IS NOT NULL AND q IS NOT NULL")
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q"))
    # Of equal rows, no more than k can be among the k highest: they are counted, and dealt out as
    # so many, so that a row that repeats endlessly makes no block longer.
    copies = rows.groupBy("vec_id", "q").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    copies = copies.select("vec_id", "q", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("n"))
    copies = written(copies.drop("n"), "vectors")
    n_rows, n_asked = copies.count(), asked.count()
    blocks, groups = max(1, -(-n_rows // block_rows)), max(1, -(-n_asked // query_rows))
    size = F.size("q").alias("size")
    spread = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))
    index = (
        copies.select("vec_id", "q", size, spread.alias("block"))
        .groupBy("size", "block")
        .applyInPandas(_index, _INDEX)
    )
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    listed = (
        asked.select("query_id", "q", size, group.alias("part"))
        .groupBy("size", "part")
        .agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("q").alias("queries"))
    )
    # The groups of queries go to the blocks: they are some hundred times smaller.
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    sent = listed.withColumn("block", every).drop("part").repartition(blocks, "size", "block")
    pairs = sent.join(index.repartition(blocks, "size", "block"), ["size", "block"])
    near = pairs.drop("block", "size").mapInArrow(
        lean(_search(k)), "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
