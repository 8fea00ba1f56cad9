"""Bit-sliced top-k against plain inner products."""

import math
import random

import pytest

from patronage.llm import bit_sliced


def brute(vectors, k):
    rows = []
    for i, v in vectors:
        good = i is not None and v and all(x is not None and math.isfinite(x) for x in v)
        if good:
            rows.append((i, [math.floor(256 * x) for x in v]))
    out, done = [], set()
    for i, q in sorted(rows):
        if i % 3 == 0 and i not in done:
            done.add(i)
            scored = [
                (-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q)
            ]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows, query_rows", [(1_000, 64), (7, 3)])
def test_against_brute_force(spark, block_rows, query_rows):
    rng = random.Random(1)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    vectors += [(60 + i, [0.5] * 8) for i in range(25)]  # one very common vector
    vectors += [(100, [0.0] * 8), (102, [-1.0, 1.0] * 4), (3, vectors[3][1]), (7, [0.25] * 8)]
    vectors += [(200, None), (201, []), (202, [1.0, None] * 4), (203, [float("nan")] * 8)]
    vectors += [(9, [0.75] * 8)] * 40  # one row again and again
    vectors += [(204, [float("inf")] * 8), (None, [1.0] * 8), (300, [1.0, 2.0]), (303, [3.0, -2.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    rows = frame.select("vec_id", bit_sliced.quantised().alias("q"))
    out = bit_sliced.top_k(rows, rows.where("vec_id % 3 = 0"), 5, block_rows, query_rows)
    assert sorted(map(tuple, out.collect())) == brute(vectors, 5)


def test_wide_vectors(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    vectors += [(30, [4_096.0, -1e5, 1.0, 0.0]), (31, [-9e4, 5e6, 0.5, 2.0]), (33, [1e7, -1e7, 3.0, 4.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    rows = frame.select("vec_id", bit_sliced.quantised().alias("q"))
    out = bit_sliced.top_k(rows, rows.where("vec_id % 3 = 0"), 5, 16, 4)
    assert sorted(map(tuple, out.collect())) == brute(vectors, 5)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    rows = frame.select("vec_id", bit_sliced.quantised().alias("q"))
    assert bit_sliced.top_k(rows, rows, 5).count() == 0
