"""Shards: exact sizes, gapless slots, nothing lost, and the law of a random permutation."""

from collections import Counter

import numpy as np
import pytest

from patronage.llm import registry, shards


def test_matrix_has_the_sums():
    counts, sizes = np.array([5, 0, 13, 40, 2]), np.array([20, 20, 10, 10, 0])
    rows = np.array([shards.matrix_row(counts, sizes, p, 3) for p in range(5)])
    assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == sizes).all()
    assert (rows >= 0).all()


def test_counts_are_hypergeometric():
    counts, sizes = np.array([3, 3]), np.array([2, 4])
    seen = Counter(int(shards.matrix_row(counts, sizes, 0, s)[0]) for s in range(4_000))
    for k, p in {0: 0.2, 1: 0.6, 2: 0.2}.items():  # C(2,k) C(4,3-k) / C(6,3)
        assert abs(seen[k] / 4_000 - p) < 0.04


def test_large_populations():
    rng = np.random.default_rng(1)
    n, good, bad = 4_000_000, 3 * 10**9, 9 * 10**9
    got = np.array([shards._draw(rng, good, bad, n) for _ in range(400)])
    spread = (n * 0.25 * 0.75) ** 0.5
    assert abs(got.mean() - n / 4) < 5 * spread / 20 and 0.8 < got.std() / spread < 1.2


@pytest.mark.parametrize("n", [0, 1, 23, 24, 500])
def test_sizes_and_slots(documents, n):
    rows = [(None if k % 11 == 0 else k // 2, [None, "", "same", "x" * 3_000][k % 4]) for k in range(n)]
    out = shards.shuffle_to_shards(documents(rows, extra=True), 24, cell_rows=7)
    got = out.select("doc_id", "text", "shard", "slot").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, got)) == sorted(map(key, rows))
    sizes = Counter(r["shard"] for r in got)
    assert n < 24 or set(sizes) == set(range(24))
    assert not sizes or max(sizes.values()) - (min(sizes.values()) if n >= 24 else 0) <= 1
    for s, size in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(size))


def test_repeatable_and_mixed(documents):
    docs = documents([(k, "t") for k in range(2_000)])
    place = lambda seed: {r[0]: (r[2], r[3]) for r in shards.shuffle_to_shards(docs, 4, seed).collect()}
    one = place(0)
    assert one == place(0) != place(1)
    order = [i for i, _ in sorted(one.items(), key=lambda x: x[1])]
    assert abs(np.corrcoef(order, range(2_000))[0, 1]) < 0.1


def test_registered_query(spark, small):
    out = registry.op3_shards(spark, small)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.select("shard", "slot").distinct().count() == out.count()
