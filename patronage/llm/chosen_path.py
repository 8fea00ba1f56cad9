"""Near-duplicate documents by a chosen-path similarity join.

A document is its set of word shingles. Trees branch documents by minwise tokens: at every level a
document follows the least tokens of its set under two hash functions, so similar sets tend to meet
in a node. Nodes of `NODE` rows at most are compared exhaustively; larger ones branch further, and
if they stay large (copies of copies) they are dealt out in blocks. Independent trees repeat this,
as many as the threshold needs for a pair at it to be missed once in a hundred thousand times at most.

Trees can miss a pair, so a last round brings together all that share a shingle among the first of
their sets, in one order of all shingles with the commonest last: sets of which none of these is
shared are not similar. So no pair is missed, whatever the trees did. Each such shingle goes through
one exchange, with its place in the order, the size of the set and a sketch of it, which tell most
pairs apart at once. Long sets show some shingles more, and must then share more than one.

Within a node, pairs pass by an upper bound of their similarity (equal places of a histogram of the
set), and pass to confirmation on the full sets. The rounds keep the pairs few: in the first two
each row offers only its best partner of those before it, and confirmed links join documents into
components; the others take all pairs that still lie in different components. Links within one
component are not looked for, since they would change nothing. Equal sets are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm import words as W
from patronage.llm.components import components
from patronage.llm.work import lean, sifted, written

MISSED = 1e-5  # of the pairs at the threshold, at most
DEPTH = 3  # of all documents
DEEPER = 5  # of those in nodes that are still large
NODE = 2_048
BUCKETS = 256

# Shingles of which so many are seen come last in the order; any order is right, only slower.
COMMON, LISTED = 256, 1 << 17
_SEEN = 4  # of a shingle among those that a task holds at a time, to be counted
_HELD = 1 << 21
# Lists of nodes are sent to all tasks up to this size, which is measured first.
BROADCAST_ROWS = 1 << 18

FEATURES = (
    "doc_id bigint, n bigint, key1 bigint, key2 bigint, minima binary, places binary, prefix binary, "
    "sketch binary"
)
# A sketch has a set's shingles counted in so many cells modulo 16, two cells a byte.
CELLS = 64
MORE = 128  # a shingle more is shown, and must be shared, for so many of a set
_SPREAD = 1 << 16  # rows of one batch
_TRIED = 1 << 18  # pairs at a time


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, their distinct shingle hashes, and each row's place among them."""
    for low, high, data, at in W.chunks(texts):
        starts, ends, word_at = W.word_spans(data, at)
        hashes = W.word_hashes(data, starts, ends)
        shingles, shingle_at = W.shingle_hashes(hashes, word_at, size)
        yield low, high, *W.distinct(shingles, shingle_at)


def trees_for(percent: int) -> int:
    """How many trees bring all but `MISSED` of the pairs at the threshold together.

    Sets of similarity J follow one branch at least of a level with 1 - (1 - J) ** 2, and meet in a
    node of the deepest level if they do so at each.
    """
    met = (1 - (1 - percent / 100) ** 2) ** DEEPER
    return 1 if met >= 1 else math.ceil(math.log(MISSED) / math.log1p(-met))


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _counted(size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()  # in place: there may be many
            starts = np.flatnonzero(np.concatenate([[len(values) > 0], values[1:] != values[:-1]]))
            counts = np.diff(starts, append=len(values))
            some = counts >= _SEEN
            columns = [pa.array(values[starts[some]].view(np.int64)), pa.array(counts[some])]
            return pa.RecordBatch.from_arrays(columns, names=["shingle", "n"])

        for batch in batches:
            for _, _, flat, _ in sets_of(batch.column("text"), size):
                held.append(flat)
                if sum(map(len, held)) >= _HELD:
                    yield flush()
        if held:
            yield flush()

    return counted


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of common shingles, the commonest last, for the order that prefixes follow."""
    counts = docs.select("text").mapInArrow(lean(_counted(size)), "shingle bigint, n bigint")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    most = counts.orderBy(F.desc("n"), "shingle").limit(LISTED).select("shingle").collect()
    return np.array([r["shingle"] for r in most[::-1]], np.int64).view(np.uint64)


def prefixes(flat: np.ndarray, at: np.ndarray, percent: int, common: np.ndarray) -> list[bytes]:
    """Of each set of ascending shingles the first ones, of which similar sets share one at least.

    Of a set of n shingles a similar one has percent * n / 100 at least, so one of the n minus that
    plus one first of each set, in any order that is the same for all sets, is in both. Of k first
    ones more, k more are.
    """
    if len(common) and len(flat):
        sorted_at = np.argsort(common)
        place = np.minimum(np.searchsorted(common, flat, sorter=sorted_at), len(common) - 1)
        place = sorted_at[place]
        rank = np.where(common[place] == flat, place + 1, 0)
        if rank.any():
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            flat = flat[np.lexsort((rank, row))]
    n = np.diff(at)
    most = np.minimum(n, n - -(-percent * n // 100) + 1 + n // MORE)
    ends = at[:-1] + np.where(n > 0, most, 0)
    return [flat[a:b].tobytes() for a, b in zip(at[:-1], ends)]


def sketches(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of the sets of so many rows: (row, CELLS / 2) bytes."""
    cell = row * CELLS + ((flat >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64)
    counts = (np.bincount(cell, minlength=rows * CELLS) & 15).astype(np.uint8).reshape(rows, CELLS)
    return counts[:, ::2] | counts[:, 1::2] << 4


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of shingles that are in one set of two only, by rows of their sketches."""
    total = np.zeros(len(a), np.int64)
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        off = (x - y) & 15
        total += np.minimum(off, 16 - off).sum(axis=1, dtype=np.int64)
    return total


def _features(size: int, trees: int, percent: int, common: np.ndarray):
    functions = trees * DEEPER * 2
    odds = np.random.default_rng(9).integers(1, 1 << 62, functions, dtype=np.uint64) * 2 + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, flat, at in sets_of(batch.column("text"), size):
                n = np.diff(at)
                full = np.flatnonzero(n)
                starts = at[:-1][full]
                sums = np.zeros((2, high - low), np.uint64)
                minima = np.zeros((high - low, functions), np.uint32)
                places = np.zeros((high - low, BUCKETS), np.int64)
                sketch = np.zeros((high - low, CELLS // 2), np.uint8)
                if len(full):
                    with np.errstate(over="ignore"):
                        sums[0, full] = np.add.reduceat(flat, starts)
                        sums[1, full] = np.add.reduceat(W.mixed(flat), starts)
                        for f, odd in enumerate(odds):
                            under = ((flat * odd) >> np.uint64(32)).astype(np.uint32)
                            minima[full, f] = np.minimum.reduceat(under, starts)
                    row = np.repeat(np.arange(high - low), n)
                    cell = row * BUCKETS + (flat >> np.uint64(56)).astype(np.int64)
                    places = np.bincount(cell, minlength=places.size).reshape(places.shape)
                    sketch = sketches(flat, row, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low).cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        *(pa.array(s.view(np.int64)) for s in sums),
                        pa.array([m.tobytes() for m in minima], pa.binary()),
                        # A histogram that a byte cannot hold is left out, and bounds nothing.
                        pa.array(
                            [p.astype(np.uint8).tobytes() if p.max() < 256 else b"" for p in places],
                            pa.binary(),
                        ),
                        pa.array(prefixes(flat, at, percent, common), pa.binary()),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=[f.split()[0] for f in FEATURES.split(", ")],
                )

    return features


def _keys(minima: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """The path of each row to each of its nodes at a depth: (row, 2 ** depth)."""
    own = minima.reshape(len(minima), minima.shape[1] // (DEEPER * 2), DEEPER, 2)
    own = own[:, tree].astype(np.uint64)
    paths = np.full((len(minima), 1), tree + 1, np.uint64)
    with np.errstate(over="ignore"):
        for level in range(depth):
            left = paths * np.uint64(0x2545F4914F6CDD1D) + own[:, level, 0, None] * np.uint64(2)
            right = paths * np.uint64(0x2545F4914F6CDD1D) + own[:, level, 1, None] * np.uint64(2)
            paths = W.mixed(np.concatenate([left, right + np.uint64(1)], axis=1))
    return paths


def _branch(trees: range, depth: int, below: bool):
    """Rows (`doc_id`, `key`) of each document in each of its nodes; of large nodes, one lower."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            blob = b"".join(batch.column("minima").to_pylist())
            minima = np.frombuffer(blob, np.uint32)
            minima = minima.reshape(len(ids), len(minima) // max(len(ids), 1))
            for tree in trees:
                keys = _keys(minima, tree, depth)
                wide = keys.shape[1]
                out = [np.repeat(ids, wide), keys.ravel().view(np.int64)]
                if below:  # child c of 2 ** depth stems from node c modulo 2 ** DEPTH
                    top = _keys(minima, tree, DEPTH)
                    out.append(np.tile(top, (1, wide // top.shape[1])).ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o) for o in out], names=["doc_id", "key", "top"][: len(out)]
                )

    return branch


def nodes(features: DataFrame, trees: range) -> DataFrame:
    """`key`, `doc_id` of the nodes that hold two documents or more, large ones branched further."""
    rows = features.select("doc_id", "minima").mapInArrow(
        lean(_branch(trees, DEPTH, False)), "doc_id bigint, key bigint"
    )
    sizes = rows.groupBy("key").count().where("count > 1")
    sizes = written(sizes, "node-sizes")
    small = rows.join(sizes.where(F.col("count") <= NODE).select("key"), "key")
    large = sizes.where(F.col("count") > NODE).select(F.col("key").alias("top"))
    lower = features.select("doc_id", "minima").mapInArrow(
        lean(_branch(trees, DEEPER, True)), "doc_id bigint, key bigint, top bigint"
    )
    # Large nodes are few: each has more than NODE rows.
    lower = lower.join(_sent(large), "top", "left_semi").select("key", "doc_id")
    return small.select("key", "doc_id").union(lower)


SHINGLES = "key bigint, doc_id bigint, label bigint, n bigint, place int, " + ", ".join(
    f"s{k} bigint" for k in range(CELLS // 16)
)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle in a prefix with its place there and what is known of the set."""
    names = [f.split()[0] for f in SHINGLES.split(", ")]
    for batch in batches:
        blobs = batch.column("prefix").to_pylist()
        many = np.array([len(b) // 8 for b in blobs], np.int64)
        ends = np.cumsum(many)
        low = 0
        while low < len(blobs):
            before = ends[low] - many[low]
            high = max(low + 1, int(np.searchsorted(ends, before + _SPREAD, "right")))
            n, own = many[low:high], slice(low, high)
            known = [np.repeat(batch.column(c).to_numpy()[own], n) for c in ("doc_id", "label", "n")]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()[own]), np.int64)
            sketch = np.repeat(sketch.reshape(high - low, CELLS // 16), n, axis=0)
            columns = [np.frombuffer(b"".join(blobs[own]), np.int64), *known]
            columns += [place.astype(np.int32), *sketch.T.copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            low = high


# Pairs (`a`, `b`) with how often they met and must meet, or members of keys that too many share:
# `key`, the document as `a`, its `label`.
MET = "a bigint, b bigint, times bigint, least bigint, key bigint, label bigint"


def _met(columns: list[np.ndarray | None]) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in MET.split(", ")])


def _tried(rows: list[np.ndarray], sketch: np.ndarray, percent: int) -> Iterator[list[np.ndarray]]:
    """Pairs of rows (key, doc_id, label, n, place), sorted by key and n, that may be similar.

    The first shingle that two similar sets share stands so early in both that what follows, with
    it, is as many as they must share; the second at most one place later, and so on.
    """
    key, ids, labels, n, place = rows
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    both = (group << 40) + n
    # Partners follow, and are not too large.
    ends = np.searchsorted(both, (group << 40) + n * 100 // percent, "right")
    counts = np.maximum(ends - np.arange(len(n)) - 1, 0)
    done = np.cumsum(counts)
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(done, done[low] - counts[low] + _TRIED, "right")))
        c = counts[low:high]
        i = np.repeat(np.arange(low, high), c)
        j = i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        low = high
        other = labels[i] != labels[j]
        i, j = i[other], j[other]
        total = n[i] + n[j]
        least = -(-percent * total // (100 + percent))
        off = least - n[i] // MORE
        good = (place[i] <= n[i] - off) & (place[j] <= n[j] - off)
        i, j, most = i[good], j[good], (total - 2 * least)[good]
        near = apart(sketch[i], sketch[j]) <= most
        i, j = i[near], j[near]
        if len(i):
            x, y = ids[i], ids[j]
            both = np.stack([np.minimum(x, y), np.maximum(x, y), 1 + n[i] // MORE])
            (x, y, needed), times = np.unique(both, axis=1, return_counts=True)
            yield [x, y, times, needed]


def _meet(percent: int):
    """Pairs of the documents of each key, of rows sorted by key and n; members of large keys pass."""
    fields = [f.split()[0] for f in SHINGLES.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        passing: int | None = None  # a key of which members passed

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [rows.column(c).to_numpy().astype(np.int64) for c in fields]
            key, ids, labels = columns[:3]
            _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
            large = counts[at] > NODE
            if passing is not None:
                large |= key == passing
            if large.any():
                yield _met([ids[large], None, None, None, key[large], labels[large]])
            met = ~large & (counts[at] > 1)
            if met.any():
                columns = [c[met] for c in columns]
                sketch = np.stack(columns[5:], axis=1).view(np.uint8)
                for found in _tried(columns[:5], sketch, percent):
                    yield _met([*found, None, None])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from run(table.slice(0, last))
                held = table.slice(last).to_batches()
            if len(key) - last > NODE:
                passing = int(key[-1])
                yield from run(pa.Table.from_batches(held))
                held = []
        if held:
            yield from run(pa.Table.from_batches(held))

    return meet


def _may_be_similar(percent: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blank = bytes(BUCKETS)
            x, y = (
                np.frombuffer(
                    b"".join(p or blank for p in batch.column(c).to_pylist()), np.uint8
                ).reshape(batch.num_rows, BUCKETS)
                for c in ("x", "y")
            )
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            shared = _bound(x, y, n_a, n_b)
            good = 100 * shared >= percent * (n_a + n_b - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return similar


def sharing(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs `a`, `b` of other labels that share a shingle of their prefixes and may be similar."""
    rows = labelled.select("doc_id", "label", "n", "prefix", "sketch").mapInArrow(
        lean(_spread), SHINGLES
    )
    runs = rows.repartition("key").sortWithinPartitions("key", "n")
    met = written(runs.mapInArrow(lean(_meet(percent)), MET), "met")
    # A key is met once; keys that pass do not count here, but any of them makes a pair below.
    often = met.where("key IS NULL").groupBy("a", "b").agg(
        F.sum("times").alias("times"), F.min("least").alias("least")
    )
    pairs = often.where("times >= least").select("a", "b")
    large = met.where("key IS NOT NULL").select("key", F.col("a").alias("doc_id"), "label")
    own = labelled.select("doc_id", "n", "places")
    if not large.isEmpty():
        pairs = pairs.union(_compared(large, own, 3, False, percent))
    pairs = _sent(written(pairs, "meeting"))
    with_a = written(own.toDF("a", "n_a", "x").join(pairs, "a"), "with-a")
    both = with_a.join(own.toDF("b", "n_b", "y"), "b")
    names = ("a", "b", "n_a", "n_b", "x", "y")
    return both.select(*names).mapInArrow(lean(_may_be_similar(percent)), "a bigint, b bigint")


def _bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most that two sets can share, by their histograms; an empty one bounds nothing."""
    shared = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    return np.where((a.any(axis=-1) & b.any(axis=-1)), shared, np.minimum(n_a, n_b))


def _pairs(percent: int, best: bool):
    """Pairs that may be similar, of rows (key, doc_id, label, n, places, side) in runs of one key.

    Rows of a side other than 0 are compared with those of the other side only.
    """

    def of_node(ids, labels, n, places, side) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        values, counts = np.unique(labels, return_counts=True)
        major = labels == values[counts.argmax()]
        # Major rows are met by the others; among themselves they have nothing to find.
        order = np.argsort(~major, kind="stable")
        ids, labels, n, places = ids[order], labels[order], n[order], places[order]
        side = side[order]
        for i in range(int(major.sum()), len(ids)):
            near = np.flatnonzero(
                (labels[:i] != labels[i])
                & ((side[i] == 0) | (side[:i] != side[i]))
                & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
            )
            if not len(near):
                continue
            shared = _bound(places[near], places[i], n[near], n[i])
            union = n[near] + n[i] - shared
            good = 100 * shared >= percent * union
            if best and good.any():
                good = np.array([np.argmax(np.where(good, shared / union, -1.0))])
            left.append(ids[near[good]])
            right.append(np.full(len(left[-1]), ids[i]))
        if not left:
            return ids[:0], ids[:0]
        return np.concatenate(left), np.concatenate(right)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows < 2:
                return
            key = rows.column("key").to_numpy()
            block = rows.column("block").to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            ids, labels, n, side = (
                rows.column(c).to_numpy() for c in ("doc_id", "label", "n", "side")
            )
            blobs = rows.column("places").to_pylist()
            blank = bytes(BUCKETS)
            a, b = [], []
            for low, high in zip([0, *cut], [*cut, len(key)]):
                if high - low > 1 and (labels[low:high] != labels[low]).any():
                    blob = b"".join(x or blank for x in blobs[low:high])
                    places = np.frombuffer(blob, np.uint8).reshape(high - low, BUCKETS)
                    own = slice(low, high)
                    x, y = of_node(ids[own], labels[own], n[own], places, side[own])
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[0]), pa.array(both[1])], names=["a", "b"]
                )

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (block != block[-1])) if len(key) else []
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from run(table.slice(0, done))
                held = table.slice(done).to_batches()
        if held:
            yield from run(pa.Table.from_batches(held))

    return pairs


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; the sets are made again from the texts."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, flat, at in sets_of(batch.column("text"), size):
                blobs = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(blobs, pa.binary())],
                    names=["id", "set"],
                )

    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    some, _ = sifted(docs, asked)
    sets = some.join(asked, "doc_id", "left_semi").mapInArrow(lean(full), "id bigint, set binary")
    sets = written(sets, "sets")
    with_x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return with_y.select("a", "b", "x", "y").mapInArrow(lean(_confirm(percent)), "a bigint, b bigint")


def _blocks(members: DataFrame, salt: int, last: bool) -> DataFrame:
    """Nodes of several labels, in blocks of about NODE rows.

    Most nodes are one block. A larger one is dealt out; in the last round as pairs of blocks, so that
    no pair is missed, each is met once and a task holds two blocks. `side` tells the two apart (0: a
    block with itself). Pairs of blocks of the most frequent label have nothing to find.
    """
    per_label = members.groupBy("key", "label").count()
    most = F.struct("count", "label")
    sizes = per_label.groupBy("key").agg(
        F.count("*").alias("labels"), F.sum("count").alias("rows"), F.max(most).alias("top")
    )
    sizes = sizes.where("labels > 1").select(
        "key",
        F.col("top.label").alias("major"),
        F.ceil(F.col("rows") / NODE).cast("bigint").alias("blocks"),
        F.ceil(F.col("top.count") / NODE).cast("bigint").alias("majors"),
        F.ceil((F.col("rows") - F.col("top.count")) / NODE).cast("bigint").alias("minors"),
    )
    placed = members.join(sizes, "key")
    hashed = F.xxhash64("doc_id", F.lit(salt))
    rest = ("major", "blocks", "majors", "minors")
    if not last:
        one = placed.withColumn("block", F.pmod(hashed, F.col("blocks")))
        return one.withColumn("side", F.lit(0)).drop(*rest)
    zero, whole = F.lit(0).cast("bigint"), F.col("blocks") == 1
    total, is_minor = F.col("minors") + F.col("majors"), F.col("label") != F.col("major")
    own = F.when(is_minor, F.pmod(hashed, F.col("minors"))).otherwise(
        F.col("minors") + F.pmod(hashed, F.col("majors"))
    )
    met = F.sequence(zero, F.when(is_minor, total).otherwise(F.col("minors")) - 1)
    dealt = placed.withColumn("own", F.when(whole, zero).otherwise(own)).withColumn(
        "met", F.explode(F.when(whole, F.array(zero)).otherwise(met))
    )
    least, most = F.least("own", "met"), F.greatest("own", "met")
    side = F.when(F.col("own") == F.col("met"), 0).when(F.col("own") < F.col("met"), 1).otherwise(2)
    return dealt.withColumn("block", least * total + most).withColumn("side", side).drop(
        "own", "met", *rest
    )


def _compared(members: DataFrame, heads: DataFrame, salt: int, best: bool, percent: int) -> DataFrame:
    """Pairs `a`, `b` of the members (`key`, `doc_id`, `label`) of each node that may be similar."""
    dealt = _blocks(members, salt, not best)
    rows = dealt.join(heads.select("doc_id", "n", "places"), "doc_id").select(
        "key", "block", "doc_id", "label", "n", "places", "side"
    )
    runs = rows.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id")
    return runs.mapInArrow(lean(_pairs(percent, best)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (least doc_id reachable), `kept` of each document.

    Two documents are linked if 100 * shared >= percent * all, over distinct shingles of `size`
    words (A-Z lower-cased, parted by bytes 0x20 and 0x09 to 0x0D). A text of fewer words is one
    shingle; without words or null it is empty and linked with nothing. Rows that repeat a doc_id
    are given back as often and take part as one document of several sets; a null doc_id forms no
    links and its row is kept, with a null component. Of equal texts the least doc_id stays.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = texts.where("doc_id IS NOT NULL")
    trees = trees_for(percent)
    made = _features(size, trees, percent, common_shingles(known, size))
    features = written(known.mapInArrow(lean(made), FEATURES), "features")
    same = features.where("n > 0").groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("first"))
    same = written(same, "equal-sets")
    heads = features.join(
        same.select(F.col("first").alias("doc_id"), "key1", "key2", "n"),
        ["doc_id", "key1", "key2", "n"],
    )
    heads = written(heads.dropDuplicates(["doc_id", "key1", "key2", "n"]), "heads")
    labels, links, asked = heads.select(F.col("doc_id").alias("id")).limit(0), None, None
    labels = labels.withColumn("component", F.col("id"))
    rounds = [(range(1), True), (range(trees), True), (range(trees), False), (None, False)]
    for salt, (some, best) in enumerate(rounds):
        if salt < 2:
            placed = written(nodes(heads, some), "nodes")
        found = labels.withColumnRenamed("id", "doc_id")
        label = F.coalesce("component", "doc_id").alias("label")
        if some is None:
            labelled = heads.join(found, "doc_id", "left")
            pairs = sharing(labelled.select("doc_id", label, "n", "places", "prefix", "sketch"), percent)
        else:
            members = placed.join(found, "doc_id", "left").select("key", "doc_id", label)
            pairs = _compared(members, heads, salt, best, percent)
        pairs = pairs.distinct()
        if asked is not None:  # confirmed or not, a pair is asked for once
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        asked = pairs if asked is None else asked.union(pairs)
        new = written(confirmed(pairs, known, size, percent), "confirmed")
        links = new if links is None else links.union(new)
        if not new.isEmpty():
            labels = components(links)
    own = features.join(same, ["n", "key1", "key2"], "left").select("doc_id", "n", "first")
    joined = own.join(labels.withColumnRenamed("id", "first"), "first", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "first", "doc_id").alias("component_id"),
    )
    unknown = texts.where("doc_id IS NULL").mapInArrow(lean(made), FEATURES)
    rest = unknown.select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
    )
    return joined.union(rest).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
