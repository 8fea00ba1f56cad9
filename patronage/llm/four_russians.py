"""Hard negatives by inner products from tables of subset sums.

Rows are kept in blocks as bit planes: for each binary digit and each eight dimensions a byte per row.
Of an anchor and eight dimensions there are 256 sums of its components, one for each byte. A score is
then looked up and not multiplied out: for each digit the sums that the row's bytes point at are
added over all dimensions, and the digits' totals are shifted and added. Tables of a group of anchors
lie side by side, so one look-up fetches the sums of them all. Whole numbers only: scores are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronage.llm.work import lean, written

BLOCK_ROWS = 1 << 13
ANCHORS = 256  # whose tables lie side by side
_STEP = 1 << 10  # rows scored at a time
GROUP = 8  # dimensions of a table

_INDEX = pa.schema(
    [
        ("size", pa.int32()),
        ("block", pa.int64()),
        ("ids", pa.binary()),
        ("labels", pa.binary()),
        ("copies", pa.binary()),
        ("digits", pa.int32()),
        ("planes", pa.binary()),
    ]
)
_INDEX_SQL = (
    "size int, block bigint, ids binary, labels binary, copies binary, digits int, planes binary"
)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bytes (digit, eight dimensions, row) of rows of whole numbers, in two's complement.

    The last digit is the sign's. Missing dimensions of the last eight are zero.
    """
    rows, size = values.shape
    widest = max(int(values.max(initial=0)), ~int(values.min(initial=0)))
    digits = widest.bit_length() + 1
    wide = np.zeros((rows, -(-size // GROUP) * GROUP), np.int64)
    wide[:, :size] = values
    out = np.empty((digits, wide.shape[1] // GROUP, rows), np.uint8)
    for d in range(digits):
        bits = (wide >> min(d, 63) & 1).astype(np.uint8)
        out[d] = np.packbits(bits, axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, digits: int) -> np.ndarray:
    """Sums (eight dimensions, byte, anchor) of the components that each byte chooses.

    As 32-bit numbers where no score with rows of so many digits can be too long for them, or as
    64-bit ones, or as whole numbers of any length.
    """
    n, size = anchors.shape
    most = max((sum(map(abs, a)) for a in anchors.tolist()), default=0) << (digits - 1)
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    wide = np.zeros((n, -(-size // GROUP) * GROUP), kind)
    wide[:, :size] = anchors
    out = np.zeros((wide.shape[1] // GROUP, 1 << GROUP, n), kind)
    for i in range(GROUP):
        own = wide[:, i::GROUP].T[:, None, :]
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + own
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (row, anchor) by look-up, shift and addition."""
    out = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    for d in range(len(planes) - 1, -1, -1):  # the sign's digit counts negative
        out *= 2 if d < len(planes) - 1 else 0
        for table, chosen in zip(sums, planes[d]):
            if d == len(planes) - 1:
                out -= table[chosen]
            else:
                out += table[chosen]
    return out


def _best(
    found: np.ndarray, allowed: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and rows of the k highest allowed scores of each anchor, ties by smaller id.

    `found` and `allowed` are (row, anchor); a row counts as often as it has copies.
    """
    if found.dtype == object:
        row, anchor = np.nonzero(allowed)
    else:
        least = np.iinfo(found.dtype).min
        held = np.where(allowed, found, least)
        edge = np.partition(held, max(len(held) - k, 0), axis=0)[max(len(held) - k, 0)]
        row, anchor = np.nonzero((held >= edge) & allowed)
    order = np.lexsort((ids[row], _descending(found[row, anchor]), anchor))
    row, anchor = row[order], anchor[order]
    n = np.minimum(copies[row], k)
    row, anchor = np.repeat(row, n), np.repeat(anchor, n)
    first = np.searchsorted(anchor, anchor)
    kept = np.arange(len(anchor)) - first < k
    return anchor[kept], row[kept]


def _descending(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:  # whole numbers of any length: their places in order
        return -np.unique(values, return_inverse=True)[1] if len(values) else np.zeros(0, int)
    return -values.astype(np.int64)


# Of an anchor group's scores of some rows: the place of a positive, anchors and rows.
Pick = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]


def _first(out: list[list], k: int) -> pa.RecordBatch:
    """Of a block's picks, the k highest of each anchor and place."""
    columns = [np.array(c, np.int64) for c in out]
    columns = [c[np.lexsort((columns[2], -columns[3], columns[1], columns[0]))] for c in columns]
    new = np.ones(len(columns[0]), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    begins = np.flatnonzero(new)
    kept = np.arange(len(new)) - begins[np.cumsum(new) - 1] < k if len(new) else new
    return pa.RecordBatch.from_arrays(
        [pa.array(c[kept]) for c in columns], names=["anchor_id", "place", "vec_id", "score"]
    )


def _search(pick: Pick, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                labels = np.frombuffer(row["labels"], np.int64)
                copies = np.frombuffer(row["copies"], np.int64)
                planes = np.frombuffer(row["planes"], np.uint8)
                planes = planes.reshape(row["digits"], -1, len(ids))
                anchors = row["anchors"]
                vectors = np.array([a["q"] for a in anchors], np.int64)
                sums = subset_sums(vectors.reshape(len(anchors), -1), row["digits"])
                own = np.array([a["anchor_id"] for a in anchors], np.int64)
                out: list[list] = [[], [], [], []]
                for low in range(0, len(ids), _STEP):
                    part = slice(low, low + _STEP)
                    found = scores(sums, planes[:, :, part])
                    others = ids[part, None] != own[None]
                    for place, anchor, chosen in pick(
                        row, found, others, ids[part], labels[part], copies[part]
                    ):
                        out[0] += own[anchor].tolist()
                        out[1] += [place] * len(anchor)
                        out[2] += ids[part][chosen].tolist()
                        out[3] += found[chosen, anchor].tolist()
                yield _first(out, k)

    return lean(search)


def _same_label(k: int) -> Pick:
    def pick(row, found, others, ids, labels, copies):
        own = np.array([a["label"] for a in row["anchors"]], np.int64)
        yield 0, *_best(found, others & (labels[:, None] == own[None]), ids, copies, k)

    return pick


def _below(k: int) -> Pick:
    """The k highest of another label between the least and the most of each positive."""

    def pick(row, found, others, ids, labels, copies):
        anchors = row["anchors"]
        own = np.array([a["label"] for a in anchors], np.int64)
        other = others & (labels[:, None] != own[None])
        for place in sorted({p["place"] for a in anchors for p in a["positives"]}):
            spans = [
                next(((p["least"], p["most"]) for p in a["positives"] if p["place"] == place), (1, 0))
                for a in anchors
            ]
            low, high = np.array(spans, np.int64).T
            inside = other & (found >= low[None]) & (found <= high[None])
            if inside.any():
                yield place, *_best(found, inside, ids, copies, k)

    return pick


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Blocks of bit planes of the distinct (`vec_id`, `label`, `q`), written; and how many blocks.

    Equal rows are one row with a number of copies, counted before the rows are dealt out, so
    that a row that repeats endlessly makes no block longer.
    """
    known = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(q) > 0")
    rows = known.groupBy("vec_id", "label", "q").agg(F.count("*").alias("copies"))
    rows = written(rows, "vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)).alias("block")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        size = key[0].as_py()
        q = table.column("q").combine_chunks()
        planes = bit_planes(q.flatten().to_numpy().reshape(len(table), size))
        ids, labels, copies = (table.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
        values = [size, key[1].as_py(), ids.tobytes(), labels.tobytes(), copies.tobytes()]
        values += [len(planes), planes.tobytes()]
        return pa.Table.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, _INDEX)], schema=_INDEX
        )

    grouped = rows.select("*", F.size("q").alias("size"), block).groupBy("size", "block")
    return written(grouped.applyInArrow(build, _INDEX_SQL), "planes"), blocks


def _meet(
    index: DataFrame, blocks: int, anchors: DataFrame, pick: Pick, k: int, group: int
) -> DataFrame:
    """What `pick` takes of each block for each anchor.

    Anchors in groups go to the blocks, not the other way round: a group is some kilobytes. A task
    holds one group and one block.
    """
    parts = max(1, -(-anchors.count() // group))
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part")
    fields = [F.col(c) for c in anchors.columns]
    grouped = (
        anchors.select(F.size("q").alias("size"), part, F.struct(*fields).alias("anchor"))
        .groupBy("size", "part")
        .agg(F.collect_list("anchor").alias("anchors"))
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    sent = grouped.select("size", "anchors", every.alias("block")).repartition(blocks, "size", "block")
    pairs = sent.join(index.repartition(blocks, "size", "block"), ["size", "block"])
    return pairs.mapInArrow(
        _search(pick, k), "anchor_id bigint, place bigint, vec_id bigint, score bigint"
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    block_rows: int = BLOCK_ROWS,
    group: int = ANCHORS,
) -> DataFrame:
    """For each anchor and positive, rows of another label that score nearly as high as it.

    `vectors` has `vec_id`, `label` and `q`, an array of whole numbers; rows with a null or an
    empty vector take no part, and vectors meet those of their own length only. `anchors` says which
    rows ask. An anchor's positives are the highest scores of its own label, its negatives the
    highest of another between the two percentages of the positive's score; ties go to the smaller
    `vec_id`. A row is no partner of an anchor of the same `vec_id`. Rows that repeat are partners
    each for itself; of anchors that share an id the least label and vector counts.

    Result: `anchor_id`, `positive_id`, `rank` (from 1), `negative_id`, `positive_score` and
    `negative_score`. A positive without negatives has no row. Other columns are not looked at. A
    score among the results that is no long fails the job.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("q").cast("array<bigint>").alias("q"),
    )
    index, blocks = build_index(rows, block_rows)
    asked = rows.where(anchors & F.col("label").isNotNull() & (F.size("q") > 0))
    asked = (
        asked.groupBy(F.col("vec_id").alias("anchor_id"))
        .agg(F.min(F.struct("label", "q")).alias("least"))
        .select("anchor_id", "least.label", "least.q")
    )
    near = _meet(index, blocks, asked, _same_label(positives), positives, group)
    near = _ranked(near, positives).select(
        "anchor_id",
        F.col("rank").cast("bigint").alias("place"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    near = written(near, "positives")
    # 100 * score within the two percentages of the positive's, in whole numbers
    wide = F.col("positive_score").cast("decimal(38,0)")
    bound = F.struct(
        "place",
        F.ceil(wide * least_percent / 100).cast("bigint").alias("least"),
        F.floor(wide * most_percent / 100).cast("bigint").alias("most"),
    )
    bounds = near.groupBy("anchor_id").agg(F.collect_list(bound).alias("positives"))
    bounded = asked.join(bounds, "anchor_id")
    found = _meet(index, blocks, bounded, _below(negatives), negatives, group)
    best = _ranked(found, negatives).select(
        "anchor_id",
        "place",
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return near.join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
