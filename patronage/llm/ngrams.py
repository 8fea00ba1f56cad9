"""Indicator features of whole texts: which of the chosen n-grams each holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm import words as W
from patronage.llm.work import lean, written

# Of a chunk's texts: all n-grams (64-bit hashes) with the row of each.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

# Places whose counts make one row.
COUNTED = 1 << 12

# Of labels: some bytes each.
BROADCAST_ROWS = 1 << 20

# Anything but ASCII letters, digits and non-ASCII parts these words.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _rows(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def words_and_stems(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of letters and digits, and the first four and five bytes of longer ones."""
    starts, ends, word_at = W.word_spans(data, at, MARKS)
    row, values, rows = _rows(word_at), [W.word_hashes(data, starts, ends)], []
    rows.append(row)
    for size in (4, 5):
        long = ends - starts > size
        stems = W.word_hashes(data, starts[long], starts[long] + size)
        values.append(W.mixed(stems + np.uint64(size)))
        rows.append(row[long])
    return np.concatenate(values), np.concatenate(rows)


def _kinds() -> np.ndarray:
    """A bit for each kind of byte: capitals, small letters, digits, non-ASCII, each other mark."""
    kinds, bit = np.zeros(256, np.uint64), 4
    for b in range(256):
        char = chr(b)
        if b > 127:
            kinds[b] = 8
        elif char.isupper():
            kinds[b] = 1
        elif char.islower():
            kinds[b] = 2
        elif char.isdigit():
            kinds[b] = 4
        elif b > 32 and b < 127:
            kinds[b] = 1 << bit
            bit += 1
    return kinds


_KINDS = _kinds()


def words_and_shapes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One and two words, and one to three word shapes.

    A shape is the set of kinds of a word's bytes, and whether the word repeats the one before.
    """
    starts, ends, word_at = W.word_spans(data, at)
    words, row = W.word_hashes(data, starts, ends), _rows(word_at)
    if not len(words):
        return words, row
    shapes = np.bitwise_or.reduceat(_KINDS[data], starts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shapes = W.mixed(shapes * np.uint64(2) + same.astype(np.uint64) + np.uint64(1 << 50))
    values, rows = [words], [row]
    for units, most in ((words, 2), (shapes, 3)):
        joint = units
        if units is shapes:
            values.append(units)
            rows.append(row)
        for k in range(1, most):
            inside = row[k:] == row[:-k]
            with np.errstate(over="ignore"):
                joint = W.mixed(joint[:-1] * W._MIX + units[k:] + np.uint64(k))
            values.append(joint[inside])
            rows.append(row[k:][inside])
    return np.concatenate(values), np.concatenate(rows)


def indicators(
    texts: pa.Array, features: Features, chosen: np.ndarray | None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, and (row, n-gram) pairs without repetition, by row.

    With `chosen` (ascending), only those n-grams, as places in it.
    """
    for low, high, data, at in W.chunks(texts):
        values, rows = features(data, at)
        if chosen is not None:
            if not len(chosen):
                values, rows = values[:0], rows[:0]
            places = np.minimum(np.searchsorted(chosen, values), max(len(chosen) - 1, 0))
            kept = chosen[places] == values if len(values) else np.zeros(0, bool)
            values, rows = places[kept], rows[kept]
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        first = np.ones(len(values), bool)
        first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        yield low, high, rows[first], values[first]


def frequent(rows: DataFrame, features: Features, least: int, most: int) -> np.ndarray:
    """The n-grams of at least `least` of the rows, ascending; of more than `most`, the commonest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, values in indicators(batch.column("text"), features, None):
                found, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(n)], names=["gram", "n"]
                )

    counted = rows.select("text").mapInArrow(lean(count), "gram bigint, n bigint")
    common = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = common.orderBy(F.desc("n"), "gram").limit(most).select("gram").toArrow()
    return np.sort(kept.column("gram").to_numpy().view(np.uint64))


def counts(
    rows: DataFrame, features: Features, chosen: np.ndarray, targets: list[str]
) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, 1 + targets): rows that hold each, all and those of each target; and such totals.

    A task gives its counts in blocks of places, so it makes as many rows whatever it has met.
    """
    width = 1 + len(targets)
    size = len(chosen) + 1  # the last place has the totals
    blocks = -(-size // COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((blocks * COUNTED, width), np.int64)
        for batch in batches:
            marks = np.stack(
                [np.ones(batch.num_rows, np.int64)]
                + [batch.column(t).to_numpy(zero_copy_only=False) for t in targets],
                axis=1,
            )
            found[size - 1] += marks.sum(axis=0)
            for low, _, row, place in indicators(batch.column("text"), features, chosen):
                for t in range(width):
                    found[: size - 1, t] += np.bincount(
                        place, marks[low + row, t], minlength=size - 1
                    ).astype(np.int64)
        if found[size - 1, 0]:
            yield _blocks(dict(enumerate(found.reshape(blocks, COUNTED, width))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(*(batch.column(c).to_pylist() for c in ("block", "counts"))):
                own = np.frombuffer(data, np.int64).reshape(COUNTED, width)
                sums[block] = sums[block] + own if block in sums else own
        if sums:
            yield _blocks(sums)

    schema = "block int, counts binary"
    counted = rows.select("text", *targets).mapInArrow(lean(count), schema)
    summed = counted.repartition("block").mapInArrow(lean(add), schema).toArrow()
    out = np.zeros((blocks, COUNTED, width), np.int64)
    for block, data in zip(*(summed.column(c).to_pylist() for c in ("block", "counts"))):
        out[block] = np.frombuffer(data, np.int64).reshape(COUNTED, width)
    flat = out.reshape(-1, width)[:size]
    return flat[:-1], flat[-1]


def _blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())],
        names=["block", "counts"],
    )


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that have labels, with them; rows without a doc_id have none.

    Labels are broadcast up to BROADCAST_ROWS rows, which are counted first, so that the texts are
    not shuffled. Beyond that both sides are, and the result is written once.
    """
    if labels.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(labels), "doc_id")
    return written(docs.join(labels, "doc_id"), "labelled")


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of doc_id and text."""
    share = min(1.0, most / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    return rows.where(place < int(share * (1 << 30)))
