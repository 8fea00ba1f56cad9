"""Documents packed into sequences of a fixed number of tokens by bounded-space best fit.

A task holds some open windows. A document's tokens are put into the window that they fit best; what
is longer than a window fills windows of its own first. If a piece fits nowhere, the fullest window
goes out: as it is if next to nothing is free in it, else filled up with the head of that piece. The
windows a task has open at its end are packed together with those of its neighbours, some tasks'
at a time, until one group is left, whose last windows are cut into full ones and a rest. The rest
goes out by powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.pieces import byte_level_ids, id_type, slices
from patronage.llm.work import lean, written

WINDOW = 2_048
OPEN_WINDOWS = 64
SLACK = 8  # free places that a window may go out with
MERGED = 8  # tasks whose open windows are packed together
END_ID = 1
_ROWS = 512

# One piece of a document: ids, doc_id, place of the first id in the document, ids of the document.
Piece = tuple[np.ndarray, int | None, int, int]

_PIECES = pa.list_(
    pa.struct(
        [
            ("doc_id", pa.int64()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("doc_tokens", pa.int64()),
            ("offset", pa.int64()),
        ]
    )
)
_OUT = pa.schema(
    [
        ("part", pa.int64()),
        ("number", pa.int64()),
        ("length", pa.int64()),
        ("pieces", _PIECES),
        ("ids", pa.binary()),
        ("open_ids", pa.binary()),
    ]
)
_SCHEMA = (
    "part bigint, number bigint, length bigint, pieces array<struct<doc_id:bigint,start:bigint,"
    "length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint>>, ids binary, open_ids binary"
)


class Packer:
    """The open windows of a task; `put` gives back the windows that go out."""

    def __init__(self, window: int, most: int, slack: int):
        self.window, self.most, self.slack = window, most, slack
        self.held: dict[int, list[Piece]] = {}
        self.free: list[tuple[int, int]] = []  # free places of each open window, ascending
        self.count = 0

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece is not None:
            n = len(piece[0])
            if n >= self.window:
                head, piece = _cut(piece, self.window)
                yield [head]
                continue
            at = bisect_left(self.free, (n, -1))
            if at < len(self.free):
                room, key = self.free.pop(at)
                self.held[key].append(piece)
                if room == n:
                    yield self.held.pop(key)
                else:
                    insort(self.free, (room - n, key))
                return
            if len(self.free) < self.most:
                self.held[self.count] = [piece]
                insort(self.free, (self.window - n, self.count))
                self.count += 1
                return
            room, key = self.free.pop(0)  # the fullest
            if room > self.slack:
                head, piece = _cut(piece, room)
                self.held[key].append(head)
            yield self.held.pop(key)

    def rest(self) -> Iterator[list[Piece]]:
        for _, key in self.free:
            yield self.held[key]


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece | None]:
    ids, doc_id, start, total = piece
    tail = (ids[n:], doc_id, start + n, total) if len(ids) > n else None
    return (ids[:n], doc_id, start, total), tail


def in_powers(pieces: list[Piece], window: int, slack: int) -> Iterator[list[Piece]]:
    """The pieces one after the other, in full windows and then in ever smaller powers of two."""
    left = sum(len(p[0]) for p in pieces)
    waiting = pieces[::-1]
    while left:
        size = window if left >= window - slack else 1 << (left.bit_length() - 1)
        size = min(size, left)
        left -= size
        out = []
        while size:
            head, tail = _cut(waiting.pop(), size)
            out.append(head)
            size -= len(head[0])
            if tail:
                waiting.append(tail)
        yield out


def _rows(part: int, number: int, windows: list[list[Piece]], done: int) -> pa.RecordBatch:
    """Windows as rows, the first `done` of them finished ones, the others open."""
    flat = [p for w in windows for p in w]
    kinds = [pa.int64()] * 6
    lengths = [len(p[0]) for p in flat]
    at = np.cumsum([0, *map(len, windows)])
    begins = np.cumsum([0, *lengths])
    offsets = begins[:-1] - np.repeat(begins[at[:-1]], np.diff(at))
    values = [
        [p[1] for p in flat],
        [p[2] for p in flat],
        lengths,
        [zlib.crc32(p[0].astype("<u4")) for p in flat],
        [p[3] for p in flat],
        offsets,
    ]
    names = [f.name for f in _PIECES.value_type]
    listed = pa.StructArray.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds)], names=names
    )
    joined = [np.concatenate([p[0] for p in w]).tobytes() for w in windows]
    n = len(windows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int64()),
            pa.array(range(number, number + n), pa.int64()),
            pa.array(np.diff(begins[at]), pa.int64()),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), listed),
            pa.array(joined[:done] + [None] * (n - done), pa.binary()),
            pa.array([None] * done + joined[done:], pa.binary()),
        ],
        schema=_OUT,
    )


def _packed(
    part: int, pieces: Iterator[Piece], window: int, most: int, slack: int, last: bool
) -> Iterator[pa.RecordBatch]:
    """All pieces packed; the open windows come at the end, finished if there is nothing to merge."""
    packer, out, number = Packer(window, most, slack), [], 0
    for piece in pieces:
        out += packer.put(piece)
        if len(out) >= _ROWS:
            yield _rows(part, number, out, len(out))
            number, out = number + len(out), []
    left = list(packer.rest())
    if last:
        out += in_powers([p for w in left for p in w], window, slack)
        left = []
    if out or left:
        yield _rows(part, number, out + left, len(out))


def _pieces_of(table: pa.Table, kind: np.dtype) -> Iterator[Piece]:
    """The pieces of open windows, longest first, by document where equally long."""
    found = []
    for row in table.to_pylist():
        ids = np.frombuffer(row["open_ids"], kind)
        for p in row["pieces"]:
            some = ids[p["offset"] : p["offset"] + p["length"]]
            found.append((some, p["doc_id"], p["start"], p["doc_tokens"]))
    yield from sorted(found, key=lambda p: (-len(p[0]), p[1] is None, p[1] or 0, p[2]))


def _merge(kind: np.dtype, window: int, most: int, slack: int, last: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pieces = _pieces_of(table, kind)
        return pa.Table.from_batches(
            _packed(key[0].as_py(), pieces, window, most, slack, last), _OUT
        )

    return merge


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    slack: int = SLACK,
) -> DataFrame:
    """The documents' ids in sequences of at most `window`: a row for each sequence.

    `sequence_id` is unique, not gapless; `length` its number of ids; `ids` these, little-endian and
    as wide as the vocabulary needs; `pieces` says what they are: `doc_id`, `start` in the
    document, `length`, `ids_crc32` (over 32-bit ids), `doc_tokens` (ids of the document, with the
    end id) and `offset` in the sequence. A sequence shorter than the window lacks at most `slack`
    ids, or its length is a power of two; of the latter there are fewer than the window has digits.

    Each row of `docs` is a document and ends with `end_id`; null texts are empty, null doc_ids
    stay null, repeated rows are packed each for itself. Other columns are not looked at.
    """
    kind = id_type(tokenizer)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        end = np.array([end_id], kind)
        for batch in (part for whole in batches for part in slices(whole)):
            ids, at = byte_level_ids(tokenizer, batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, low, high in zip(doc_ids, at[:-1].tolist(), at[1:].tolist()):
                yield np.concatenate([ids[low:high], end]), doc_id, 0, high - low + 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield from _packed(part, documents(batches), window, open_windows, slack, False)

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    tables = [written(rows.mapInArrow(lean(first), _SCHEMA), "packed")]
    while True:
        opened = tables[-1].where("ids IS NULL").drop("ids")
        parts = opened.agg(F.max("part")).first()[0]
        if parts is None:
            break
        merge = _merge(kind, window, open_windows, slack, parts < MERGED)
        group = F.expr(f"part DIV {MERGED}").alias("group")
        merged = opened.select("*", group).groupBy("group").applyInArrow(merge, _SCHEMA)
        tables.append(written(merged, "packed"))
    # A task and its number, and how often they were merged, make the id.
    out = None
    for turn, table in enumerate(tables):
        sequence_id = F.expr(f"({turn}L << 58) | (part << 32) | number").alias("sequence_id")
        done = table.where("ids IS NOT NULL").select(sequence_id, "length", "pieces", "ids")
        out = done if out is None else out.unionAll(done)
    return out
