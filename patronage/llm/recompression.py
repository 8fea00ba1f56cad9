"""Periodic runs of words by recompression.

The words of a chunk of texts are numbered, with a number of its own between two texts, and the
sequence is shrunk level by level: blocks of one symbol become one, then pairs whose symbols fall
on different sides of a halved alphabet. Equal symbols of a level stand for equal stretches of words,
so the levels are a run-length grammar, and how far two places agree is found by climbing it while
symbols agree and coming down where they do not.

A run of period q and four periods holds four multiples of q with one word. Such places of the
grid of each q (n/1 + n/2 + ... in all) are the candidates; the grammar extends them exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from patronage.llm import words as W
from patronage.llm.pieces import slices
from patronage.llm.work import lean

PERIODS = 4  # a run has at least so many; the grid needs three or more
LEAST_WORDS = 6
CHUNK_WORDS = 1 << 19
_LEAST_SYMBOLS = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Level:
    """A sequence of symbols and how its places lie in the next, shorter one.

    `starts` and `ends` are those of each symbol's block. `up` has each place's place in the next
    level (-1 within a symbol of it), `down` the reverse; the top level has neither.
    """

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    up: np.ndarray | None = None
    down: np.ndarray | None = None


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels above a sequence of numbers, the sequence itself first."""
    levels, symbols = [], symbols.astype(np.int32)
    while True:
        n = len(symbols)
        first = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
        count = np.diff(first, append=n)
        levels.append(
            Level(
                symbols,
                np.repeat(first, count).astype(np.int32),
                np.repeat(first + count, count).astype(np.int32),
            )
        )
        if n <= _LEAST_SYMBOLS:
            return levels
        blocks = symbols[first].astype(np.int64)
        many = count > 1
        if many.any():
            keys = blocks[many] * (int(count.max()) + 1) + count[many]
            blocks[many] = int(blocks.max()) + 1 + _numbered(keys)
        size = int(blocks.max()) + 1
        salt = np.uint64(len(levels) << 40)
        side = (W.mixed(blocks.astype(np.uint64) + salt) >> np.uint64(33)) & np.uint64(1)
        side = side.astype(bool)
        pairs = [side[:-1] & ~side[1:], ~side[:-1] & side[1:]]
        left = np.flatnonzero(max(pairs, key=np.count_nonzero))
        blocks[left] = size + _numbered(blocks[left] * size + blocks[left + 1])
        kept = np.ones(len(blocks), bool)
        kept[left + 1] = False
        below = levels[-1]
        below.down = np.concatenate([first[kept], [n]]).astype(np.int32)
        below.up = np.full(n + 1, -1, np.int32)
        below.up[below.down] = np.arange(len(below.down))
        symbols = blocks[kept].astype(np.int32)


def agreement(levels: list[Level], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from the places x and y on, or before them.

    The sequence begins and ends with symbols that occur nowhere else.
    """
    a, b = x.astype(np.int64), y.astype(np.int64)

    def step(level: Level, some: np.ndarray) -> np.ndarray:
        """Move those of the queries whose next symbols agree; they are returned."""
        i, j = a[some], b[some]
        if back:
            same = level.symbols[i - 1] == level.symbols[j - 1]
            some, i, j = some[same], i[same], j[same]
            n = -np.minimum(i - level.starts[i - 1], j - level.starts[j - 1])
        else:
            same = level.symbols[i] == level.symbols[j]
            some, i, j = some[same], i[same], j[same]
            n = np.minimum(level.ends[i] - i, level.ends[j] - j)
        a[some], b[some] = i + n, j + n
        return some

    top = len(levels) - 1
    reached = np.full(len(a), top, np.int64)  # the level at which they differ
    alive = np.arange(len(a))
    for t, level in enumerate(levels[:-1]):
        some = alive
        while len(some):  # up to where both have a place in the next level
            some = some[(level.up[a[some]] < 0) | (level.up[b[some]] < 0)]
            reached[some] = t
            some = step(level, some)
            reached[some] = top
        alive = alive[reached[alive] > t]
        if not len(alive):
            break
        a[alive], b[alive] = level.up[a[alive]], level.up[b[alive]]
    order = np.argsort(-reached, kind="stable")
    levels_of = -reached[order]
    for t in range(int(reached.max(initial=0)), -1, -1):
        active = order[: np.searchsorted(levels_of, -t, "right")]
        some = active
        while len(some):
            some = step(levels[t], some)
        if t:
            a[active], b[active] = levels[t - 1].down[a[active]], levels[t - 1].down[b[active]]
    return np.abs(a - x)


def _candidates(symbols: np.ndarray, q: int) -> np.ndarray:
    """Places x of the grid of q whose word stands at x + q and at two more neighbours of the grid.

    Of a stretch of such places every third is enough, as a run holds three of them in a row.
    """
    grid = symbols[::q]
    same = grid[1:] == grid[:-1]
    three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
    if not len(three):
        return three
    if q == 1:  # a stretch is a run
        return three[np.concatenate([[True], np.diff(three) > 1])]
    # the one place of the three whose number is a multiple of three
    return np.unique(three + (-three) % 3) * q


def runs_of(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, ascending.

    `symbols` are texts one after the other, longest first, each after a symbol of its own and the
    last before one; `sizes` are their numbers of words.
    """
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes[0] < LEAST_WORDS:
        return none, none, none
    levels = grammar(symbols)
    ends = np.cumsum(sizes + 1) + 1  # of the sequence up to each text and the symbol behind it
    found = [(none, none, none)]
    covered_to = np.zeros(len(symbols), np.int64)
    covered_by = np.ones(len(symbols), np.int64)
    most, low = int(sizes[0]) // PERIODS, 1
    while low <= most:
        high = min(most + 1, low + 1 if low == 1 else 4 * low)
        places, periods = [], []
        for q in range(low, high):
            n = int(np.searchsorted(-sizes, -PERIODS * q, "right"))  # texts long enough
            x = _candidates(symbols[: ends[n - 1]], q)
            if len(x):
                # inside a run whose period divides q: nothing new comes of it
                x = x[(x + q >= covered_to[x]) | (q % covered_by[x] > 0)]
                places.append(x)
                periods.append(np.full(len(x), q))
        low = high
        if not places:
            continue
        x, q = np.concatenate(places), np.concatenate(periods)
        end = x + q + agreement(levels, x, x + q)
        start = x - agreement(levels, x, x + q, back=True)
        enough = end - start >= np.maximum(LEAST_WORDS, PERIODS * q)
        start, end, q = start[enough], end[enough], q[enough]
        found.append((start, end, q))
        order = np.unique(start * len(symbols) + end, return_index=True)[1]
        for s, e, p in zip(start[order].tolist(), end[order].tolist(), q[order].tolist()):
            new = slice(s, e) if covered_to[s] < e else slice(0, 0)
            covered_to[new], covered_by[new] = e, p
    start, end, q = (np.concatenate(parts) for parts in zip(*found))
    order = np.lexsort((q, end, start))  # of one stretch, the smallest period first
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word among them, and each row's place among the words."""
    full = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    buffer = full.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[at[0] : at[-1]]
    starts, ends, word_at = W.word_spans(data, at - at[0])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = pa.py_buffer(np.ascontiguousarray(data[~W.SPACES[data]]))
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), letters)
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), word_at


def _found(numbers: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each row, places counted within the row."""
    sizes = np.diff(at)
    out = [(np.zeros(0, np.int64),) * 3] * len(sizes)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST_WORDS]
    chunk = np.cumsum(sizes[order]) // CHUNK_WORDS
    base = int(numbers.max(initial=0)) + 1
    for part in np.split(order, np.flatnonzero(np.diff(chunk)) + 1):
        if not len(part):
            continue
        begins = np.cumsum(np.concatenate([[0], sizes[part] + 1]))
        symbols = np.empty(begins[-1] + 1, np.int64)
        symbols[begins] = base + np.arange(len(begins))
        for k, row in enumerate(part):
            symbols[begins[k] + 1 : begins[k + 1]] = numbers[at[row] : at[row + 1]]
        start, end, period = runs_of(symbols, sizes[part])
        edges = np.searchsorted(start, begins)
        for k, row in enumerate(part):
            mine = slice(edges[k], edges[k + 1])
            shift = begins[k] + 1
            out[row] = (start[mine] - shift, end[mine] - shift, period[mine])
    return out


def find_runs(
    docs: DataFrame, texts: Callable[[pa.RecordBatch], pa.Array] | None = None
) -> DataFrame:
    """`doc_id`, `n_words`, `runs` and `collapsed` of each document.

    Words are parted by ASCII white space and compared as they stand. A run is a stretch of
    smallest period q, of at least four periods and six words, that no neighbouring word extends; runs
    are listed by start, then period. `collapsed` has the words but those behind the first period of
    a run they stand in, joined by single spaces.

    A null or empty text has no words, no runs and an empty `collapsed`; rows that repeat are each
    done for itself, null ids kept. Other columns do not come along. `texts` may give the text
    column of a batch of `doc_id` and `text`, if it is not `text` itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            column = texts(batch) if texts else batch.column("text")
            known, numbers, at = _words(column)
            found = _found(numbers, at)
            kept = np.ones(len(numbers), bool)
            for row, (start, end, period) in enumerate(found):
                for s, e in zip((start + period).tolist(), end.tolist()):
                    kept[at[row] + s : at[row] + e] = False
            left = np.concatenate([[0], np.cumsum(kept)])[at]
            shown = known.take(pa.array(numbers[kept]))
            lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), shown)
            start, end, period = map(np.concatenate, zip(*found))
            run_at = np.cumsum([0, *(len(f[0]) for f in found)])
            runs = pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in (start, end - start, period)],
                names=["start", "length", "period"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), runs),
                    pc.binary_join(lists, " "),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    schema = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string"
    return rows.mapInArrow(lean(run), schema)
