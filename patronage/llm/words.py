"""Words of whole texts as 64-bit hashes, for all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
# Bytes 0x20 and 0x09 to 0x0D part words.
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)


_VALUES = _byte_values()
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UP = _powers(_BASE, CHUNK_BYTES)
_DOWN = _powers(_INVERSE, CHUNK_BYTES)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, their UTF-8 bytes and each row's place in them, by about CHUNK_BYTES."""
    full = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    buffer = full.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(full):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK_BYTES, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_spans(
    data: np.ndarray, at: np.ndarray, parts: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all rows start and end, and each row's place among them."""
    inside = ~parts[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[at[:-1]] = False
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    after[at[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z."""
    n = len(data)
    up, down = (_UP, _DOWN) if n <= CHUNK_BYTES else (_powers(_BASE, n), _powers(_INVERSE, n))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words of each row, and each row's place among them.

    A row of fewer words, but not none, has one shingle, the whole row.
    """
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(at[:-1], counts) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], counts)
    length = np.repeat(np.minimum(n, size), counts)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = np.where(k < length, mixed(out * _MIX + padded[first + k]), out)
    return out, out_at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and each row's place among them."""
    rows = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    flat = np.concatenate(rows) if rows else values[:0]
    return flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
