"""Benchmark passages in documents: one automaton over the items, one scan of each text.

A window is ten consecutive words of an item (a shorter item is one window). Every window of ten
words holds a whole block of five whose place in the item is a multiple of five, so the automaton
takes only those blocks. Where one is met, the words around it are compared with the item's, and a
common run of at least a window's length is a hit. That finds what an automaton of all windows
would, with a tenth of its memory.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.work import lean, texts_of, written

WINDOW = 10
BLOCK = 5
# Bytes of item text for one automaton, and of all that one scan of the texts takes along.
AUTOMATON_BYTES = 2 << 20
SENT_BYTES = 64 << 20
# Bytes of batches that a task holds while several automata take turns.
HELD_BYTES = 32 << 20

# A-Z become a-z; ASCII other than letters and digits separates words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "array<struct<item_id:string,start:int,stop:int,char_start:int,char_stop:int>>"


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words; of null, none."""
    return (text or "").encode().translate(_NORMAL).decode().split(" ") if text else []


class Passages:
    """An automaton over the blocks of items, and the items' words to compare around a match."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.items: list[tuple[str, list[str]]] = []
        blocks: dict[str, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = [w for w in words_of(text) if w]
            if not words:
                continue
            k = len(self.items)
            self.items.append((item_id, words))
            size = min(BLOCK, window, len(words)) if len(words) >= window else len(words)
            for at in range(0, len(words) - size + 1, size):
                key = f" {' '.join(words[at : at + size])} "
                blocks.setdefault(key, []).append((k, at, size))
        self.automaton = ahocorasick.Automaton()
        for key, places in blocks.items():
            self.automaton.add_word(key, places)
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def runs(self, line: str) -> list[tuple[str, int, int]]:
        """(item, first word, word after the last) of the hits in a text's line of words."""
        if self.empty or not line:
            return []
        met = list(self.automaton.iter(line))
        if not met:
            return []
        words = line[1:-1].split(" ")
        gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        spans: dict[int, set[tuple[int, int]]] = {}
        done: dict[tuple[int, int], int] = {}
        for end, places in met:
            after = int(np.searchsorted(gaps, end))  # the word that follows the match
            for k, at, size in places:
                item = self.items[k][1]
                shift = after - size - at
                if done.get((k, shift), -1) >= after:
                    continue
                low, high = after - size, after
                while low > 0 and low - shift > 0 and words[low - 1] == item[low - shift - 1]:
                    low -= 1
                while (
                    high < len(words)
                    and high - shift < len(item)
                    and words[high] == item[high - shift]
                ):
                    high += 1
                done[k, shift] = high
                if high - low >= min(self.window, len(item)):
                    spans.setdefault(k, set()).add((low, high))
        found = []
        for k, of in spans.items():
            item_id, low, high = self.items[k][0], None, None
            for a, b in sorted(of):
                if low is None:
                    low, high = a, b
                elif a <= high:
                    high = max(high, b)
                else:
                    found.append((item_id, low, high))
                    low, high = a, b
            found.append((item_id, low, high))
        return sorted(found)


def line_of(text: str | None) -> tuple[int, str]:
    """How many words a text has, and the words between single blanks; without words, nothing."""
    words = [w for w in words_of(text) if w]
    return len(words), f" {' '.join(words)} " if words else ""


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about `size` bytes, at least one batch each."""
    held, held_bytes = [], 0
    for batch in batches:
        if held and held_bytes + batch.nbytes > size:
            yield held
            held, held_bytes = [], 0
        held.append(batch)
        held_bytes += batch.nbytes
    if held:
        yield held


def _scan(parts: Broadcast, window: int, first: bool, held_bytes: int):
    """Look each text up in the automaton of every part of the items.

    A task holds one automaton and some megabytes of texts at a time: where there are several
    parts, their automata take turns over the texts held.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = parts.value
        passages, at = None, None
        for held in _gathered(batches, held_bytes if len(packed) > 1 else 0):
            texts = [text for batch in held for text in texts_of(batch)]
            lines = [line_of(text) for text in texts]
            runs: list[list[tuple[str, int, int]]] = [[] for _ in texts]
            # turn about, so that the automaton in hand serves the next run of texts first
            order = range(len(packed)) if at != len(packed) - 1 else reversed(range(len(packed)))
            for k in order:
                if at != k:
                    passages = None  # let go of the last one before the next is made
                    passages, at = Passages(pickle.loads(zlib.decompress(packed[k])), window), k
                for found, (_, line) in zip(runs, lines):
                    found += passages.runs(line)
            done = 0
            for batch in held:
                rows = slice(done, done + batch.num_rows)
                done += batch.num_rows
                counts = [n for n, _ in lines[rows]]
                hits = list(map(_hits_of, texts[rows], runs[rows]))
                if not first:
                    hits = [a + b for a, b in zip(batch.column("hits").to_pylist(), hits)]
                kept = [c for c in batch.schema.names if first or c not in ("n_words", "hits")]
                arrays = [batch.column(c) for c in kept]
                arrays += [pa.array(counts, pa.int64()), pa.array(hits, _HITS)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "n_words", "hits"])

    return scan


def _hits_of(text: str, runs: list[tuple[str, int, int]]) -> list[dict]:
    """The runs, by item, with their places in the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [
        {
            "item_id": item,
            "start": a,
            "stop": b,
            "char_start": at[a][0],
            "char_stop": at[b - 1][1],
        }
        for item, a, b in sorted(runs)
    ]


def _parts(items: list[tuple[str, str]], size: int) -> list[bytes]:
    """The items in packed parts of at most `size` bytes of text, or one item; at least one part."""
    parts, part, part_bytes = [], [], 0
    for item in items:
        own = len(item[1].encode())
        if part and part_bytes + own > size:
            parts.append(part)
            part, part_bytes = [], 0
        part.append(item)
        part_bytes += own
    parts.append(part)
    return [zlib.compress(pickle.dumps(part), 1) for part in parts]


_HITS = pa.list_(
    pa.struct(
        [
            ("item_id", pa.string()),
            ("start", pa.int32()),
            ("stop", pa.int32()),
            ("char_start", pa.int32()),
            ("char_stop", pa.int32()),
        ]
    )
)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """The documents with `n_words` and `hits`: benchmark items found, by words and characters.

    A hit is a run of words that windows of one item cover: `start` and `stop` count words,
    `char_start` and `char_stop` characters of the original text. Items go to the tasks in packed
    parts of `automaton_bytes`, all in one scan of the texts; only items of more than `sent_bytes`,
    measured before, take another scan for each so many. What a task holds of automata and texts
    does not grow with the benchmark. Null texts have no words. Items without an id, words or text
    take no part; items that repeat an id count as one item. Columns of `docs` called `n_words` or
    `hits` are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = max(1, -(-2 * size // sent_bytes)) if size > sent_bytes else 1
    scan = F.pmod(F.xxhash64("item_id", "text"), F.lit(scans))
    context = docs.sparkSession.sparkContext
    found = docs.drop("n_words", "hits")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields]
    schema = ", ".join([*names, "n_words bigint", f"hits {HITS}"])
    for k in range(scans):
        texts = sorted(tuple(r) for r in items.where(scan == k).distinct().collect())  # bounded
        parts = context.broadcast(_parts(texts, automaton_bytes))
        found = found.mapInArrow(lean(_scan(parts, window, k == 0, HELD_BYTES)), schema)
        if scans > 1:
            found = written(found, "passages")
    return found


def n_hit() -> Column:
    """How many words some hit covers."""
    words = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["stop"] - 1)))
    return F.size(F.array_distinct(words)).cast("bigint")


def item_ids() -> Column:
    """The items found, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
