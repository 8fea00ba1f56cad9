"""BPE of texts of any length: halves encoded apart, and only the surroundings of a join again.

Where white space parts two words no token crosses, so words are looked up (`pieces`). A stretch
without white space that is longer than a leaf is cut anywhere, its leaves are encoded as rows of
their own, and neighbours are joined two by two up a tree. At each join a window around it is
encoded again and grows until its tokens meet the left side's and the right side's in a token that
both have, with the same id and place. Left of the one and right of the other stays as it was. That
is exact, since a BPE encoding is right if every two neighbouring tokens are what BPE makes of
their common text, and here each pair stands in one of the encodings.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.pieces import forget, slices, spaced_ids, tokenizer
from patronage.llm.work import lean, texts_of, written

LEAF = 8_192
_WINDOW = 48
_STEP = 4 << 20  # bytes of text encoded at a time


@dataclass
class Side:
    """A stretch of text with its tokens: ids, and where each starts and ends."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def encode_side(path: str, text: str) -> Side:
    got = tokenizer(path).encode(text, add_special_tokens=False)
    at = np.array(got.offsets, np.int64).reshape(-1, 2)
    return Side(text, np.array(got.ids, np.int64), at[:, 0], at[:, 1])


def _clean(side: Side) -> np.ndarray:
    """Tokens that start where the one before ends and end where the next starts, or later."""
    n = len(side.ids)
    good = np.ones(n, bool)
    if n:
        good[1:] = side.starts[1:] >= side.ends[:-1]
        good[:-1] &= good[1:]
        good &= side.ends > side.starts
    return good


def _met(side: Side, window: Side, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """A token of `side` between the two places that the window has too: both indices."""
    places = {
        (s, e, i): k
        for k, (s, e, i, ok) in enumerate(
            zip(window.starts, window.ends, window.ids, _clean(window))
        )
        if ok
    }
    near = np.flatnonzero((side.starts >= low) & (side.ends <= high) & _clean(side))
    for k in near[::-1] if last else near:
        found = places.get((side.starts[k], side.ends[k], side.ids[k]))
        if found is not None:
            return int(k), found
    return None


def join(path: str, left: Side, right: Side, window: int = _WINDOW) -> Side:
    """The encoding of the two texts together."""
    cut, text = len(left.text), left.text + right.text
    moved = Side(right.text, right.ids, right.starts + cut, right.ends + cut)
    while True:
        low, high = max(0, cut - window), min(len(text), cut + window)
        if low == 0 and high == len(text):
            return encode_side(path, text)
        again = encode_side(path, text[low:high])
        again = Side(again.text, again.ids, again.starts + low, again.ends + low)
        # The last token of the left side and of the window may be another for the cut behind it.
        a = (0, 0) if low == 0 else _met(left, again, low, min(cut, _last(left)), True)
        end = (len(moved.ids), len(again.ids))
        b = end if high == len(text) else _met(moved, again, cut, min(high, _last(again)), False)
        if a and b and a[1] <= b[1]:
            return Side(
                text,
                np.concatenate([left.ids[: a[0]], again.ids[a[1] : b[1]], moved.ids[b[0] :]]),
                np.concatenate([left.starts[: a[0]], again.starts[a[1] : b[1]], moved.starts[b[0] :]]),
                np.concatenate([left.ends[: a[0]], again.ends[a[1] : b[1]], moved.ends[b[0] :]]),
            )
        window *= 2


def _last(side: Side) -> int:
    """Where the last token starts."""
    return int(side.starts[-1]) if len(side.ids) else 0


def join_all(path: str, sides: list[Side]) -> Side:
    """Neighbours two by two, until one is left."""
    while len(sides) > 1:
        pairs = zip(sides[::2], sides[1::2])
        sides = [join(path, a, b) for a, b in pairs] + sides[len(sides) & ~1 :]
    return sides[0]


@functools.cache
def _stretch(path: str, leaf: int) -> re.Pattern:
    """A special token, or more than a leaf without white space or one."""
    special = sorted(map(re.escape, _special(path)), key=len, reverse=True)
    none = f"(?:(?!{'|'.join(special)})[^ \\n])" if special else "[^ \\n]"
    return re.compile("|".join([*special, none + "{%d,}" % (leaf + 1)]))


def _special(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def leaves(path: str, text: str, leaf: int) -> list[tuple[bool, str]]:
    """The text in parts, each with whether it must be joined with the part before it.

    Special tokens are found before all else, so no token crosses their edges either.
    """
    parts: list[tuple[bool, str]] = []
    done = 0
    for m in _stretch(path, leaf).finditer(text):
        start, end = m.span()
        if start > done:
            parts.append((False, text[done:start]))
        parts += [(a > start, text[a : min(a + leaf, end)]) for a in range(start, end, leaf)]
        done = end
    if done < len(text):
        parts.append((False, text[done:]))
    return parts


def _with_ids(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (part for whole in batches for part in slices(whole, most=_STEP)):
                ids, at = spaced_ids(path, batch.column("text"))
                lists = pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))
                kept = [c for c in batch.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), lists], names=[*kept, "ids"]
                )
        finally:
            forget()

    return encode


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """The documents with `ids` (array of int), as the library encodes each whole text.

    A null text is the empty text and has no ids. A column `ids` of `docs` is replaced; rows that
    repeat are encoded each for itself. `path` names a tokenizer that drops white space.

    Texts with a long stretch are written out first, once, with a number each; so their parts find
    their row again whatever `docs` is computed from.
    """
    rows = docs.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    unsplit = F.exists(F.split("text", "[ \n]"), lambda w: F.length(w) > leaf)
    long = F.coalesce((F.length("text") > leaf) & unsplit, F.lit(False))
    short = rows.where(~long).mapInArrow(_with_ids(path), f"{schema}, ids array<int>")

    # Texts with a long stretch: their parts are rows, spread over all tasks, then joined by text.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), texts_of(batch)):
                parts = leaves(path, text, leaf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(parts), pa.int64()),
                        pa.array(range(len(parts)), pa.int32()),
                        pa.array([j for j, _ in parts], pa.bool_()),
                        pa.array([t for _, t in parts], pa.string()),
                    ],
                    names=["_row", "k", "joined", "part"],
                )

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for text in texts_of(batch, "part"):
                if len(text) <= leaf:
                    sides.append(encode_side(path, text))
                else:  # words between the long stretches: their places are never asked for
                    ids, _ = spaced_ids(path, pa.array([text]))
                    none = np.zeros(0, np.int64)
                    sides.append(Side(text, ids.astype(np.int64), none, none))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("_row", "k", "joined", "part")),
                    *(
                        pa.array([getattr(s, c) for s in sides], pa.list_(pa.int64()))
                        for c in ("ids", "starts", "ends")
                    ),
                ],
                names=["_row", "k", "joined", "part", "ids", "starts", "ends"],
            )

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        runs: list[list[Side]] = []
        parts = parts.sort_values("k")
        for joined, *values in zip(*(parts[c] for c in ("joined", "part", "ids", "starts", "ends"))):
            if not joined:
                runs.append([])
            runs[-1].append(Side(*values))
        ids = np.concatenate([join_all(path, run).ids for run in runs])
        return pd.DataFrame({"_row": parts["_row"].iloc[:1], "ids": [ids.astype(np.int32)]})

    name = "_row"
    while name in rows.columns:
        name += "_"
    numbered = rows.where(long).withColumn(name, F.monotonically_increasing_id())
    numbered = written(numbered, "long-stretches")
    if numbered.isEmpty():
        return short
    parts = numbered.select(F.col(name).alias("_row"), "text").mapInArrow(
        cut, "_row bigint, k int, joined boolean, part string"
    )
    encoded = parts.repartition("_row", "k").mapInArrow(
        encode_part,
        "_row bigint, k int, joined boolean, part string, "
        "ids array<bigint>, starts array<bigint>, ends array<bigint>",
    )
    whole = encoded.groupBy("_row").applyInPandas(gather, "_row bigint, ids array<int>")
    whole = whole.withColumnRenamed("_row", name)
    return short.unionByName(numbered.join(whole, name).drop(name))


@functools.cache
def _strings(path: str) -> list[str]:
    loaded = tokenizer(path)
    return [loaded.id_to_token(i) or "" for i in range(loaded.get_vocab_size())]


def _by_tokens(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` ids."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
    part = np.cumsum(sizes.astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        yield batch.slice(low, high - low)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with `decoded`: what the library makes of `ids`, special tokens kept.

    Of null or no ids, the empty text. A tokenizer without a decoder puts a space between the
    tokens' strings, which is done by look-up; others are asked for each row. A column `decoded`
    is replaced.
    """
    rows = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    names = [*rows.columns, "decoded"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, strings = tokenizer(path), pa.array(_strings(path), pa.string())
        for batch in (part for whole in batches for part in _by_tokens(whole)):
            if loaded.decoder is None:
                ids = batch.column("ids")
                tokens = strings.take(ids.flatten())
                at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), tokens)
                out = pc.binary_join(lists, " ")
            else:
                every = batch.column("ids").to_pylist()
                out = [loaded.decode(ids or [], skip_special_tokens=False) for ids in every]
                out = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    return rows.mapInArrow(lean(texts), f"{schema}, decoded string")
