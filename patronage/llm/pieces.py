"""Whole texts through a tokenizer of the tokenizers library, each distinct word encoded once.

Texts are cut only where no token can cross, so the ids of the parts, put together, are those of the
whole text:

* byte-level BPE: before a space that stands before a character that is not white space. The
  tokenizer's own pattern starts a new word there, whatever precedes. Within a word: between
  letters and the ASCII punctuation that ends it, and around a single line feed that has no white
  space of any kind beside it.
* word-end BPE with white space dropped: at spaces and line feeds, and before the punctuation that
  ends a word of Latin letters.

Words repeat, so most are looked up. Words of Latin letters go to the library's BPE model itself,
all others to its whole encoder. What a task remembers is bounded by `KEPT` words for each kind of
tokenizer.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from patronage.llm.work import give_back

KEPT = 600_000
_STEP = 1 << 19
# White space of any kind after a space, or a space at the end.
_RISKY = (
    " ([\\t-\\r \\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\\z)"
)
_CUT = re.compile(r"(?= \S)")
# Letters below U+0180 (those keep their form under NFC and lower-case one by one), then ASCII
# punctuation but ' and <, which can begin a contraction or a special token.
_PLAIN = re.compile(
    r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+)([!-&(-/:-;=-@\[-`{-~]*)"
)


def _spelling() -> dict[int, str]:
    """How byte-level tokenizers spell bytes: visible ones as themselves, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_SPELT = _spelling()


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def id_type(path: str) -> np.dtype:
    """Little-endian, as narrow as the vocabulary allows."""
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


class Words:
    """Remembers the ids of words, as bytes.

    `before` stands before each word and `mark` is how the model spells it; `lower` for a
    tokenizer that lower-cases; `rest` remembers words that stand directly after others.
    """

    def __init__(self, path: str, before: str = "", mark: str = "", lower: bool = False):
        self.path, self.before, self.mark, self.lower = path, before, mark, lower
        self.rest = self if not before else _heads(path)
        self.code = "H" if id_type(path).itemsize == 2 else "I"
        self.known = _Known(self)

    def _whole(self, word: str) -> bytes:
        found = tokenizer(self.path).encode(self.before + word, add_special_tokens=False)
        return array(self.code, found.ids).tobytes()

    def _one(self, word: str) -> bytes | None:
        """The ids, if the word is made of parts that no token crosses."""
        if "\n" in word and not self.lower:
            lines = word.split("\n")
            if all(lines) and not any(
                a[-1].isspace() or b[0].isspace() for a, b in zip(lines[:-1], lines[1:])
            ):
                feed = self.rest.get("\n")
                return feed.join([self.get(lines[0]), *map(self.rest.get, lines[1:])])
            return None
        shape = _PLAIN.fullmatch(word)
        if not shape:
            return None
        letters, marks = shape.groups()
        if marks:
            return self.get(letters) + self.rest.get(marks)
        if self.lower:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_SPELT)
        found = tokenizer(self.path).model.tokenize(self.mark + letters)
        return array(self.code, [t.id for t in found]).tobytes()

    def get(self, word: str) -> bytes:
        return self.known[word]

    def learn(self, word: str) -> bytes:
        found = self._one(word)
        return self._whole(word) if found is None else found

    def bound(self) -> None:
        if len(self.known) > (KEPT // 4 if self.lower else KEPT):  # lower-cased words are fewer
            self.known.clear()


class _Known(dict):
    """Learns what it is asked for first."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.words.learn(word)
        return found


@functools.cache
def _heads(path: str) -> Words:
    return Words(path)


@functools.cache
def _tails(path: str) -> Words:
    return Words(path, " ", "Ġ")  # how byte-level tokenizers spell a space


@functools.cache
def _spaced(path: str) -> Words:
    return Words(path, lower=True)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20):
    """The batch in parts of about `most` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(sizes.astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(edges[:-1], edges[1:]):
        yield batch.slice(low, high - low)


def forget() -> None:
    """Give back what was remembered of lower-cased words, so that idle workers stay small."""
    _spaced.cache_clear()
    give_back()


def byte_level_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts under a byte-level BPE tokenizer: all ids, and where each text's begin and end.

    Null is the empty text. Texts in which white space follows a space, or that end with a space,
    are cut one by one, the others all at once.
    """
    heads, texts = _heads(path), _clean(texts)
    risky = pc.match_substring_regex(texts, _RISKY)
    words = pc.split_pattern(pc.if_else(risky, "", texts), " ")
    first = pc.list_element(words, 0).to_pylist()
    for at in np.flatnonzero(risky.to_numpy(zero_copy_only=False)).tolist():
        first[at] = _CUT.split(texts[at].as_py())
    own = [b"".join(map(heads.get, w)) if isinstance(w, list) else heads.get(w) for w in first]
    heads.bound()
    return _together(_tails(path), words, own)


def spaced_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts under a lower-casing tokenizer that drops white space, in the same form."""
    words = pc.split_pattern(pc.replace_substring(_clean(texts), "\n", " "), " ")
    known = _spaced(path)
    return _together(known, words, [known.get(w) for w in pc.list_element(words, 0).to_pylist()])


def _clean(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.string()), "")


def _together(known: Words, words: pa.ListArray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of words, the first of each list given as `own`."""
    kind, at = id_type(known.path), words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    at = at - at[0]
    codes = coded.indices.to_numpy().astype(np.int64)
    later = np.ones(len(codes), bool)
    later[at[:-1]] = False
    used = np.zeros(len(coded.dictionary), bool)
    used[codes[later]] = True
    rows = coded.dictionary.to_pylist()
    values = [known.get(w) if u else b"" for w, u in zip(rows, used.tolist())] + own
    known.bound()
    codes[at[:-1]] = np.arange(len(rows), len(values))
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    flat, starts = np.frombuffer(b"".join(values), kind), np.cumsum(sizes) - sizes
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])
    out = np.empty(ends[-1], kind)
    for low in range(0, len(codes), _STEP):  # index arrays stay small
        some = codes[low : low + _STEP]
        n, base = sizes[some], ends[low]
        shift = starts[some] - (ends[low : low + len(some)] - base)
        stop = ends[low + len(some)]
        out[base:stop] = flat[np.repeat(shift, n) + np.arange(stop - base)]
    return out, ends[at]
