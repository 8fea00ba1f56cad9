"""Passages that repeat across documents, exactly or nearly.

A text is a row of word shingles. For a hash function, a compact window (l, c, r) stands for all
stretches that begin in l..c and end in c..r: their minimum is the hash at c. The windows are the
nodes of a Cartesian tree over the hashes, and only those as wide as a passage are kept, about
2 n / width of n shingles. Windows of one hash function and minimum meet; each is paired with the
first of its group, and of those with the same surroundings, first among the rows of one task, so a
passage shared by very many documents stays linear and goes through the exchange once a task.

Where pairs of enough hash functions overlap in both documents lies a candidate. There the shingles
themselves are compared, the best aligned stretches found, and their similarity checked exactly.

The first of a group may share less than a passage, and hide others that share one. So around the
centres of windows that met, every stretch of a passage's least width is hashed as a whole, and equal
stretches meet: of passages that are equal word for word none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronage.llm import words as W
from patronage.llm.work import lean, sifted, written

SHINGLE = 5
WORDS = 50  # of the shortest passage
PERCENT = 80
HASHES = 5
ENOUGH = 2  # hash functions that must agree
_GRID = 32  # stretches to compare begin and end at multiples of this
_HELD = 1 << 21  # windows a task groups at a time
_OUT = 1 << 14  # rows of one batch given back

_SEEDS = np.random.default_rng(7).integers(1, 1 << 62, HASHES, dtype=np.uint64) * 2 + 1

ROWS = (
    "key bigint, a bigint, al int, ac int, ar int, b bigint, bl int, bc int, br int, j int, "
    "before int, after int"
)
_FIELDS = [f.split()[0] for f in ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 6]
_AROUND = 15  # of any passage, the shingle so far before or after its centre is inside it


def windows(
    hashes: np.ndarray, at: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, centre and last place of all compact windows of at least `width`, of all rows.

    The tree is grown level by level for all rows together. Of equal minima the one nearest the
    middle is taken, so repeated shingles do not make it deep.
    """
    low, high = at[:-1], at[1:]
    out = []
    while True:
        wide = high - low >= width
        low, high = low[wide], high[wide]
        if not len(low):
            break
        sizes = high - low
        base = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(low - base, sizes)
        value = hashes[place]
        least = np.minimum.reduceat(value, base)
        met = np.flatnonzero(value == np.repeat(least, sizes))
        segment = np.searchsorted(base, met, "right") - 1
        off = np.abs(2 * place[met] - (low + high - 1)[segment])
        if len(met) > len(low):
            order = np.lexsort((off, segment))
            met, segment = met[order], segment[order]
            first = np.ones(len(met), bool)
            first[1:] = segment[1:] != segment[:-1]
            met = met[first]
        centre = place[met]
        out.append(np.stack([low, centre, high - 1]))
        low, high = (
            np.stack([low, centre + 1], axis=1).ravel(),
            np.stack([centre, high], axis=1).ravel(),
        )
    return tuple(np.concatenate(out, axis=1)) if out else (low, low, low)


def shingles_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, all their shingle hashes in order, and each row's place among them."""
    for low, high, data, at in W.chunks(texts):
        starts, ends, word_at = W.word_spans(data, at)
        hashes = W.word_hashes(data, starts, ends)
        yield low, high, *W.shingle_hashes(hashes, word_at, SHINGLE)


def _grouped(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with the first of their group, and which rows are first of one.

    Rows (key, doc, l, c, r, j, before, after) are grouped by key, and by key and the shingle some
    places before or after the centre, so passages with one minimum but other surroundings meet too.
    The last row of the pairs tells which surroundings are equal: 1 before, 2 after. Pairs within a
    document are given only where some are, for its stretches.
    """
    n = len(rows[0])
    both, sides, heads = [], [], np.zeros(n, bool)  # a pair as one number takes less memory
    for side, around in enumerate((None, 6, 7)):
        more = () if around is None else (rows[around],)
        order = np.lexsort((rows[2], rows[1], *more, rows[0]))
        first = np.ones(n, bool)
        for column in (rows[0], *more):
            column = column[order]
            first[1:] &= column[1:] == column[:-1]
        first[1:] = ~first[1:]
        head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        heads[head] = True
        other = order != head
        both.append(order[other] * n + head[other])
        sides.append(np.full(len(both[-1]), side, np.int8))
    del order, head, other
    both, sides = np.concatenate(both), np.concatenate(sides)
    both, place = np.unique(both, return_inverse=True)
    around = np.zeros(len(both), np.int8)
    np.bitwise_or.at(around, place, sides)
    a, b = np.divmod(both, max(n, 1))
    keep = (rows[1][a] != rows[1][b]) | ((around > 0) & (rows[5][a] == 0))
    a, b, around = a[keep], b[keep], around[keep]
    pairs = [c[a] for c in rows[:6]] + [c[b] for c in rows[1:5]] + [around]
    return np.stack([c.astype(np.int64) for c in pairs]), heads


def _batch(columns: list[np.ndarray | None], n: int) -> pa.RecordBatch:
    arrays = [
        pa.nulls(n, t) if c is None else pa.array(c).cast(t) for c, t in zip(columns, _TYPES)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=_FIELDS)


def _as_pairs(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, pairs.shape[1], _OUT):
        p = pairs[:, low : low + _OUT]
        key, a, al, ac, ar, j, b, bl, bc, br, around = p
        # A key that spreads passed-on pairs; they are told from windows by their second document.
        key = W.mixed(np.ascontiguousarray(a).view(np.uint64)).view(np.int64)
        yield _batch([key, a, al, ac, ar, b, bl, bc, br, j, around, None], p.shape[1])


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the texts: one of each key, and pairs of the others with it."""
    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = []
        for k in range(8):  # each column's parts are given up once copied
            rows.append(np.concatenate([h[k] for h in held]))
            for h in held:
                h[k] = h[k][:0]
        held.clear()
        pairs, heads = _grouped(rows)
        yield from _as_pairs(pairs)
        del pairs
        heads = np.flatnonzero(heads)
        for low in range(0, len(heads), _OUT):
            own = heads[low : low + _OUT]
            key, doc, l, c, r, j, before, after = (column[own] for column in rows)
            yield _batch([key, doc, l, c, r, None, None, None, None, j, before, after], len(key))

    width = WORDS - SHINGLE + 1
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for low, _, values, at in shingles_of(batch.column("text")):
            for j, seed in enumerate(_SEEDS):
                with np.errstate(over="ignore"):
                    hashes = W.mixed(values * seed)
                l, c, r = windows(hashes, at, width)
                if not len(l):
                    continue
                row = np.searchsorted(at, l, "right") - 1
                key = W.mixed(hashes[c] + np.uint64(j)).view(np.int64)
                own = (l - at[row], c - at[row], r - at[row], np.full(len(l), j))
                near = [
                    np.where(inside, values[np.where(inside, c + d, 0)].astype(np.int32), 0)
                    for d, inside in (
                        (-_AROUND, c - _AROUND >= at[row]),
                        (_AROUND, c + _AROUND < at[row + 1]),
                    )
                ]
                small = [v.astype(np.int32) for v in (*own, *near)]
                held.append([key, ids[low + row], *small])
            if sum(len(h[0]) for h in held) > _HELD:
                yield from flush()
    if held:
        yield from flush()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The batches of sorted rows, cut so that rows of one key are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        other = np.zeros(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            other |= column != column[-1]
        before = np.flatnonzero(other)
        if len(before):
            done = int(before[-1]) + 1
            yield table.slice(0, done)
            held = table.slice(done).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of windows of one key; pairs that were made before pass."""
    for table in _runs(batches, ["key"]):
        made = np.asarray(table.column("b").is_valid())
        for old in table.filter(pa.array(made)).select(_FIELDS).to_batches():
            yield old
        new = table.filter(pa.array(~made))
        if new.num_rows:
            own = ("key", "a", "al", "ac", "ar", "j", "before", "after")
            pairs, _ = _grouped([new.column(c).to_numpy() for c in own])
            yield from _as_pairs(pairs)


CANDIDATES = "a bigint, al int, ar int, b bigint, bl int, br int"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of two documents in which pairs of enough hash functions overlap."""
    width = WORDS - SHINGLE + 1
    for table in _runs(batches, ["a", "b"]):
        a, al, ac, ar, b, bl, bc, br, j = (table.column(c).to_numpy() for c in _FIELDS[1:10])
        before, after = np.minimum(ac - al, bc - bl), np.minimum(ar - ac, br - bc)
        wide = (before + after + 1 >= width) & (a != b)
        a, b, j = a[wide], b[wide], j[wide]
        x, y = (ac - before)[wide], (ac + after)[wide] + 1  # in a
        shift = (bc - ac)[wide]
        order = np.lexsort((x, b, a))
        out: list[list[int]] = [[] for _ in range(6)]
        open_: list[list] = []

        def close(kept: list[list]) -> None:
            for chain in open_:
                if chain not in kept and len(chain[6]) >= ENOUGH:
                    for column, v in zip(out, chain[:6]):
                        column.append(v)
            open_[:] = kept

        for da, db, s, e, d, h in zip(*(v[order].tolist() for v in (a, b, x, y, shift, j))):
            if open_ and (open_[0][0] != da or open_[0][3] != db):
                close([])
            elif any(s + width > c[2] for c in open_):
                close([c for c in open_ if s + width <= c[2]])
            for chain in open_:
                low, high = max(chain[4], s + d), min(chain[5], e + d)
                if high - low >= width:  # they overlap in both documents
                    chain[2], chain[4] = max(chain[2], e), min(chain[4], s + d)
                    chain[5] = max(chain[5], e + d)
                    chain[6].add(h)
                    break
            else:
                open_.append([da, s, e, db, s + d, e + d, {h}])
        close([])
        if out[0]:
            arrays = [pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), pa.int32()] * 2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "al", "ar", "b", "bl", "br"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the stretches begin (from `s` to before `e`) that may be equal in both of a pair."""
    width = WORDS - SHINGLE + 1
    for batch in batches:
        around = batch.column("before").to_numpy()
        out = []
        for doc, l, c, r in (("a", "al", "ac", "ar"), ("b", "bl", "bc", "br")):
            ids, l, c, r = (batch.column(x).to_numpy() for x in (doc, l, c, r))
            # They hold the centre, and the equal shingle before or after it.
            low = np.where(around & 1, c - width + 1, c + _AROUND - width + 1)
            high = np.where(around & 2, c, c - _AROUND)
            low, high = np.maximum(low, l), np.minimum(high, r - width + 1) + 1
            out.append(np.stack([ids, low, high])[:, low < high])
        out = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v).cast(t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32()))],
            names=["doc_id", "s", "e"],
        )


STRETCHES = (
    "doc bigint, s int, e int, grams binary, hash bigint, more int, first bigint, first_s int"
)
_STRETCH_TYPES = [pa.int64(), *[pa.int32()] * 2, pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def stretch_hashes(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of each stretch of `width` shingles, by its first place."""
    n = len(values)
    out = []
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        back = np.full(n + 1, _UNBASE, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        for own in (values, W.mixed(values)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:-1])])
            out.append(W.mixed((sums[width:] - sums[:-width]) * back[: n - width + 1]))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (hash, more, doc, s) that are first of their hashes, and the others with their first."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    head = rows[:, np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = head[2] != rows[2]
    return rows[:, first], np.concatenate([rows, head[2:]])[:, other]


def _stretches(columns: list, n: int) -> pa.RecordBatch:
    arrays = [
        pa.nulls(n, t) if c is None else pa.array(c).cast(t) if t != pa.binary() else pa.array(c, t)
        for c, t in zip(columns, _STRETCH_TYPES)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in STRETCHES.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the asked stretches of each text; of its hashed stretches, one of each hash
    and the others with it."""
    width = WORDS - SHINGLE + 1
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        held.clear()
        heads, others = _equal(rows)
        del rows
        for low in range(0, heads.shape[1], _OUT):
            hashes, more, doc, s = heads[:, low : low + _OUT]
            yield _stretches([doc, s, None, None, hashes, more, None, None], len(doc))
        for low in range(0, others.shape[1], _OUT):
            hashes, more, doc, s, first, first_s = others[:, low : low + _OUT]
            yield _stretches([doc, s, None, None, hashes, more, first, first_s], len(doc))

    for batch in batches:
        asked, ids = batch.column("spans").to_pylist(), batch.column("doc_id").to_pylist()
        for low, high, values, at in shingles_of(batch.column("text")):
            rows = []
            for k in range(low, high):
                own = values[at[k - low] : at[k - low + 1]]
                starts = np.zeros(len(own) + 1, np.int64)
                for s, e, whole in ((x["s"], x["e"], x["whole"]) for x in asked[k]):
                    if whole:
                        starts[s] += 1
                        starts[e] -= 1
                    else:
                        rows.append((ids[k], s, e, own[s:e].tobytes()))
                starts = np.flatnonzero(np.cumsum(starts) > 0)
                if len(starts):
                    hashes, more = (h[starts] for h in stretch_hashes(own, width))
                    held.append(np.stack([hashes, more, np.full(len(starts), ids[k]), starts]))
            if rows:
                yield _stretches([*([r[c] for r in rows] for c in range(4)), *[None] * 4], len(rows))
            if sum(h.shape[1] for h in held) > _HELD:
                yield from flush()
    if held:
        yield from flush()


MATCHES = "doc bigint, s int, first bigint, first_s int"


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal stretches of two documents, of rows in runs of one hash."""
    for table in _runs(batches, ["hash"]):
        own = [table.column(c).to_numpy().astype(np.int64) for c in ("hash", "more", "doc", "s")]
        _, others = _equal(np.stack(own))
        kinds = [f.split()[0] for f in MATCHES.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v).cast(t) for v, t in zip(others[2:], [pa.int64(), pa.int32()] * 2)], names=kinds
        )


def _joined(matches: DataFrame) -> DataFrame:
    """Passages of the equal stretches that follow on each other."""
    shift = F.col("first_s") - F.col("s")
    matches = matches.withColumn("shift", shift).drop("first_s").distinct()
    line = Window.partitionBy("doc", "first", "shift").orderBy("s")
    islands = matches.withColumn("island", F.col("s") - F.row_number().over(line))
    ends = islands.groupBy("doc", "first", "shift", "island").agg(
        F.min("s").alias("start"), (F.max("s") + WORDS).alias("stop")
    )
    return ends.select(
        F.col("doc").alias("doc_id"),
        "start",
        "stop",
        F.col("first").alias("first_doc_id"),
        (F.col("start") + F.col("shift")).alias("first_start"),
        (F.col("stop") + F.col("shift")).alias("first_stop"),
        F.lit(1.0).alias("similarity"),
    )


def segments(shared: np.ndarray, percent: int, width: int) -> list[tuple[int, int]]:
    """Stretches of at least `width` places of which `percent` are shared, the longest first.

    The longest one is taken, then those left and right of it; each begins and ends with a shared
    place.
    """
    found, todo = [], [(0, len(shared))]
    while todo:
        low, high = todo.pop()
        if high - low < width:
            continue
        sums = np.concatenate([[0], np.cumsum(np.where(shared[low:high], 100 - percent, -percent))])
        # For each end, the first start from which the sum is not negative.
        start = np.searchsorted(-np.minimum.accumulate(sums), -sums)
        end = int(np.argmax(np.arange(len(sums)) - start))
        inside = np.flatnonzero(shared[low + start[end] : low + end])
        if not len(inside):
            continue
        s, e = low + int(start[end] + inside[0]), low + int(start[end] + inside[-1]) + 1
        if e - s >= width:
            found.append((s, e))
            todo += [(low, s), (e, high)]
    return found


# If both stretches share a part f of their shingles, the sets' similarity is f / (2 - f). Where the
# widest stretches at that part are not similar enough after all, stricter parts are tried inside.
_PARTS = (-(-200 * PERCENT // (100 + PERCENT)), 95, 100)


def align(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int, int, int, float]]:
    """Stretches of both that are at least `width` shingles and similar enough, as sets."""
    out, met = [], np.isin(x, y)
    todo = [(s, e, 0) for s, e in segments(met, _PARTS[0], width)]
    while todo:
        s, e, level = todo.pop()
        best, p = None, np.unique(x[s:e])
        for t, f in segments(np.isin(y, p), _PARTS[level], width):
            q = np.unique(y[t:f])
            shared = len(np.intersect1d(p, q, assume_unique=True))
            both = len(p) + len(q) - shared
            if 100 * shared >= PERCENT * both and (best is None or shared / both > best[4]):
                best = (s, e, t, f, shared / both)
        if best:
            out.append(best)
        elif level + 1 < len(_PARTS):
            inner = segments(met[s:e], _PARTS[level + 1], width)
            todo += [(s + i, s + k, level + 1) for i, k in inner]
    return sorted(out)


PASSAGES = (
    "doc_id bigint, start int, stop int, first_doc_id bigint, first_start int, first_stop int, "
    "similarity double"
)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = WORDS - SHINGLE + 1
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            x, y = np.frombuffer(r["x"], np.uint64), np.frombuffer(r["y"], np.uint64)
            for s, e, t, f, similarity in align(x, y, width):
                a, b = (r["as"] + s, r["as"] + e), (r["bs"] + t, r["bs"] + f)
                more = SHINGLE - 1  # words of the last shingle
                rows.append((r["a"], a[0], a[1] + more, r["b"], b[0], b[1] + more, similarity))
        kinds = [pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.float64()]
        names = [p.split()[0] for p in PASSAGES.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names
        )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of `doc_id` (words `start` to before `stop`) that an earlier document has too.

    The earlier document is the one of the smaller id, `first_doc_id`; `similarity` is that of the
    two passages' sets of five-word shingles (words are lower-cased A-Z, parted by bytes 0x20 and
    0x09 to 0x0D). Passages have 50 words at least. A passage is given once for each earlier
    document it was compared with and found similar to. Of equal texts, all but the least doc_id
    repeat that one as a whole, and only it is compared with others. Null and short texts, and rows
    without a doc_id, have no passages. Rows that repeat a doc_id with its text are one document; of
    a doc_id with several texts each text is a document, the order among them by their hashes, and
    `text_hash` (xxhash64, otherwise null) says which one is meant.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    digest = F.struct(*_digest())
    many = texts.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    many = written(many.where("low <> high").select("doc_id"), "many-texts")
    if many.isEmpty():
        return _repeated(texts).withColumn("text_hash", F.lit(None).cast("bigint"))
    # Ids are spread out, so that the texts of one have room beside each other.
    keyed = texts.select("doc_id", "text", *_digest())
    known = keyed.join(many, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct()
    order = Window.partitionBy("doc_id").orderBy("h1", "h2")
    known = written(known.withColumn("variant", F.row_number().over(order) - 1), "variants")
    step = known.agg(F.max("variant")).first()[0] + 1
    spread = F.col("doc_id") * step + F.coalesce("variant", F.lit(0))
    some, rest = sifted(keyed, many)
    keyed = some.join(known, ["doc_id", "h1", "h2"], "left").unionByName(
        rest.withColumn("variant", F.lit(None).cast("int"))
    )
    found = _repeated(keyed.select(spread.alias("doc_id"), "text"))

    def id_of(name: str) -> F.Column:
        return F.expr(f"({name} - pmod({name}, {step})) DIV {step}L")

    back = found.withColumn("variant", F.pmod("doc_id", F.lit(step)).cast("int"))
    back = back.withColumn("doc_id", id_of("doc_id")).withColumn("first_doc_id", id_of("first_doc_id"))
    back = back.join(known.select("doc_id", "variant", F.col("h1").alias("text_hash")), ["doc_id", "variant"], "left")
    return back.select(*found.columns, "text_hash")


def _digest() -> list[F.Column]:
    return [F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2")]


def _repeated(texts: DataFrame) -> DataFrame:
    """The passages of texts of which no two have one id."""
    digest = _digest()
    same = texts.select("doc_id", *digest).groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")
    )
    same = written(same.where("n > 1"), "equal-texts")
    some, _ = sifted(texts.select("doc_id", "text", *digest), same.select("h1", "h2"))
    copies = some.join(same, ["h1", "h2"])
    copies = copies.where("doc_id <> first_doc_id").select("doc_id", "first_doc_id", "text")
    copies = written(copies.mapInArrow(lean(_whole), PASSAGES), "copies")
    copied = copies.select("doc_id").distinct()
    some, rest = sifted(texts, copied)
    distinct = rest.union(some.join(copied, "doc_id", "left_anti").select(*rest.columns))

    made = distinct.mapInArrow(lean(_make), ROWS).repartition("key").sortWithinPartitions("key")
    met = written(made.mapInArrow(lean(_meet), ROWS), "met")
    around = met.where("j = 0 AND before > 0").mapInArrow(_starts, "doc_id bigint, s int, e int")
    met = met.where("a <> b").repartition("a", "b").sortWithinPartitions("a", "b")
    near = written(met.mapInArrow(lean(_overlaps), CANDIDATES).distinct(), "candidates")

    def grid(low: str, high: str) -> list[F.Column]:
        return [
            (F.floor(F.col(low) / _GRID) * _GRID).cast("int"),
            (F.ceil(F.col(high) / _GRID) * _GRID).cast("int"),
        ]

    (a_s, a_e), (b_s, b_e) = grid("al", "ar"), grid("bl", "br")
    pairs = near.select(
        "a", a_s.alias("as"), a_e.alias("ae"), "b", b_s.alias("bs"), b_e.alias("be")
    ).distinct()
    spans = pairs.select(F.col("a").alias("doc_id"), F.col("as").alias("s"), F.col("ae").alias("e"))
    spans = spans.union(pairs.select("b", "bs", "be")).distinct().withColumn("whole", F.lit(False))
    spans = spans.union(around.distinct().withColumn("whole", F.lit(True)))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "whole")).alias("spans"))
    spans = written(spans, "spans")
    some, _ = sifted(texts, spans.select("doc_id"))
    cut = some.join(spans, "doc_id").mapInArrow(lean(_cut), STRETCHES)
    cut = written(cut, "stretches")
    grams = cut.where("hash IS NULL")
    heads = cut.where("hash IS NOT NULL AND first IS NULL").select("hash", "more", "doc", "s")
    heads = heads.repartition("hash").sortWithinPartitions("hash")
    others = cut.where("first IS NOT NULL").select("doc", "s", "first", "first_s")
    equal = _joined(heads.mapInArrow(lean(_same), MATCHES).union(others))

    def side(doc: str, s: str, e: str, name: str) -> DataFrame:
        return grams.select(
            F.col("doc").alias(doc), F.col("s").alias(s), F.col("e").alias(e),
            F.col("grams").alias(name),
        )

    both = pairs.join(side("a", "as", "ae", "x"), ["a", "as", "ae"])
    both = both.join(side("b", "bs", "be", "y"), ["b", "bs", "be"])
    checked = both.select("a", "as", "b", "bs", "x", "y").mapInArrow(lean(_verify), PASSAGES)
    checked = written(checked.distinct(), "checked")
    inside = checked.select("doc_id", F.col("start").alias("s"), F.col("stop").alias("e")).distinct()
    new = equal.join(
        inside,
        (equal["doc_id"] == inside["doc_id"]) & (F.col("start") >= F.col("s")) & (F.col("stop") <= F.col("e")),
        "left_anti",
    )
    return checked.union(new.select(checked.columns)).union(
        copies.where(F.col("stop") >= WORDS).select(checked.columns)
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies as passages: all their words."""
    names = [p.split()[0] for p in PASSAGES.split(", ")]
    for batch in batches:
        counts = np.concatenate(
            [np.zeros(0, np.int64)]
            + [np.diff(W.word_spans(d, at)[2]) for _, _, d, at in W.chunks(batch.column("text"))]
        )
        zero = pa.array(np.zeros(len(counts), np.int32))
        n = pa.array(counts.astype(np.int32))
        one = pa.array(np.ones(len(counts)))
        arrays = [batch.column("doc_id"), zero, n, batch.column("first_doc_id"), zero, n, one]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the passages that an earlier document has; other columns as they are.

    Only texts with such passages change; what is left of them is not trimmed. A text that is all
    repeat becomes empty. A null text stays null.
    """
    names = docs.columns
    own = "_spans"
    while own in names:
        own += "_"
    spans = passages.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    spans = written(spans, "spans")
    some, rest = sifted(docs, spans.select(F.col("id").alias("doc_id")))
    spans = spans.select(F.struct("id", "text_hash", "spans").alias(own))
    asked = F.col(f"{own}.text_hash")
    joined = some.join(
        spans,
        (some["doc_id"] == F.col(f"{own}.id")) & (asked.isNull() | (asked == F.xxhash64(some["text"]))),
        "left",
    )
    joined = joined.select(*names, F.col(f"{own}.spans").alias(own))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column(own).to_pylist()):
                if spans and texts[k]:
                    texts[k] = _cut_words(texts[k], [(s["start"], s["stop"]) for s in spans])
            columns = [
                pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rest.union(joined.mapInArrow(lean(cut), schema))


def _cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    data = text.encode()
    at = np.array([0, len(data)])
    starts, ends, _ = W.word_spans(np.frombuffer(data, np.uint8), at)
    kept, done = [], 0
    for a, b in sorted(spans):
        low, high = int(starts[a]), int(ends[min(b, len(ends)) - 1])
        if high > done:
            kept.append(data[done : max(done, low)])
            done = high
    kept.append(data[done:])
    return b"".join(kept).decode()
