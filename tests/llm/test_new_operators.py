"""Hard negatives, periodic runs and packing against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.llm import four_russians, packing, recompression, registry
from patronage.llm.pieces import tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# ---- hard negatives


def brute_negatives(rows, asks, k=5, m=3, least=50, most=95):
    """Expected rows (anchor, positive, rank, negative, positive score, negative score)."""
    rows = [(i, lab, q) for i, lab, q in rows if i is not None and lab is not None and q]
    anchors = {}
    for i, lab, q in rows:
        if asks(i):
            anchors[i] = min(anchors.get(i, (lab, q)), (lab, q))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted(
            (-sum(x * y for x, y in zip(q, w)), i, lab)
            for i, lab, w in rows
            if i != a and len(w) == len(q)
        )
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            near = [r for r in scored if r[2] != label and least * -s <= -100 * r[0] <= most * -s]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(near[:m])]
    return sorted(out)


def negatives(spark, rows, asks, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, q array<long>, block int")
    found = four_russians.hard_negatives(df, asks, **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("wide", [4, 300, 1 << 20, 1 << 29])
def test_hard_negatives(spark, wide):
    rng = np.random.default_rng(wide)
    rows = []
    for i in range(300):
        size = 11 if i % 9 else 3
        q = rng.integers(-wide, wide, size).tolist()
        rows.append((i, int(rng.integers(0, 3)), q))
    rows += rows[:40] + [rows[7]] * 30  # repeated rows, one of them often
    rows += [(400 + i, 1, [2] * 11) for i in range(60)]  # one common vector
    rows += [(5, 2, [1] * 11), (None, 1, [1] * 11), (600, None, [1] * 11), (601, 1, None), (602, 1, [])]
    found = negatives(
        spark, [(*r, 0) for r in rows], F.col("vec_id") % 5 == 0, block_rows=64, group=16
    )
    assert found == brute_negatives(rows, lambda i: i % 5 == 0)
    assert found


def test_hard_negatives_of_nothing(spark):
    assert negatives(spark, [], F.col("vec_id") % 5 == 0) == []
    assert negatives(spark, [(1, 1, [1], 0), (2, 0, [1], 0)], F.col("vec_id") % 5 == 0) == []


def test_scores_by_look_up():
    rng = np.random.default_rng(3)
    for low, high in ((-3, 4), (0, 1), (-(1 << 40), 1 << 40), (-(1 << 62), 1 << 62)):
        rows, anchors = (rng.integers(low, high, (n, 13)) for n in (70, 9))
        planes = four_russians.bit_planes(rows)
        sums = four_russians.subset_sums(anchors, len(planes))
        found = four_russians.scores(sums, planes)
        assert (found == rows.astype(object) @ anchors.T.astype(object)).all()


# ---- periodic runs


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - k >= max(6, 4 * q):
                found.setdefault((k, end + q), q)
            k = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.integers(1, 9))
def test_runs_of_any_words(texts, times):
    texts = [t[:9] * times + t for t in texts]
    at = np.cumsum([0, *map(len, texts)])
    found = recompression._found(np.array([w for t in texts for w in t], np.int64), at)
    for text, (start, end, period) in zip(texts, found):
        got = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        assert got == brute_runs(text)


def test_agreement_through_the_grammar(monkeypatch):
    monkeypatch.setattr(recompression, "_LEAST_SYMBOLS", 4)
    rng = np.random.default_rng(4)
    text = np.concatenate([np.tile(rng.integers(0, 3, 50), 12), np.zeros(300, int), rng.integers(0, 2, 500)])
    text = np.concatenate([[7], text, [8]])
    levels = recompression.grammar(text)
    assert len(levels) > 5
    x, y = rng.integers(1, len(text) - 1, (2, 2000))
    x, y = x[x != y], y[x != y]
    ahead = recompression.agreement(levels, x, y)
    behind = recompression.agreement(levels, x, y, back=True)
    for i, j, n, m in zip(x, y, ahead, behind):
        assert (text[i : i + n] == text[j : j + n]).all() and text[i + n] != text[j + n]
        assert (text[i - m : i] == text[j - m : j]).all() and text[i - m - 1] != text[j - m - 1]


def test_found_runs(spark, documents):
    line = "Ja ja ja NEIN ja\tja \n"
    rows = [
        (1, line * 30),
        (1, line * 30),
        (1, "ja " * 6),
        (2, None),
        (3, ""),
        (4, " \t\n"),
        (None, "a b " * 9 + "x " * 3),
        (5, "é  é  é  é  é  é  z"),  # a blank that parts no words
        (6, "x " * 70_000 + "y z " * 50_000),
        (7, "one two three"),
    ]
    found = recompression.find_runs(documents(rows, extra=True)).collect()
    expected = []
    for doc_id, text in rows:
        words = registry._WORD.findall(text or "")
        runs = (
            [(0, 70_000, 1), (70_000, 100_000, 2)] if doc_id == 6 else brute_runs(words)
        )
        expected.append((doc_id, len(words), runs, collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert recompression.find_runs(documents([])).count() == 0


def test_runs_of_given_documents(spark, small):
    found = {r.doc_id: r for r in registry.op12_recompression(spark, small).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    repeated = 0
    for doc_id, text in rows:
        words = registry._WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        repeated += len(runs)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = found[doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        told = (r.start, r.length, r.period, r.exponent_milli)
        if best:
            n, s, q = best
            assert told == (s, -n, q, 1000 * -n // q)
        else:
            assert told == (None,) * 4
    assert repeated > 5


# ---- packing


def check_packed(rows, found, window=2048, slack=packing.SLACK):
    """Every id in one piece, no gap in a sequence, little padding."""
    loaded, texts = tokenizer(BYTES), {}
    for doc_id, text in rows:
        ids = [*loaded.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        texts.setdefault(doc_id, []).append(ids)
    padding = powers = 0
    got: dict = {}
    for sequence in found:
        kind = f"<u{len(sequence.ids) // sequence.length}"
        ids = np.frombuffer(sequence.ids, kind)
        assert len(ids) == sequence.length <= window
        at = 0
        for p in sequence.pieces:
            assert p.offset == at
            own = ids[at : at + p.length]
            assert zlib.crc32(own.astype("<u4")) == p.ids_crc32
            got.setdefault(p.doc_id, []).append((p.doc_tokens, p.start, own.tolist()))
            at += p.length
        assert at == sequence.length
        if sequence.length & (sequence.length - 1):
            assert window - sequence.length <= slack
            padding += window - sequence.length
        powers += sequence.length < window - slack
    assert powers < window.bit_length()
    assert len({s.sequence_id for s in found}) == len(found)
    assert got.keys() == texts.keys()
    for doc_id, pieces in got.items():
        assert sorted(t for p in pieces for t in p[2]) == sorted(t for d in texts[doc_id] for t in d)
        if len(texts[doc_id]) == 1:
            whole = sorted(pieces, key=lambda p: p[1])
            assert [t for p in whole for t in p[2]] == texts[doc_id][0]
            assert [p[1] for p in whole] == np.cumsum([0, *(len(p[2]) for p in whole)])[:-1].tolist()
            assert {p[0] for p in whole} == {len(texts[doc_id][0])}
    return padding


def test_packing_of_all_kinds(spark, documents):
    rng = np.random.default_rng(13)
    rows = [(i, "word " * int(rng.integers(0, 900))) for i in range(300)]
    rows += [(1000, "long text " * 60_000), (1001, None), (1002, ""), (None, "x"), (None, "y"), (7, "again")]
    found = packing.pack(documents(rows, extra=True).repartition(20), BYTES, open_windows=5).collect()
    check_packed(rows, found)
    assert packing.pack(documents([]), BYTES).count() == 0
    assert check_packed([(1, None)], packing.pack(documents([(1, None)]), BYTES).collect()) == 0


def test_packing_merges_in_turns(spark, documents):
    rows = [(i, "a b c " * (i % 40)) for i in range(700)]
    found = packing.pack(documents(rows).repartition(70), BYTES, window=128, open_windows=3).collect()
    check_packed(rows, found, window=128)
    assert len({s.sequence_id >> 58 for s in found}) == 4  # tasks, nine groups, two groups, one


def test_packing_keeps_short_documents_whole():
    packer = packing.Packer(100, 8, 8)
    rng = np.random.default_rng(2)
    pieces = [(np.arange(n), k, 0, n) for k, n in enumerate(rng.integers(1, 90, 2000).tolist())]
    out = [w for p in pieces for w in packer.put(p)] + list(packer.rest())
    cut = sum(len(p[0]) < p[3] for w in out for p in w if p[2] == 0)
    assert sum(len(p[0]) for w in out for p in w) == sum(p[3] for p in pieces)
    assert cut < len(out) / 3 and len(packer.free) <= 8  # plain cutting: nearly every window


def test_packing_of_given_documents(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    found = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), BYTES).collect()
    padding = check_packed(rows, found)
    assert padding < 0.005 * sum(s.length for s in found)
    pieces = registry.op13_packing(spark, small)
    assert pieces.columns[:1] == ["sequence_id"]
    assert pieces.agg(F.sum("length")).first()[0] == sum(s.length for s in found)
