"""Chosen-path join, compact windows and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from patronage.llm import chosen_path, compact_windows, words, work
from patronage.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    best = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, x in sets.items():
            for j, y in sets.items():
                if x and y and 100 * len(x & y) >= percent * len(x | y) and best[i] < best[j]:
                    best[j] = best[i]
                    changed = True
    return sorted((i, len(sets[i]), best[i], best[i] == i) for i in sets)


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randint(0, 9_999)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("node", [2_048, 8])
def test_near_duplicates(documents, monkeypatch, node):
    monkeypatch.setattr(chosen_path, "NODE", node)
    rng = random.Random(5)
    texts = near_copies(rng, 60, 60, 5) + near_copies(rng, 10, 40, 8) + ["same text here now"] * 9
    texts += ["", None, "  ", "one", "ONE", "two words", "Two  words", "x " * 4_000, "x x x"]
    texts += [" ".join(f"u{k}_{i}" for i in range(30)) for k in range(20)]
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    out = chosen_path.near_duplicates(documents(rows, extra=True), 3, 85)
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 85)


@pytest.mark.parametrize("common", [256, 4])
def test_no_pair_is_missed_by_few_trees(documents, monkeypatch, common):
    # One tree misses about one in nine pairs at the threshold.
    monkeypatch.setattr(chosen_path, "trees_for", lambda percent: 1)
    monkeypatch.setattr(chosen_path, "COMMON", common, raising=False)
    line = " ".join(f"line{i}" for i in range(7))  # three shingles that all texts have
    texts = [f"{line} " + " ".join(f"a{k}w{i}" for i in range(22)) for k in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)]
    # 25 shingles of each, of which 23 are in the copy: 85 in a hundred of all.
    rows += [(1_000 + k, f"{t.rsplit(' ', 2)[0]} x y") for k, t in enumerate(texts)]
    out = chosen_path.near_duplicates(documents(rows), 5, 80).collect()
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert got == {k: k % 1_000 for k, _ in rows}


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_prefixes_of_similar_sets_meet(percent):
    rng = np.random.default_rng(percent)
    common = rng.permutation(40).astype(np.uint64)
    for _ in range(300):
        one = rng.choice(60, rng.integers(1, 30), replace=False)
        two = np.unique(np.where(rng.random(len(one)) < percent / 100, one, rng.integers(0, 60, len(one))))
        sets = [np.unique(one).astype(np.uint64), two.astype(np.uint64), one[:0].astype(np.uint64)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        for order in (common, common[:0]):
            a, b, none = chosen_path.prefixes(np.concatenate(sets), at, percent, order)
            shared = len(np.intersect1d(sets[0], sets[1]))
            if 100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared):
                assert set(np.frombuffer(a, np.uint64)) & set(np.frombuffer(b, np.uint64))
            assert none == b"" and len(a) == 8 * (len(one) - -(-percent * len(one) // 100) + 1)


def test_shingles_go_through_one_exchange(documents, monkeypatch):
    monkeypatch.setattr(chosen_path, "BROADCAST_ROWS", 0)
    plans, written = [], chosen_path.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return written(df, name)

    monkeypatch.setattr(chosen_path, "written", seen)
    rows = [(k, " ".join(f"line{i}" for i in range(9)) + f" a{k} b{k} c{k}") for k in range(40)]
    assert chosen_path.near_duplicates(documents(rows), 3, 85).where("kept").count() == 40
    spread = [p for p in plans if re.search(r"MapInArrow run\([^)]*prefix#", p)]
    assert len(spread) == 1


def test_long_sets_share_more_shingles():
    rng = np.random.default_rng(6)
    for n in (100, 600, 5_000):
        one = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        keep = -(-80 * 2 * len(one) // 180)  # just similar enough
        gone = np.zeros(len(one), bool)
        gone[: len(one) - keep] = True  # the first ones differ
        two = np.unique(np.where(gone, one // 2, one))
        flat = np.concatenate([one, two])
        at = np.array([0, len(one), len(one) + len(two)])
        seen = [np.frombuffer(b, np.uint64) for b in chosen_path.prefixes(flat, at, 80, one[:0])]
        key, place = np.concatenate(seen), np.concatenate([np.arange(len(x)) for x in seen])
        row = np.repeat([0, 1], list(map(len, seen)))
        size = np.diff(at)[row]
        order = np.lexsort((size, key))
        rows = [key.view(np.int64), row, row, size, place]
        sketch = chosen_path.sketches(flat, np.repeat([0, 1], np.diff(at)), 2)[row]
        found = list(chosen_path._tried([c[order] for c in rows], sketch[order], 80))
        times = sum(int(f[2].sum()) for f in found)
        assert times >= found[0][3][0] == 1 + min(len(one), len(two)) // chosen_path.MORE


def test_sketches_bound_what_sets_do_not_share():
    rng = np.random.default_rng(4)
    for n in (1, 30, 300, 3_000):
        one = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for kept in (0, n // 2, n - 1, n):
            more = rng.integers(0, 1 << 64, n - kept, dtype=np.uint64)
            two = np.unique(np.concatenate([one[:kept], more]))
            row = np.repeat([0, 1], [len(one), len(two)])
            own = chosen_path.sketches(np.concatenate([one, two]), row, 2)
            least = int(chosen_path.apart(own[:1], own[1:])[0])
            assert least <= len(np.setxor1d(one, two)) and (least > 0) == (kept < n)


def test_members_of_keys_in_batches(monkeypatch):
    """Pairs of small keys; members of large ones, wherever batches begin, pass."""
    monkeypatch.setattr(chosen_path, "NODE", 5)
    sizes = [1, 5, 12, 2, 6, 1, 3]
    key = np.repeat(np.arange(len(sizes)), sizes)
    ids = np.arange(len(key))
    zero = np.zeros(len(key), np.int64)
    columns = [key, ids, ids, zero + 10, zero.astype(np.int32), *[zero] * 4]
    names = [f.split()[0] for f in chosen_path.SHINGLES.split(", ")]
    table = pa.Table.from_arrays([pa.array(c) for c in columns], names=names)
    for step in (1, 2, 4, 7, 100):
        out = pa.Table.from_batches(chosen_path._meet(80)(table.to_batches(max_chunksize=step)))
        got = out.to_pylist()
        pairs = sorted((r["a"], r["b"]) for r in got if r["key"] is None)
        assert pairs == [(a, b) for a in ids for b in ids[a + 1 :] if key[a] == key[b] and sizes[key[a]] <= 5]
        passed = sorted((r["key"], r["a"], r["label"]) for r in got if r["key"] is not None)
        assert passed == [(key[a], a, a) for a in ids if sizes[key[a]] > 5]


@pytest.mark.parametrize("percent", [70, 80, 85, 95, 100])
def test_trees_follow_the_threshold(percent):
    # Pairs of random minima that agree as often as sets at the threshold do, in the deepest nodes.
    trees, rng = chosen_path.trees_for(percent), np.random.default_rng(percent)
    shape = (40_000, trees * chosen_path.DEEPER * 2)
    one = rng.integers(0, 1 << 32, shape, dtype=np.uint32)
    two = np.where(rng.random(shape) < percent / 100, one, one + 1)
    met = np.zeros(len(one), bool)
    for tree in range(trees):
        a, b = (chosen_path._keys(x, tree, chosen_path.DEEPER) for x in (one, two))
        met |= (a == b).any(axis=1)
    assert (~met).sum() <= 4


def test_large_nodes_are_dealt_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE", 10)
    rows = [(7, k, 1_000 if k < 40 else k) for k in range(100)] + [(8, 1, 1), (8, 2, 2), (9, 3, 3)]
    members = spark.createDataFrame(rows, "key bigint, doc_id bigint, label bigint")
    groups = {}
    for r in chosen_path._blocks(members, 2, True).collect():
        groups.setdefault((r["key"], r["block"]), []).append((r["doc_id"], r["label"], r["side"]))
    assert max(map(len, groups.values())) < 50
    met = []
    for found in groups.values():
        for i, (a, x, s) in enumerate(found):
            met += [
                (min(a, b), max(a, b)) for b, y, t in found[:i] if x != y and (s == 0 or s != t)
            ]
    want = [(a, b) for a in range(100) for b in range(a + 1, 100) if b >= 40]
    assert sorted(met) == sorted([*want, (1, 2)])


def test_repeated_and_missing_ids(documents):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (2, text), (None, text), (9, None), (None, None)]
    out = chosen_path.near_duplicates(documents(rows), 3, 85).collect()
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in out)
    assert got == [
        ("2", 5, "2", True),
        ("5", 5, "2", False),
        ("5", 5, "2", False),
        ("9", 0, "9", True),
        ("None", 0, "None", True),
        ("None", 5, "None", True),
    ]
    assert chosen_path.near_duplicates(documents([]), 3, 85).count() == 0


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict(map(tuple, components(frame).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_shingles_by_hash():
    texts = ["A b\tc d", "a B c D", "ab c d", "", None, "a", "a b", "é É x", "a b c d a b c"]
    for low, high, flat, at in chosen_path.sets_of(pa.array(texts), 3):
        assert (low, high) == (0, len(texts))
        got = [frozenset(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    want = [shingles(t, 3) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("values", [200, 3, 1])
def test_windows_stand_for_all_stretches(values):
    rng = np.random.default_rng(values)
    hashes, at, width = rng.integers(0, values, 60).astype(np.uint64), np.array([0, 35, 35, 60]), 6
    low, centre, high = compact_windows.windows(hashes, at, width)
    for a, b in zip(at[:-1], at[1:]):
        for s in range(a, b):
            for e in range(s + width - 1, b):
                hits = [
                    hashes[c] for l, c, r in zip(low, centre, high) if l <= s <= c <= e <= r
                ]
                assert len(hits) == 1 and hits[0] == hashes[s : e + 1].min()


def passage(rng, n, name):
    return [f"{name}{rng.randint(0, 10**6)}" for _ in range(n)]


def test_repeated_passages(documents):
    rng = random.Random(2)
    shared, other = passage(rng, 60, "s"), passage(rng, 80, "o")
    edited = list(other)
    edited[40] = "changed"
    rows, starts = [], {}
    for k in range(40):
        before, after = passage(rng, rng.randint(0, 90), "b"), passage(rng, rng.randint(0, 90), "a")
        middle = {0: shared, 1: other, 2: edited, 3: passage(rng, 60, "m")}[k % 4]
        starts[k] = len(before)
        rows.append((k, " ".join(before + middle + after)))
    rows += [(100, rows[7][1]), (101, None), (102, ""), (103, "short"), (None, rows[0][1])]
    docs = documents(rows, extra=True)
    found = compact_windows.repeated_passages(docs).collect()
    covered = {}
    for r in found:
        assert r["first_doc_id"] < r["doc_id"] and r["stop"] - r["start"] >= 50
        assert r["similarity"] >= 0.8
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    for k in range(40):
        if k % 4 == 3 or k < 2:
            assert k not in covered
        else:
            size = 60 if k % 4 == 0 else 80
            assert covered[k] >= set(range(starts[k], starts[k] + size))
            assert len(covered[k]) <= size + 10
    n = len(rows[7][1].split())
    assert covered[100] == set(range(n)) and set(covered) <= {100, *range(40)}

    passages = compact_windows.repeated_passages(docs)
    cut = {r["doc_id"]: r["text"] for r in compact_windows.without_repeats(docs, passages).collect()}
    assert cut[0] == rows[0][1] and cut[100] == "" and cut[101] is None and cut[102] == ""
    assert all(w not in cut[4].split() for w in shared) and "b" in cut[36]
    assert compact_windows.repeated_passages(documents([])).count() == 0


def test_hot_passage_and_repeated_words(documents):
    rng = random.Random(4)
    line = passage(rng, 55, "hot")
    rows = [(k, " ".join(passage(rng, 20, "x") + line)) for k in range(300)]
    rows += [(1_000 + k, "again " * 600) for k in range(3)] + [(2_000, "again " * 3_000)]
    found = compact_windows.repeated_passages(documents(rows))
    assert found.where("doc_id < 300").select("doc_id").distinct().count() == 299
    assert found.where("doc_id < 300").count() < 3 * 300
    assert {r[0] for r in found.where("doc_id >= 1000").select("doc_id").collect()} >= {1_001, 1_002}


def test_passages_behind_shorter_stretches(documents):
    rng = random.Random(11)
    rows, whole = [], {}
    for g in range(12):
        shared = passage(rng, 60, "s")
        for k in range(4):  # the first two hold less than a passage of it, at other places
            middle = [shared[8:53], shared[4:48], shared, shared][k]
            before, after = passage(rng, 70, "b"), passage(rng, 70, "a")
            rows.append((10 * g + k, " ".join(before + middle + after)))
            whole[10 * g + k] = range(70, 130)
    covered = {}
    for r in compact_windows.repeated_passages(documents(rows)).collect():
        assert r["first_doc_id"] == r["doc_id"] - 1
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    assert covered == {10 * g + 3: set(whole[10 * g + 3]) for g in range(12)}


def test_ids_with_several_texts(documents):
    rng = random.Random(8)

    def text(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    shared = [text(60) for _ in range(4)]
    rows = [
        (5, f"{text(20)} {shared[0]} {text(30)}"),
        (5, f"{text(200)} {shared[1]} {text(3)}"),
        (5, f"{shared[2]} {text(9)}"),
        (5, f"{shared[2]} {text(9)}"),
        (7, f"{text(40)} {shared[0]}"),
        (8, f"{shared[1]} {text(40)}"),
        (-3, f"{text(11)} {shared[2]} {text(12)}"),
        (9, shared[3]),
        (9, f"{shared[3]} {text(5)}"),
        (10, text(80)),
    ]
    rows.append((5, rows[2][1]))
    docs = documents(rows, extra=True)
    passages = compact_windows.repeated_passages(docs)
    found = {(r.doc_id, r.first_doc_id, r.stop - r.start) for r in passages.collect()}
    assert found >= {(7, 5, 60), (8, 5, 60), (5, -3, 60), (9, 9, 60)}
    assert found <= {(7, 5, 60), (8, 5, 60), (5, -3, 60), (9, 9, 60), (5, 5, 60)}
    cut = compact_windows.without_repeats(docs, passages)
    assert cut.columns == docs.columns
    left = sorted((r.doc_id, len(r.text.split())) for r in cut.collect())
    assert left == sorted(
        [(5, 110), (5, 263), (5, 9), (5, 9), (5, 9), (7, 40), (8, 40), (-3, 83), (10, 80)]
        + ([(9, 0), (9, 65)] if (9, 0) in left else [(9, 5), (9, 60)])
    )


def test_near_passages_are_found(documents):
    """Against brute force: of later documents that hold a near passage at all, how many get one."""
    rng = random.Random(12)
    rows, families = [], []
    for _ in range(90):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(100)]
        members = []
        for turn in range(rng.choice([2, 2, 3, 5])):
            words = list(passage)
            for _ in range(turn and rng.choice([1, 2, 3])):
                words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:  # half of it stands in another document too
                half = words[:45]
                rows.append((len(rows), " ".join(half + [f"h{rng.randrange(10**6)}" for _ in range(30)])))
            before, after = ([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] for _ in "ab")
            members.append(len(rows))
            rows.append((len(rows), " ".join(before + words + after)))
        families.append(members)
    shingles = {}
    for i, text in rows:
        words = text.split()
        shingles[i] = np.array([hash(tuple(words[k : k + 5])) for k in range(len(words) - 4)], np.int64)
    holds = {
        later
        for members in families
        for k, later in enumerate(members)
        if any(
            compact_windows.align(shingles[later].view(np.uint64), shingles[x].view(np.uint64), 46)
            for x in members[:k]
        )
    }
    found = {r.doc_id for r in compact_windows.repeated_passages(documents(rows)).collect()}
    assert len(holds) > 100
    missed = len(holds - found)
    assert missed <= 0.1 * len(holds), (missed, len(holds))
    print("near passages missed:", missed, "of", len(holds))


def test_batches_of_windows_are_bounded():
    texts = [" ".join(f"w{k}_{i}" for i in range(2_000)) for k in range(60)] * 2
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    out = list(compact_windows._make(iter([batch])))
    rows = [r for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= 1 << 14 < len(rows)
    # Each copy's windows are given as pairs with the first one's.
    assert {r["a"] for r in rows if r["b"] is None} == set(range(60))
    assert {r["a"] for r in rows if r["b"] is not None} == set(range(60, 120))


def test_stretch_hashes():
    values = np.random.default_rng(1).integers(0, 2, 200).astype(np.uint64)
    one, two = compact_windows.stretch_hashes(values, 6)
    found = {}
    for p in range(195):
        found.setdefault((one[p], two[p]), set()).add(tuple(values[p : p + 6]))
    assert all(len(v) == 1 for v in found.values())
    assert len(found) == len({tuple(values[p : p + 6]) for p in range(195)})


def test_cut_keeps_the_rest():
    assert compact_windows._cut_words("é b  c\nd e", [(1, 3)]) == "é \nd e"
    assert compact_windows._cut_words("a b c d", [(0, 2), (1, 3)]) == " d"


def test_word_hashes_over_chunks(monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    texts = ["the cat " * 50, "THE\ncat", None, "x" * 500]
    seen = []
    for _, _, data, at in words.chunks(pa.array(texts)):
        starts, ends, _ = words.word_spans(data, at)
        seen += words.word_hashes(data, starts, ends).tolist()
    assert len(seen) == 103 and len(set(seen)) == 3


@pytest.mark.parametrize("bits", [1 << 16, 1 << 24])
def test_sifted_rows_hold_all_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(work, "SIEVE_BITS", bits)
    own = [(k % 3_000, f"t{k}", k) for k in range(6_000)] + [(None, "t1", 7), (5, None, 8), (None, None, 9)]
    rows = spark.createDataFrame(own, "id int, place string, bits int")
    ids = spark.createDataFrame([(k,) for k in range(0, 9_000, 10)] + [(None,)], "id bigint")
    some, rest = (sorted(map(tuple, f.collect()), key=str) for f in work.sifted(rows, ids))
    assert sorted(some + rest, key=str) == sorted(own, key=str)
    assert all(r[0] is not None and r[0] % 10 for r in rest) and len(rest) > 5_000
    both = spark.createDataFrame([(4, "t4"), (5, "t4"), (1, "t3001")], "id bigint, place string")
    some, rest = (f.collect() for f in work.sifted(rows, both))
    assert {(4, "t4", 4), (1, "t3001", 3001)} <= {*map(tuple, some)} and len(some) + len(rest) == len(own)
    none, rest = work.sifted(rows, ids.limit(0))
    assert none.count() == 0 and rest.count() == len(own)


def exchanged_texts(df):
    """Rows with a text that go through exchanges of the executed plan."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind == "ShuffleQueryStageExec":
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and "text#" in node.output().toString():
                found += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_texts_without_a_partner_stay_where_they_are(spark, documents):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(80))) for k in range(200)]
    rows += [(200, rows[3][1] + " more"), (201, f"{rows[4][1]} {rows[5][1]}"), (7, rows[7][1]), (None, "x")]
    docs = documents(rows).selectExpr("*", "'en' lang", "0L n_chars")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        ids = [r["doc_id"] for r in kept.collect()]
        cut = corpus_pipeline.cut_repeated_passages(spark, docs.where("doc_id <> 7"), "")
        texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(ids, key=str) == sorted([*range(200), 201, None], key=str)
    assert texts[201].strip() == "" and texts[200].strip() == "more" and len(texts) == 201
    assert all(texts[k] == t for k, t in rows[:200] if k != 7)
    # Beside a copy, the copies of one row, and what repeats: a few that share a bit at most.
    assert exchanged_texts(kept) <= 10 and exchanged_texts(cut) <= 6
