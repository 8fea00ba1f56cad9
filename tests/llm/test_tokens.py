"""Token files, tree BPE and cached words against the library's own encoding of whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from patronage.llm import pieces, registry, token_files, tree_bpe

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = [
    None,
    "",
    " ",
    "\n",
    "a  b",
    "a \n b",
    "  lead and trail  ",
    "tab\tand nbsp  em",
    "it's they'll 'tis x's",
    "<|endoftext|> in<|endoftext|>side <|startoftext|>",
    "Élève ΣΑΣ İstanbul ﬁ é ñ",
    "x1y2 99,5% a_b --- !!!\nnext\n\nafter",
    "word\u001fsep",
    "日本語のテキスト 🙂🙂 ok",
    "a\n\u00a0",
    "word\n\u00a0\nword",
]


def fuzz(n, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "the ", "Éé", "'s", "12", "!,", "́", "<|endoftext|>", "\n", " ", "日"]
    alphabet += ["\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\u2028", "\x1c", "\t"]
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("ids_of, path", [(pieces.byte_level_ids, BYTES), (pieces.spaced_ids, WORDS)])
def test_words_are_exact(ids_of, path):
    library = Tokenizer.from_file(path)
    texts = HOSTILE + fuzz(300, 1)
    ids, at = ids_of(path, pa.array(texts))
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want, repr(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    texts = pa.array([f"w{k} v{k} u{k}" for k in range(50)])
    ids, at = pieces.byte_level_ids(BYTES, texts)
    library = Tokenizer.from_file(BYTES)
    assert [len(library.encode(t.as_py()).ids) for t in texts] == np.diff(at).tolist()
    assert len(pieces._tails(BYTES).known) <= 200


@pytest.mark.parametrize("seed", range(4))
def test_joins_are_exact(seed):
    library, rng = Tokenizer.from_file(WORDS), random.Random(seed)
    for text in fuzz(150, seed) + ["ab" * 500, "é!" * 300, "7" * 200]:
        text = text.replace(" ", "").replace("\n", "")
        runs = []
        for joined, part in tree_bpe.leaves(WORDS, text, rng.randint(3, 30)):
            if not joined:
                runs.append([])
            runs[-1].append(tree_bpe.encode_side(WORDS, part))
        got = [i for run in runs for i in tree_bpe.join_all(WORDS, run).ids.tolist()]
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_tree_bpe_of_documents(documents):
    rng = random.Random(3)
    long = ["".join(rng.choices("abcdé1!", k=900)), "kurz " + "x" * 700 + " end " + "yz" * 400]
    rows = [(k, t) for k, t in enumerate(HOSTILE + long)] + [(3, "again"), (3, "again"), (None, "n")]
    docs = documents(rows, extra=True)
    out = tree_bpe.decode(tree_bpe.encode(docs, WORDS, leaf=64), WORDS)
    library = Tokenizer.from_file(WORDS)
    want = sorted(
        (str(i), (e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False))
        for i, t in rows
    )
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in out.collect())
    assert got == want
    assert tree_bpe.encode(docs.limit(0), WORDS).count() == 0


def test_tree_bpe_behind_a_repartition(documents):
    rng = random.Random(4)
    rows = [(k, f"doc {k} " + "".join(rng.choices("abc1!", k=300 + k))) for k in range(60)]
    library = Tokenizer.from_file(WORDS)
    docs = documents(rows).selectExpr("*", "doc_id AS _row").repartition(16)
    out = tree_bpe.encode(docs, WORDS, leaf=64).collect()
    got = {r["doc_id"]: (r["_row"], list(r["ids"])) for r in out}
    assert got == {i: (i, library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_token_files_round_trip(spark, documents, tmp_path):
    rows = [(k * 7 % 40, t) for k, t in enumerate(HOSTILE + ["very long " * 5_000])]
    rows += [(3, "again"), (3, "again"), (None, "no id")]
    path = str(tmp_path / "store")
    token_files.write_tokens(documents(rows, extra=True), path, BYTES, block_bytes=200)
    library = Tokenizer.from_file(BYTES)
    ids = {i: [] for i, _ in rows}
    for i, t in rows:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    got = token_files.read_tokens(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start and list(r["ids"]) in ids[r["doc_id"]]
        ids[r["doc_id"]].remove(list(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert not any(ids.values())
    some = token_files.read_tokens(spark, path, [7, 14]).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 14]
    assert spark.read.parquet(f"{path}/blocks").count() > 3


def test_empty_store(spark, documents, tmp_path):
    path = str(tmp_path / "store")
    token_files.write_tokens(documents([]), path, BYTES)
    assert token_files.read_tokens(spark, path).count() == 0


def test_registered_queries(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library, start = Tokenizer.from_file(BYTES), 0
    found = {r["doc_id"]: r for r in registry.op1_token_files(spark, small).collect()}
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(found[i])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    library = Tokenizer.from_file(WORDS)
    for r in registry.op6_tree_bpe(spark, small).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want = (len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests))
        assert tuple(r)[1:] == want
