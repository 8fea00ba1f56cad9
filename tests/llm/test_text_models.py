"""Classifiers by held-out rows, main text and decontamination by brute force, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from patronage.llm import decontaminate, dom, ngrams, quality, registry, toxicity, wrappers

KEYS = [f"op{n}_" for n in range(1, 14)]


def test_one_query_for_each_operator():
    found = registry.queries()
    assert all(sum(k.startswith(p) for k in found) == 1 for p in KEYS) and len(found) == 13
    assert set(queries()) >= {*found, "pipeline"} and set(registry.oracle_sql()) <= set(found)


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_sql(spark, small, key):
    assert difference(queries()[key](spark, small), connect(small), oracle_sql()[key]) is None


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(n)]


def labelled(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        text = words(rng, rng.randint(5, 60))
        insult, contempt = rng.random() < 0.15, rng.random() < 0.15
        for flag, word in ((insult, "idiot"), (contempt, "worthless")):
            if flag:
                text.insert(rng.randint(0, len(text)), word)
        rows.append((k, " ".join(text), int(insult), int(contempt), int(insult or contempt)))
    return rows


def test_classifier_chain(spark):
    kinds = "doc_id bigint, text string, insult int, contempt int, toxic int"
    rows = labelled(400, 1) + [(900, None, 0, 0, 0), (901, "", 0, 0, 0), (902, "x", None, 0, 1)]
    chain = toxicity.fit(spark.createDataFrame(rows, kinds), toxicity.CATEGORIES)
    assert (np.triu(chain.earlier) == 0).all() and chain.earlier[2, :2].any()
    held = labelled(300, 2) + [(1_000, None, 0, 0, 0), (1_001, "", 0, 0, 0)]
    docs = spark.createDataFrame(held, kinds).withColumnRenamed("insult", "p_insult")
    out = toxicity.score(docs, chain).collect()
    assert len(out) == len(held)
    right = [(r["p_toxic"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in out]
    assert np.mean(right) > 0.98


def test_out_of_fold_probabilities_are_used():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, (60, 2))
    rows, places = np.arange(60), np.arange(60)  # each row known by a feature of its own
    weights, earlier, _ = toxicity.train_chain(rows, places, labels, rows % 5, 60)
    # Out of fold, the first category can't be told, so the second learns little from it.
    assert np.abs(weights[0]).max() > 0.3 and abs(earlier[1, 0]) < 2


@pytest.mark.parametrize("rows", [[], [(1, "a b c", 1)], [(k, "same text", 0) for k in range(9)]])
def test_models_of_too_little(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    scores = [r["score"] for r in quality.score(frame, quality.fit(frame)).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == len(rows)
    chain = toxicity.fit(frame.withColumnRenamed("quality", "toxic"), ["toxic"])
    assert toxicity.score(frame, chain).count() == len(rows)


def test_quality_on_held_out_rows(spark):
    rng, rows = random.Random(3), []
    for k in range(500):
        good, text = rng.random() < 0.8, words(rng, rng.randint(20, 120))
        if not good:
            at = rng.randint(0, len(text) - 10)
            text[at : at + 10] = [w.upper() + "!!" for w in text[at : at + 10]]
        rows.append((k, " ".join(text), int(good)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(frame.where("doc_id < 350"))
    out = quality.score(frame.where("doc_id >= 350").drop("n"), model).collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in out]) > 0.98
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert len({r["score"] for r in quality.score(empty, model).collect()}) == 1


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 20, 6)) for _ in range(80)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    ratios = np.where(np.arange(20) == 3, 2.0, rng.normal(0, 0.3, 20))
    w, b = quality.descend(ratios, rows, y, 10.0, 200)
    for r, side in zip(rows, y):
        x = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
        assert side * (w[r] @ x + b) > 0


def test_indicators():
    texts = pa.array(["Idiot idiot idiotic", None, ""])
    ((low, high, rows, values),) = ngrams.indicators(texts, ngrams.words_and_stems, None)
    assert (low, high) == (0, 3) and set(rows.tolist()) == {0}
    assert len(values) == 2 + 2 * 1 + 0 == len(set(values.tolist()))  # two words, two stems


# pages

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>"
    "<header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div class=ad>Buy {n}</div>{main}"
    "<div id='comments'><article class=comment><p>First!</p></article></div>"
    "<form><input><p>Subscribe</p></form><aside>More</aside><footer>&copy; x {n}</footer>"
    "<script>var t='</p>';</script></body></html>"
)


def text_of(page):
    out, todo = [], [dom.content(dom.parse(page))]
    while todo:
        node = todo.pop()
        out += [node.text] if node.tag == "#" else []
        todo += reversed(node.kids)
    return "\n".join(out)


def test_main_text_of_a_page():
    main = "<article><h1>A  &amp; B</h1><p><b>one<br>two\n three<p>four <i>five</i></article>"
    assert text_of(PAGE.format(n=1, main=main)) == "A & B\none two three\nfour five"
    for page in ("", "   ", "<", "<p", "a < b", "<p class='x", "</p></div>", "<!-- open"):
        text_of(page)
    assert text_of("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert text_of("<p>no body<p>two") == "no body\ntwo"
    long = "<article>" + "".join(f"<h2>h{k}</h2><p>p{k}</p>" for k in range(1_500)) + "</article>"
    assert text_of(long).count("\n") == 2_999


def test_names_do_not_drop_the_article():
    body = "<article><h1>T</h1><p>One two three.</p></article>"
    for page in (
        f"<div class='layout has-sidebar'>{body}<div class=sidebar>x</div></div>",
        f"<div id='main' class='no-comments'>{body}</div>",
        f"<div class='content menu-open'>{body}</div><div class=menu>Much text of a menu, more</div>",
        f"<form action=x>{body}<button>Go</button></form><footer>end</footer>",
        f"<div class=banner><div class=widget>{body}</div></div>",
    ):
        assert text_of(page) == "T\nOne two three."
    plain = "<form><div class=sidebar><h1>T</h1><p>Most of the text.</p></div></form><nav>n</nav>"
    assert text_of(plain) == "T\nMost of the text."
    inner = "<article><p>A</p><div class='alert'>B</div><p class='share-price'>C</p></article>"
    assert text_of(inner) == "A\nB\nC"
    dropped = "<article><p>A</p><div class='share-buttons'>B</div><div class=ad>C</div></article>"
    assert text_of(dropped) == "A"


def test_pages_without_an_article_keep_all_blocks():
    body = "".join(f"<p>{k} of a body that is long</p>" for k in range(20))
    page = f"<div id=content><h1>T</h1><p>intro</p><div class=body>{body}</div></div>"
    assert text_of(page).split("\n")[:3] == ["T", "intro", "0 of a body that is long"]
    two = f"<div><section>{body}</section><section><p>second</p></section></div>"
    assert text_of(two).endswith("\nsecond")


def test_wrappers_find_templates(spark):
    # Without an article element: what all pages of a host have is template.
    def page(k):
        same = "<div class=box><p>Welcome to our pages, dear reader, do stay a while.</p></div>"
        body = f"<div class=text><h2>Title {k}</h2><p>Text {k} of some length here.</p><p>End {k}.</p></div>"
        return f"<html><body><div class=wrap>{same}{body}</div></body></html>"

    rows = [(k, f"http://A.example/{k}", page(k)) for k in range(20)]
    rows += [(100 + k, f"https://b.example:80/{k}", page(7)) for k in range(5)]  # one page, copied
    rows += [(200, None, None), (201, "x", ""), (202, "nohost", "<p>alone</p>"), (200, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = wrappers.main_text(pages.withColumn("text", pages.url)).collect()
    got = {}
    for r in out:
        got.setdefault(r["page_id"], []).append(r["text"])
    assert [got[k] for k in range(20)] == [
        [f"Title {k}\nText {k} of some length here.\nEnd {k}."] for k in range(20)
    ]
    assert got[100] == got[104] and "Title 7" in got[100][0]
    assert got[200] == ["", ""] and got[201] == [""] and got[202] == ["alone"]
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    def page(k, more=""):
        return f"<div class=wrap><h1>Title {k}</h1><p>All the text of page {k}.</p>{more}</div>"

    rows = [(k, f"http://a.example/{k}", page(1)) for k in range(5)] + [(9, "http://a.example/9", "")]
    # A place that only the copies and near copies of one page have, on a host of many others.
    quote = "<blockquote>Said once</blockquote>"
    rows += [(100 + k, "http://b.example/", page(k)) for k in range(30)]
    rows += [(200 + k, "http://b.example/", page(k, quote)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert all(got[k] == "Title 1\nAll the text of page 1." for k in range(5)) and got[9] == ""
    assert got[103] == "Title 3\nAll the text of page 3."
    assert got[203] == "Title 3\nAll the text of page 3.\nSaid once"


def test_a_wrapper_has_the_places_of_all_pages(spark):
    # The eight pages of the least hashes lack a place that most of the host's pages have.
    def page(k, more):
        return f"<div class=wrap>{more}<h1>Title {k}</h1><p>All the text of page {k}.</p></div>"

    note = "<div class=hint>Read it on paper</div>"
    rows = [(k, "http://a.example/", page(k, note if k >= 100 else "")) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    ranked = pages.selectExpr("page_id", "xxhash64(html) AS h").orderBy("h").collect()
    plain = [r["page_id"] for r in ranked if r["page_id"] < 100]
    least = {r["page_id"]: n for n, r in enumerate(ranked)}
    late = [k for k in range(100, 400) if least[k] > least[plain[7]]]
    assert len(late) > 150
    some = pages.where(f"page_id < 100 OR page_id IN ({','.join(map(str, late))})")
    for found in (some, some.repartition(7, "page_id")):
        got = {r["page_id"]: r["text"] for r in wrappers.main_text(found).collect()}
        assert all(got[k] == f"Title {k}\nAll the text of page {k}." for k in (*plain, *late))


@pytest.mark.parametrize("order", [1, -1])
def test_wrappers_stay_small_and_keep_common_places(monkeypatch, order):
    pages = [f"<div class=n{k}>A</div><div class=m{k}>B</div>" for k in range(600)]
    pages += [f"<div class=seldom>{k}</div>" for k in range(30)]
    pages += [f"<div class=common>{k}</div>" for k in range(700)]
    parts = []
    for k, page in enumerate(pages[::order]):
        one = dom.pattern_of([dom.parse(page)])
        if k % 450:
            parts[-1] = dom.joined(parts[-1], one)
            parts[-1] = dom.pruned(parts[-1]) if k % 10 == 0 else parts[-1]
        else:
            parts.append(one)
    whole = parts[0]
    for other in parts[1:]:
        whole = dom.pruned(dom.joined(whole, other))
    assert whole.pages == len(pages) and dom.nodes_of(whole) < 300
    (common,) = [k for k in whole.kids if k.label == "div common"]
    assert 700 <= common.pages <= 700 + len(pages) / dom.RARE and not common.many


def test_long_lists_are_aligned_as_short_ones(monkeypatch):
    rng = random.Random(14)

    def some(deep):
        many = rng.randint(0, 3 if deep < 3 else 40)
        return [dom.Pattern(rng.choice("abc"), 1, 0, some(deep - 1) if deep else []) for _ in range(many)]

    pairs = [(some(3), some(3)) for _ in range(60)]
    weights = (dom._weight, lambda x, y: int(x.label == y.label))
    want = [dom.matched(a, b, w) for a, b in pairs for w in weights]
    for cells in (1, 50):
        monkeypatch.setattr(dom, "_CELLS", cells)
        assert [dom.matched(a, b, w) for a, b in pairs for w in weights] == want


def test_a_place_that_moves_does_not_hide_the_rest_of_a_long_page():
    body = "".join(f"<h2 class=n{k}>A</h2><p>B</p>" for k in range(700))
    pages = [f"<div>x</div>{body}", f"{body}<div>x</div>"]
    first, last = (dom.pattern_of([dom.parse(page)]) for page in pages)
    assert sum(k.pages == 2 for k in dom.joined(first, last).kids) == 1_400
    found = dom.slots(dom.parse(pages[1]), first, dom.numbered(first))
    assert sum(slot >= 0 for slot, _ in found) == 1_400
    # As children of a child, whose weight decides.
    outer = [dom.pattern_of([dom.parse(f"<section>{page}</section>")]).kids for page in pages]
    assert dom._weight(outer[0][0], outer[1][0]) == 2_801


def test_given_pages(spark, small):
    for r in registry.op8_wrappers(spark, small).collect():
        assert r["n_chars"] == len(r["text"]) and "<" not in r["text"]


# benchmark passages


def brute(text, items, window=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w, hit, found = split.findall(lower(text)), set(), set()
    for item_id, item in items:
        own = split.findall(lower(item))
        size = min(window, len(own))
        if item_id is None or not size:
            continue
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("automaton_bytes, sent_bytes", [(1 << 20, 1 << 20), (300, 1 << 20), (60, 300)])
def test_passages(spark, documents, automaton_bytes, sent_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 2_000)
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randint(1, 30)))) for k in range(12)]
    items += [(50, "Été, WAS? 42"), (51, ""), (52, None), (None, "alpha beta"), (3, "gamma gamma")]
    items += [(60, "the the the the the the the the the the the")]
    rows = []
    for k in range(60):
        text = words(rng, rng.randint(0, 40))
        item = rng.choice(items)[1] or ""
        at = rng.randint(0, len(text))
        mixed = item.upper().replace(" ", rng.choice([" ", ", ", "\n"]))
        rows.append((k, " ".join(text[:at]) + " " + mixed + " " + " ".join(text[at:])))
    rows += [(70, None), (71, ""), (72, "the " * 500), (70, "dup 42 été was 42"), (None, "Été was 42")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_passages(
        documents(rows, extra=True), bench, 10, automaton_bytes, sent_bytes
    )
    out = found.select("doc_id", "text", "n_words", decontaminate.n_hit().alias("n"), decontaminate.item_ids().alias("i"), "hits")
    got = sorted((str(r[0]), str(r[1]), r["n_words"], r["n"], r["i"]) for r in out.collect())
    assert got == sorted((str(i), str(t), *brute(t, items)) for i, t in rows)
    for r in out.collect():
        for h in r["hits"]:
            assert brute(r["text"][h["char_start"] : h["char_stop"]], items)[0] == h["stop"] - h["start"]
    assert decontaminate.find_passages(documents(rows), bench.limit(0)).where("size(hits) > 0").count() == 0


def test_a_large_benchmark_is_one_scan_of_the_documents(spark, documents):
    rng = random.Random(12)
    items = [(k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(12))) for k in range(3_000)]
    rows = [(k, f"intro {items[k * 7][1]} outro") for k in range(400)] + [(900, "nothing of it")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_passages(documents(rows), bench, automaton_bytes=20_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {r[0]: r[1] for r in found.select("doc_id", decontaminate.item_ids()).collect()}
    assert got == {k: [str(k * 7)] for k in range(400)} | {900: []}


# pipeline


def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(8)
    own = lambda n: [f"t{rng.randint(0, 10**6)}" for _ in range(n)]
    shared, leak = own(70), own(25)
    near = own(80)
    rows = {k: " ".join(own(60)) for k in range(60)}
    rows[20] = " ".join(near)
    rows[21] = " ".join(near[:40] + ["edit"] + near[41:])
    rows[30], rows[31] = (" ".join(own(30) + shared + own(30)) for _ in range(2))
    rows[40] = " ".join(own(20) + leak[5:20] + own(20))
    toxic = {k for k in range(0, 20, 2)}
    for k in toxic:
        rows[k] += " you idiot pathetic"
    table = [(k, t, "en", "s", len(t)) for k, t in rows.items()] + [(70, None, "en", "s", None)]
    spark.createDataFrame(
        table, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(k, 1, int(k in toxic)) for k in range(50)], "doc_id bigint, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everyone = {*rows, 70}
    assert set(seen["toxicity"]) == everyone - toxic
    assert set(seen["near_duplicates"]) == everyone - toxic - {21}
    cut = seen["substring_dedup"]
    assert set(cut) == everyone - toxic - {21}
    assert all(w in cut[30]["text"] and w not in cut[31]["text"] for w in shared)
    assert cut[31]["n_chars"] == len(cut[31]["text"]) and cut[33]["text"] == rows[33]
    assert set(seen["decontamination"]) == set(seen["bpe"]) == set(cut) - {40}
    assert seen["bpe"][70]["n_tokens"] == 0 and seen["bpe"][33]["n_tokens"] > 0
