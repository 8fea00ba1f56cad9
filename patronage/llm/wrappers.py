"""Main text of web pages by wrapper induction.

The trees of all pages of a host are aligned by simple tree matching into one wrapper: of the pages
of a task first, then of groups of such wrappers. Every page of the host is then aligned with it, and
each place of the wrapper is counted over all distinct pages: a place that most of them have, always with the same text, is template, a place that varies,
or repeats within a page, is content. Of the content, the article's part is the page's text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm import dom
from patronage.llm.work import lean, written

# So many wrappers of a host's pages are joined at a time.
JOINED = 32
# A task holds wrappers of so many hosts and nodes at a time.
HOSTS, NODES = 4_096, 1 << 18
# A place is template if its text is the same on all of at least so many distinct pages.
CONSTANT_PAGES = 3

# Wrappers and places are sent to all tasks up to these sizes, which are measured first; beyond,
# pages are shuffled by host.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 1 << 18

BLOCKS = "array<struct<slot:int,text:string>>"


def host(url: str = "url") -> F.Column:
    """The host of a URL, lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


PARTS = "host string, part bigint, wrapper string"


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of the task's pages of each host; `part` tells wrappers of a host apart."""
    held: dict[str, list] = {}  # host: first page's hash, wrapper, pages since it was pruned, nodes
    nodes = 0

    def flush() -> pa.RecordBatch:
        found = [(h, p, json.dumps(dom.pruned(w).to_list())) for h, (p, w, *_) in held.items()]
        held.clear()
        kinds = (pa.string(), pa.int64(), pa.string())
        columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["host", "part", "wrapper"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("host", "_own", "copies", "html"))
        for name, own, copies, page in zip(*columns):
            tree = dom.pattern_of([dom.parse(page or "")], 1 / (copies or 1))
            if name not in held:
                held[name] = [own or 0, tree, 0, 0]
            else:
                held[name][1] = dom.joined(held[name][1], tree)
            state = held[name]
            state[2] += 1
            if state[2] == JOINED:
                state[1], state[2] = dom.pruned(state[1]), 0
            if not state[2] or not state[3]:
                nodes -= state[3]
                state[3] = dom.nodes_of(state[1])
                nodes += state[3]
            if len(held) >= HOSTS or nodes >= NODES:
                yield flush()
                nodes = 0
    if held:
        yield flush()


def _join(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values(["part", "wrapper"])
    wrapper, *rest = (dom.Pattern.of(json.loads(w)) for w in parts["wrapper"])
    for other in rest:
        wrapper = dom.pruned(dom.joined(wrapper, other))
    one = {c: parts[c].iloc[:1].to_list() for c in ("host", "part")}
    return pd.DataFrame(one | {"wrapper": [json.dumps(wrapper.to_list())]})


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def wrappers(pages: DataFrame) -> DataFrame:
    """`host`, `wrapper` of pages with `host`, `html`; copies of a page weigh as much as one."""
    keyed = pages.select("host", F.xxhash64("html").alias("_own"), "html")
    copied = keyed.groupBy("host", "_own").agg(F.count("*").alias("copies")).where("copies > 1")
    copied = _sent(written(copied, "copied-pages"))
    weighed = keyed.join(copied, ["host", "_own"], "left")
    parts = written(weighed.mapInArrow(lean(_induce), PARTS), "wrapper-parts")
    while True:
        sizes = written(parts.groupBy("host").agg(F.count("*").alias("n")), "wrapper-sizes")
        most = sizes.agg(F.max("n")).first()[0] or 0
        # Wrappers of a host are joined in groups, so that no group holds more than a few.
        groups = F.ceil(F.col("n") / JOINED) if most > JOINED else F.lit(1)
        dealt = parts.join(sizes, "host").withColumn("group", F.pmod(F.xxhash64("part", "wrapper"), groups))
        parts = dealt.select("host", "part", "wrapper", "group").groupBy("host", "group")
        parts = parts.applyInPandas(_join, PARTS)
        if most <= JOINED:
            return parts.select("host", "wrapper")
        parts = written(parts, "wrapper-parts")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[dom.Pattern, dict[int, int]]] = {}
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        out = []
        for page, wrapper in zip(
            batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()
        ):
            if wrapper not in known:
                if len(known) > 1_000:
                    known.clear()
                pattern = dom.Pattern.of(json.loads(wrapper))
                known[wrapper] = pattern, dom.numbered(pattern)
            pattern, numbers = known[wrapper]
            root = dom.parse(page or "")
            inside: set[int] = set()
            todo = [main := dom.content(root)]
            named = main.tag in ("article", "main")
            while todo:
                node = todo.pop()
                inside.add(id(node))
                todo += node.kids
            out.append(
                [
                    {"slot": slot, "text": node.text}
                    for slot, node in dom.slots(root, pattern, numbers)
                    if id(node) in inside and (named or 2 * node.linked <= len(node.text))
                ]
            )
        rest = [c for c in batch.schema.names if c not in ("html", "wrapper")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(out, kind)], names=[*rest, "blocks"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """The pages without `html`, with `text`: the article's blocks in page order, one a line.

    Every page is read whole. A null or empty page has the empty text; pages without a host are
    taken as of one host. White space in a block is one space. Copies of a page count as one, so
    where all pages of a host are the same, nothing counts as template. Columns called `host`, `wrapper`, `blocks` or `text` are
    replaced, and rows that repeat are given back as often.
    """
    own = pages.drop("host", "wrapper", "blocks", "text").withColumn("host", host())
    learned = written(wrappers(own), "wrappers")
    size = learned.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    joined = own.join(F.broadcast(learned) if size <= BROADCAST_BYTES else learned, "host")
    rest = [f for f in joined.schema.fields if f.name not in ("html", "wrapper")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    aligned = written(joined.mapInArrow(lean(_align), f"{schema}, blocks {BLOCKS}"), "aligned")

    hashed = F.xxhash64(F.transform("blocks", lambda b: b["text"]))
    single = F.transform(
        F.filter("blocks", lambda b: b["slot"] >= 0),
        lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("t")),
    )
    pages_of = aligned.select("host", hashed.alias("page"), single.alias("places"))
    pages_of = pages_of.groupBy("host", "page").agg(F.min("places").alias("places"))
    pages_of = written(pages_of, "distinct-pages")
    sizes = pages_of.groupBy("host").agg(F.count("*").alias("pages"))
    texts = pages_of.select("host", F.inline("places"))
    constant = (
        texts.groupBy("host", "slot")
        .agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
        .where(f"low = high AND n >= {CONSTANT_PAGES}")
        .join(sizes, "host")
        .where("2 * n > pages")
        .groupBy("host")
        .agg(F.collect_set("slot").alias("template"))  # places of one wrapper
    )
    kept = F.filter(
        "blocks", lambda b: ~F.coalesce(F.array_contains("template", b["slot"]), F.lit(False))
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    constant = _sent(written(constant, "template"))
    return aligned.join(constant, "host", "left").select(
        *(f.name for f in rest if f.name != "host"), text.alias("text")
    )
