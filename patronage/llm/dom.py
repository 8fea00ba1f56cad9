"""A small lenient DOM of blocks, and simple tree matching of two of them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from operator import add

import numpy as np

# Elements without an end, with raw content, inside a line, and never content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script style noscript template textarea title iframe svg canvas object"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav aside footer form button select menu dialog fieldset".split())
# What an element of these names or classes holds is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget footer comment comments "
    "reply replies respond disqus cookie cookies consent notice notices alert popup modal "
    "newsletter subscribe share sharing social related recommended login signup search "
    "pagination pager toolbar masthead".split()
)
# A compound class counts if its parts are of these or those above, one of those above at least.
HOLDERS = frozenset(
    "area bar block box buttons container inner items links list posts section wrap wrapper".split()
)
HEADERS = frozenset("header topbar".split())
# Inside an article, what is called so is the article's own.
NOTES = frozenset("alert notice notices".split())
COMMENTS = frozenset("comment comments reply replies related teaser ad advert".split())
# Start tags that end an open element of the same family.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("ul ol dl table body html article section div main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[^\W\d_]+")
# Elements deeper than this count as part of the one around them.
_DEPTH = 150
# Of the table that aligns two lists of children, so many cells are held at a time. Of a longer one, the
# rows at which so many parts of it begin are held, and the parts are made again one by one.
_CELLS, _PARTS = 1 << 18, 16
# What is on fewer than one in so many pages of a wrapper is none of its places: by far too few for
# template, which is on most.
RARE = 16


@dataclass(slots=True)
class Node:
    """An element (`label` is its tag and classes) or, with the label `#`, a block's text."""

    tag: str
    label: str
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0  # characters of the text inside links
    bad: bool = False  # boilerplate by its name

    def size(self) -> int:
        """Characters that are not in links."""
        return len(self.text) - self.linked + sum(k.size() for k in self.kids)


def _names(rest: str) -> tuple[str, frozenset[str]]:
    if "=" not in rest:
        return "", frozenset()
    values = " ".join(v.strip("\"'").lower() for _, v in _NAMED.findall(rest))
    return values, frozenset(values.split())


def _any_of(names: frozenset[str], words: frozenset[str]) -> bool:
    """Whether a class is one of the words, or made up of them and of holders."""
    for name in names:
        parts = _PART.findall(name)
        if any(p in words for p in parts) and all(p in words or p in HOLDERS for p in parts):
            return True
    return False


def _pruned(root: Node) -> Node:
    """The tree without boilerplate elements.

    One that holds an `article` or `main`, or most of the page's unlinked text, stays: its name says
    something else then.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    sizes: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for node in reversed(order):
        sizes[id(node)] = len(node.text) - node.linked + sum(sizes[id(k)] for k in node.kids)
        named = node.tag in ("article", "main") and not node.bad
        holds[id(node)] = named or any(holds[id(k)] for k in node.kids)
    for node in order:
        node.kids = [
            k
            for k in node.kids
            if not k.bad or holds[id(k)] or 2 * sizes[id(k)] > sizes[id(root)]
        ]
    return root


def parse(page: str) -> Node:
    """The tree of a page's possible content; markup, scripts and boilerplate elements are gone.

    Ill-formed pages are read as well as may be: a new block ends an open paragraph, an end tag
    without a start counts for nothing, and what is open at the end is closed.
    """
    root = Node("html", "html")
    stack, links = [root], 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                stack[-1].kids.append(Node("#", "#", text=text, linked=min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        flush()
        del stack[k:]

    def start(tag: str, rest: str) -> None:
        flush()
        if len(stack) > _DEPTH:
            return
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        family = CLOSES.get(tag)
        if family:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in family:
                    close(k)
                    break
                if stack[k].tag in _SCOPES:
                    break
        values, names = _names(rest)
        inside = any(n.tag == "article" for n in stack)
        if tag in ("html", "body", "main"):
            bad = False
        elif tag == "article":
            bad = _any_of(names, COMMENTS)
        else:
            bad = tag in DROPPED or _any_of(names, BOILERPLATE - NOTES if inside else BOILERPLATE)
            bad = bad or (not inside and (tag == "header" or _any_of(names, HEADERS)))
        label = f"{tag} {values}".strip()
        if "main" in names and "role" in rest:
            tag = "main"
        if "articlebody" in names:
            tag = "article"
        node = Node(tag, label, bad=bad)
        stack[-1].kids.append(node)
        stack.append(node)

    done = 0
    for m in _TOKEN.finditer(page):
        if m.start() > done:
            parts.append(page[done : m.start()])
            if links:
                linked += m.start() - done
        done = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] or m["end2"] else 1
        elif tag in VOID:
            flush()
        elif m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or stack[k].label.split(" ")[0] == tag:
                    close(k)
                    break
        else:
            start(tag, m["rest"] or m["rest2"] or "")
    if done < len(page):
        parts.append(page[done:])
    flush()
    return _pruned(root)


def groups(kids: list[Node]) -> list[list[Node]]:
    """Neighbours of one label together."""
    out: list[list[Node]] = []
    for kid in kids:
        if out and out[-1][0].label == kid.label:
            out[-1].append(kid)
        else:
            out.append([kid])
    return out


@dataclass(slots=True)
class Pattern:
    """A wrapper's node: on how many pages it is at most, on how many with several in a row."""

    label: str
    pages: float
    several: float
    kids: list[Pattern] = field(default_factory=list)

    @property
    def many(self) -> bool:
        """Whether most pages that have it have several of them in a row."""
        return 2 * self.several > self.pages

    def to_list(self) -> list:
        return [self.label, self.pages, self.several, [k.to_list() for k in self.kids]]

    @staticmethod
    def of(data: list) -> Pattern:
        return Pattern(*data[:3], [Pattern.of(k) for k in data[3]])


def pattern_of(members: list[Node], weight: float = 1) -> Pattern:
    """The nodes of one page, which counts as `weight` pages."""
    out = Pattern(members[0].label, weight, weight if len(members) > 1 else 0)
    for node in members:
        below = [pattern_of(g, weight) for g in groups(node.kids)]
        out.kids = merged(out.kids, below, one_page=True)
    return out


def joined(a: Pattern, b: Pattern) -> Pattern:
    """The wrapper of the pages of both, of which nodes on too few are left out, see `pruned`."""
    kids = merged(a.kids, b.kids, lost_a=_lost(a), lost_b=_lost(b))
    return Pattern(a.label, a.pages + b.pages, max(a.several, b.several), kids)


def _lost(wrapper: Pattern) -> float:
    """On how many of the pages a node may be that the wrapper does not have."""
    return wrapper.pages / RARE if wrapper.several else 0


def pruned(wrapper: Pattern) -> Pattern:
    """The wrapper without nodes that are on less than one of `RARE` of its pages.

    Counts are upper bounds: a node that comes later is taken to have been left out before. So a node
    that is on more pages stays, whatever the order in which pages and wrappers are joined.
    """

    def kept(kids: list[Pattern]) -> list[Pattern]:
        some = [k for k in kids if RARE * k.pages >= wrapper.pages]
        return [Pattern(k.label, k.pages, k.several, kept(k.kids)) for k in some]

    # A root has no neighbours: its `several` tells that nodes may have been left out.
    return Pattern(wrapper.label, wrapper.pages, 1, kept(wrapper.kids))


def nodes_of(pattern: Pattern) -> int:
    return 1 + sum(map(nodes_of, pattern.kids))


def _raised(kids: list[Pattern], by: float) -> list[Pattern]:
    """The nodes with higher upper bounds."""
    if not by:
        return kids
    return [Pattern(k.label, k.pages + by, k.several, _raised(k.kids, by)) for k in kids]


def _weight(a: Pattern, b: Pattern) -> int:
    """Simple tree matching: how many nodes two trees share, order kept."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    if len(a.kids) * len(b.kids) > _CELLS:
        return 1 + _Long(a.kids, b.kids, _weight).total()
    return 1 + _table(a.kids, b.kids, _weight)[-1][-1]


def _table(a: list, b: list, weight) -> list[list[int]]:
    table = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], table[-1]
        for j, y in enumerate(b):
            row.append(max(above[j + 1], row[j], above[j] + weight(x, y)))
        table.append(row)
    return table


def matched(a: list, b: list, weight) -> list[tuple[int, int]]:
    """Places in both lists that simple tree matching puts together."""
    if len(a) * len(b) > _CELLS:
        return _Long(a, b, weight).matched()
    table, i, j, out = _table(a, b, weight), len(a), len(b), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _alike(a: Node | Pattern, b: Node | Pattern) -> int:
    return int(a.label == b.label)


def _tree(node: Node | Pattern, known: dict) -> int:
    """One number for all trees of the same labels."""
    return known.setdefault((node.label, *(_tree(k, known) for k in node.kids)), len(known))


class _Long:
    """The table of two lists too long to hold it: rows are made from the one above as they are needed.

    What is matched is the same as by `_table`. Only places of one label have a weight, and trees of
    the same labels have the same, so a row takes one weight for each such kind of tree.
    """

    def __init__(self, a: list, b: list, weight) -> None:
        self.a, self.b, self.weight = a, b, weight
        known: dict = {}
        self.kinds = [_tree(x, known) if weight is _weight else x.label for x in a]
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y.label, []).append(j)
        # By label: its places in `b`, one place of each kind there, and which of these each is like.
        self.at = {}
        for label, js in places.items():
            kinds = [_tree(b[j], known) if weight is _weight else label for j in js]
            first = dict(zip(reversed(kinds), reversed(js)))
            nth = {kind: n for n, kind in enumerate(first)}
            like = np.array([nth[kind] for kind in kinds])
            self.at[label] = np.array(js), [*first.values()], like
        self.weights: dict[int | str, np.ndarray] = {}
        self.held = 0

    def _row(self, i: int, above: np.ndarray) -> np.ndarray:
        """The row behind the i-th of `a`, as far as the one above it is given."""
        if self.a[i].label not in self.at:
            return above
        js, trees, like = self.at[self.a[i].label]
        weights = self.weights.get(self.kinds[i])
        if weights is None:
            weights = np.array([self.weight(self.a[i], self.b[j]) for j in trees], np.int64)
            if self.held + len(weights) > _CELLS:
                self.weights.clear()
                self.held = 0
            self.weights[self.kinds[i]] = weights
            self.held += len(weights)
        some = int(np.searchsorted(js, len(above) - 1))
        js, like = js[:some], like[:some]
        row = above.copy()
        row[js + 1] = np.maximum(row[js + 1], above[js] + weights[like])
        return np.maximum.accumulate(row)

    def total(self) -> int:
        row = np.zeros(len(self.b) + 1, np.int64)
        for i in range(len(self.a)):
            row = self._row(i, row)
        return int(row[-1])

    def matched(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        self._back(0, len(self.a), np.zeros(len(self.b) + 1, np.int64), len(self.b), out)
        return out[::-1]

    def _back(self, low: int, high: int, above: np.ndarray, j: int, out: list) -> int:
        """Matches from row `high` and column j back to row `low`, which is given; the column there."""
        rows, whole = [above[: j + 1]], (high - low) * (j + 1) <= _CELLS
        step = 1 if whole else -(-(high - low) // _PARTS)
        row, starts = rows[0], range(low, high, step)
        for i in range(low, high if step == 1 else starts[-1]):
            row = self._row(i, row)
            if step == 1 or i + 1 in starts:
                rows.append(row)
        if step > 1:
            for start, row in zip(reversed(starts), reversed(rows)):
                j = self._back(start, min(start + step, high), row, j, out)
            return j
        i = high - low
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((low + i, j))
        return j


def merged(
    a: list[Pattern],
    b: list[Pattern],
    lost_a: float = 0,
    lost_b: float = 0,
    one_page: bool = False,
) -> list[Pattern]:
    """Both lists aligned: what matches is one node, the rest is kept in place."""
    out, i, j = [], 0, 0
    for x, y in [*matched(a, b, _weight), (len(a), len(b))]:
        out += _raised(a[i:x], lost_b) + _raised(b[j:y], lost_a)
        if x < len(a):
            p, q, both = a[x], b[y], max if one_page else add
            kids = merged(p.kids, q.kids, lost_a, lost_b, one_page)
            pages, several = both(p.pages, q.pages), both(p.several, q.several)
            out.append(Pattern(p.label, pages, several, kids))
        i, j = x + 1, y + 1
    return out


def slots(node: Node, pattern: Pattern | None, numbers: dict[int, int]) -> list[tuple[int, Node]]:
    """The texts under a node in page order, each with the number of its place in the wrapper.

    -1 where the wrapper has no such place, or has it several times over.
    """
    found: list[tuple[int, Node]] = []
    own = groups(node.kids)
    below = pattern.kids if pattern else []
    at = {}
    if below:
        at = dict(matched([g[0] for g in own], below, _alike))
    for k, members in enumerate(own):
        to = below[at[k]] if k in at else None
        if to is not None and (to.many or len(members) > 1):
            to = None
        for kid in members:
            if kid.tag == "#":
                found.append((numbers[id(to)] if to is not None else -1, kid))
            else:
                found += slots(kid, to, numbers)
    return found


def numbered(pattern: Pattern) -> dict[int, int]:
    """A number for each node of a wrapper, in order."""
    out, todo = {}, [pattern]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo += reversed(node.kids)
    return out


def content(root: Node) -> Node:
    """The node of the article: the largest `article`, else `main`, else all that is no boilerplate."""
    named: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in named:
            named[node.tag].append(node)
        todo += node.kids
    for tag in ("article", "main"):
        found = [n for n in named[tag] if n.size()]
        if found:
            return max(found, key=Node.size)
    return root
