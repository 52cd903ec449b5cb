"""Main text of web pages by wrapper induction over all pages of the same host.

Each page is parsed to a tree. One page of a host lends its tree of block elements as the seed of the wrapper, and every
page of the host is aligned with it by simple tree matching: roots of equal tags match, and of their children the
pairs, in order, that make the largest matching in all, where equal content counts again. Each page then has slots: the block
elements, and the runs of text and inline elements beside block elements. A slot's place in the wrapper is the
seed's node if it is matched there with equal content; else the place of what holds it, and its tag. Slots of equal
place and content are counted over all distinct pages of the host: those on more than ``SHARE`` of them are constant, the
host's template; all others vary and are content.

The content of a page is its body without the template and without what is marked as boilerplate
(menus, headers, footers, sidebars, notices, adverts, forms, comments) by its tag, role, class or id.
The article elements check it: if they hold half of that text or more, or if the page has no template,
they alone are the content, again without the template; there a slot must be on ``FIRM`` pages to be
template. Where all of an article is template, or all of the body, the template stays.

Class and id count as marks by whole names (``sidebar``, not ``no-sidebar``), within an article only if the host has an element
of that tag and name on two pages at least, so that it is the site's and not the author's; a host of one page is
taken at its word. A mark does not hide an article if the page has no other with fewer marks above it; a form that holds
most of a page's text is no mark; where all text of a page is marked, names and roles are not believed, then no mark. A main
element is one article, with all that stands in it.

Scale: a page is parsed and aligned once, to a table of its slots and texts. Of those, three narrow columns per slot are
counted; what comes back per host is the template. A seed is a list of tags, sent with each page of its host. Children lists of any length are
aligned in memory that is linear in them; subtrees of equal shape are compared once.

Null html and html without text give ''. A null or unreadable url has no host: such pages are not
aligned. Repeated rows and null page_ids are kept. Extra columns are ignored; an empty table gives
an empty one. Trees may be of any depth. Slots are told apart by 64-bit digests.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b as _blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, map_batches, named

#: A slot on more than this share of a host's distinct pages is template.
SHARE = 0.5
#: Within an article it is on so many pages at least: two may be copies of one text.
FIRM = 3
#: Pairs of children that are compared in one table; longer lists are halved until they fit.
CELLS = 1 << 20
#: Bytes of all seeds up to which they go to every executor whole.
SEEDS = 32 << 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
_BOILERPLATE = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
#: Never shown as text, whatever else a page lacks.
_NO_TEXT = frozenset("head iframe noscript object script select style svg template textarea title".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer menu modal nav navbar navigation newsletter notice popup promo related share sidebar social sponsored subscribe".split())
#: Opening one of these ends an open element of the given tags, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("html body article main section div table ul ol dl td th blockquote nav aside header footer form".split())


class Node:
    __slots__ = ("blocks", "children", "key", "marked", "name", "shape", "size", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.children, self.key, self.blocks, self.shape, self.size = tag, [], b"", [], "", 1
        self.name = ""
        if attrs and tag not in ("html", "body"):
            words = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
            self.name = " ".join(sorted(_MARKS.intersection(words)) + sorted(_ROLES.intersection([(attrs.get("role") or "").lower()])))
        self.marked = 2 if tag in _BOILERPLATE or "hidden" in attrs else int(bool(self.name))  # 1: by name or role only


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, tags, stop=frozenset()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE and tag not in _VOID:
            self._close({"p"}, _CONTAINERS)
        if tag in _ENDS:
            self._close(_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, {"article", "main", "body"} if tag in _INLINE or tag == "p" else frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _digest(*parts: bytes) -> bytes:
    return _blake2b(b"\0".join(parts), digest_size=8).digest()


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    # a key per subtree with text, children first: equal keys, equal content in every process
    order, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        node.key = _run_key(node.tag, node.children)
        node.blocks = [c for c in node.children if _is_block(c)]
        _shaped(node)
    return tree.root


def _run_key(tag: str, run: list) -> bytes:
    """Key of children in order; empty if they hold no text."""
    keys = [c.key if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "surrogatepass") for c in run]
    return _digest(tag.encode("utf-8", "surrogatepass"), *keys) if any(keys) else b""


@lru_cache(1 << 16)
def _below(path: bytes, tag: str) -> bytes:
    return _digest(path, tag.encode("utf-8", "surrogatepass"))


def _is_block(x) -> bool:
    return isinstance(x, Node) and x.tag not in _INLINE and x.tag != "wbr"


# --- simple tree matching -----------------------------------------------------------------------


def _shaped(node: Node) -> None:
    """Names the shape of the tree of block elements below a node, whose children have theirs, and its size."""
    node.shape = f"{node.tag}" if not node.blocks else _digest(node.tag.encode("utf-8", "surrogatepass"), *(c.shape.encode("utf-8", "surrogatepass") for c in node.blocks)).hex()
    node.size = 1 + sum(c.size for c in node.blocks)


def seed_of(root: Node) -> bytes:
    """A tree's block elements in order, as depth, tag and content."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.tag} {node.key.hex()}")
        todo += [(c, depth + 1) for c in reversed(node.blocks)]
    return "\n".join(out).encode("utf-8", "surrogatepass")


@lru_cache(64)
def seed_tree(seed: bytes) -> Node:
    """The tree of ``seed_of``; a node's ``name`` is its number."""
    nodes: list[Node] = []
    above: list[Node] = []
    for i, line in enumerate(seed.decode("utf-8", "surrogatepass").split("\n")):
        depth, tag, key = line.split(" ")
        node = Node(tag, {})
        node.key, node.name = bytes.fromhex(key), str(i)
        del above[int(depth) :]
        if above:
            above[-1].blocks.append(node)
        above.append(node)
        nodes.append(node)
    for node in reversed(nodes):
        _shaped(node)
    return nodes[0]


def _score(first: np.ndarray, row: Callable[[int], np.ndarray], rows: Iterable[int]) -> np.ndarray:
    """Best totals of an in-order matching, after these rows, for each prefix of the columns."""
    best = first
    for i in rows:
        best = np.concatenate(([0], np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row(i)))))
    return best


def in_order(row: Callable[[int], np.ndarray], m: int, n: int) -> list[tuple[int, int]]:
    """Pairs (row, column), both rising, of the largest total weight; ``row(i)`` has the weights of row i."""
    if not m or not n:
        return []
    if m * n > CELLS and m > 1:  # the columns are parted where the halves of the rows together do best
        half = m // 2
        front = _score(np.zeros(n + 1, np.int64), row, range(half))
        back = _score(np.zeros(n + 1, np.int64), lambda i: row(i)[::-1], range(m - 1, half - 1, -1))[::-1]
        split = int(np.argmax(front + back))
        low = in_order(lambda i: row(i)[:split], half, split)
        return low + [(i + half, j + split) for i, j in in_order(lambda i: row(i + half)[split:], m - half, n - split)]
    table = [np.zeros(n + 1, np.int64)]
    for i in range(m):
        table.append(_score(table[-1], row, [i]))
    pairs, i, j = [], m, n
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


class Matcher:
    """Matches a page's tree with a seed's; sizes of matchings are kept by shape."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], int] = {}

    def size(self, a: Node, b: Node) -> int:
        """Nodes in the largest matching of two trees by their shapes."""
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        todo = [(a, b)]
        while todo:  # without recursion, as trees may be deep: a pair waits for the pairs below it
            x, y = todo[-1]
            if (x.shape, y.shape) in self.known:
                todo.pop()
                continue
            shapes = {c.shape: c for c in x.blocks}, {c.shape: c for c in y.blocks}
            below = [(p, q) for p in shapes[0].values() for q in shapes[1].values() if p.tag == q.tag and p.shape != q.shape and (p.shape, q.shape) not in self.known]
            if below:
                todo += below
                continue
            todo.pop()
            row = self._rows(x.blocks, y.blocks, False)
            self.known[x.shape, y.shape] = 1 + int(_score(np.zeros(len(y.blocks) + 1, np.int64), row, range(len(x.blocks)))[-1])
        return self.known[a.shape, b.shape]

    def _weight(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        return a.size if a.shape == b.shape else self.known.get((a.shape, b.shape)) or self.size(a, b)

    def _rows(self, xs: list[Node], ys: list[Node], content: bool) -> Callable[[int], np.ndarray]:
        """Weights of the pairs of two lists: sizes of matchings, and again the size where content is equal."""
        kinds = {y.shape: (k, y) for k, y in enumerate({y.shape: y for y in ys}.values())}
        at = np.array([kinds[y.shape][0] for y in ys], np.int64)
        by_shape: dict[str, np.ndarray] = {}
        places: dict[bytes, list[int]] = {}
        if content:
            for j, y in enumerate(ys):
                if y.key:
                    places.setdefault(y.key, []).append(j)

        def row(i: int) -> np.ndarray:
            x = xs[i]
            if x.shape not in by_shape:
                by_shape[x.shape] = np.array([self._weight(x, y) for _, y in kinds.values()], np.int64)[at]
            out = by_shape[x.shape]
            equal = places.get(x.key) if x.key else None
            if equal:
                out = out.copy()
                out[equal] += x.size * (out[equal] > 0)
            return out

        return row

    def pairs(self, page: Node, seed: Node) -> dict[int, Node]:
        """id of a page's node -> the seed's node it is matched with."""
        out: dict[int, Node] = {}
        todo = [(page, seed)] if page.tag == seed.tag else []
        while todo:
            a, b = todo.pop()
            out[id(a)] = b
            xs, ys = a.blocks, b.blocks
            if not xs or not ys:
                continue
            same = lambda x, y: x.shape == y.shape and x.key == y.key
            low = 0  # equal ones at both ends are matched in some best matching
            while low < min(len(xs), len(ys)) and same(xs[low], ys[low]):
                low += 1
            high = 0
            while high < min(len(xs), len(ys)) - low and same(xs[-1 - high], ys[-1 - high]):
                high += 1
            todo += zip(xs[:low], ys[:low], strict=True)
            todo += zip(xs[len(xs) - high :], ys[len(ys) - high :], strict=True)
            xs, ys = xs[low : len(xs) - high], ys[low : len(ys) - high]
            if not xs or not ys:
                continue
            keys = {y.key for y in ys if y.key}
            if len({c.shape for c in (*xs, *ys)}) == 1 and not any(x.key in keys for x in xs):
                todo += zip(xs, ys, strict=False)  # all pairs weigh the same
            else:
                todo += [(xs[i], ys[j]) for i, j in in_order(self._rows(xs, ys, True), len(xs), len(ys))]
        return out


# --- slots and texts of a page ------------------------------------------------------------------


def _slots(root: Node, pairs: dict[int, Node]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Slots with text, in order: a number that is equal on slots of equal place and content, and what they
    cover, as (id of the parent, index). Of several equal ones on a page the first has the first number, the second the second."""
    seen: Counter = Counter()

    def number(place: bytes, key: bytes) -> int:
        nth = seen[place, key]
        seen[place, key] += 1
        return int.from_bytes(_digest(place, key, str(nth).encode()), "little", signed=True) & ~1

    todo = [(root, b"")]
    while todo:
        node, place = todo.pop()
        blocks = [i for i, c in enumerate(node.children) if _is_block(c)]
        if not blocks and node is not root:
            continue  # nothing but its own text: the slot is the element
        below, at = [], 0
        for i in (*blocks, len(node.children)):
            if key := _run_key("", node.children[at:i]):
                yield number(place, key), [(id(node), k) for k in range(at, i)]
            if i < len(node.children):
                child = node.children[i]
                if child.key:
                    match, held = pairs.get(id(child)), _below(place, child.tag)
                    own = _seeded(match.name) if match is not None else held
                    # the seed's own content has the seed's place, whatever else has its own
                    yield number(own if match is not None and match.key == child.key else held, child.key), [(id(node), i)]
                    below.append((child, own))
            at = i + 1
        todo += reversed(below)


@lru_cache(1 << 12)
def _seeded(name: str) -> bytes:
    return _digest(b"seed", name.encode())


def _mark(node: Node) -> int:
    """Number of a name that marks an element; odd, as those of slots are even."""
    return int.from_bytes(_digest(b"mark", node.tag.encode("utf-8", "surrogatepass"), node.name.encode("utf-8", "surrogatepass")), "little", signed=True) | 1


def _articles(root: Node) -> list[Node]:
    """The outermost unmarked article and main elements, those below the fewest marked elements.

    So a mark on what holds the whole page hides no article, and cards in a sidebar stay out beside one.
    """
    found, todo = [], [(root, 0)]
    while todo:
        node, marks = todo.pop()
        if node.tag in _NO_TEXT:
            continue
        if node.tag in ("article", "main") and not node.marked:
            found.append((marks, node))
        else:
            marks += bool(node.marked)
            todo += [(c, marks) for c in reversed(node.children) if isinstance(c, Node)]
    least = min((m for m, _ in found), default=0)
    return [x for m, x in found if m == least]


def _size(top: Node) -> int:
    """Characters of text, without what is never shown as text."""
    n, todo = 0, [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len("".join(x.split()))
        elif x.tag not in _NO_TEXT:
            todo += x.children
    return n


def _unmark_page_forms(root: Node) -> None:
    """A form that holds most of a page's text is the page, not a form in it."""
    forms, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "form":
            forms.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    if forms:
        total = _size(root)
        for x in forms:
            x.marked = x.marked if 2 * _size(x) <= total else 0


def _heading(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "h1":
            return True
        todo += [c for c in x.children if isinstance(c, Node)]
    return False


def read(html: str, seed: bytes | None = None) -> tuple[list[int], bytes]:
    """(numbers of slots and marks, texts) of a page, which is all that is kept of it.

    A text is [whether a block begins before it, text, slots from the outermost in, how many of those lie outside its
    article, its strongest mark, that within its article, whether it is in an article, name marks within the article],
    each slot as its index, with whether it lies in an article.
    """
    root = parse(html)
    _unmark_page_forms(root)
    pairs = Matcher().pairs(root, seed_tree(seed)) if seed else {}
    numbers: list[int] = []
    index: dict[int, int] = {}
    covered: dict[tuple[int, int], int] = {}
    for n, cells in _slots(root, pairs):
        i = index.setdefault(n, len(numbers))
        if i == len(numbers):
            numbers.append(n)
        covered.update(dict.fromkeys(cells, i))
    own = {id(x) for x in _articles(root)}
    marks: dict[int, int] = {}
    out, edge = [], True
    # node, its parent and index, and what holds for what it is in: article element above, chosen article, slots, slots outside, marks
    todo: list[tuple] = [(root, None, 0, False, False, (), 0, 0, 0, ())]
    while todo:
        x, parent, place, inside, chosen, slots, outer, mark, inner, names = todo.pop()
        if x is None:
            edge = True
            continue
        if (parent, place) in covered:
            slots = (*slots, 2 * covered[parent, place] + inside)
            outer += not chosen
        if isinstance(x, str):
            if x:
                out.append((int(edge), x, slots, outer, mark, inner, int(chosen), names))
                edge = False
            continue
        if x.tag in _NO_TEXT:
            continue
        if x.marked and not (inside and x.tag == "header" and _heading(x)):
            # an article's own header with its title is part of the article
            mark = max(mark, x.marked)
            if chosen and x.marked == 1:
                names = (*names, marks.setdefault(_mark(x), len(marks)))
            elif chosen:
                inner = 2
        inside, chosen = inside or x.tag in ("article", "main"), chosen or id(x) in own
        block = x.tag not in _INLINE and x.tag != "wbr"
        if block:
            edge = True
            todo.append((None,) * 10)
        todo += [(c, id(x), i, inside, chosen, slots, outer, mark, inner, names) for i, c in reversed(list(enumerate(x.children)))]
    base = len(numbers)
    texts = [(*t[:7], [base + n for n in t[7]]) for t in out]
    return numbers + list(marks), json.dumps(texts, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def _joined(parts: Iterable[tuple[int, str]]) -> str:
    return " ".join("".join(" " * edge + text for edge, text in parts).split())


def text_of(numbers: list[int], texts: bytes, common: dict[int, int], alone: bool) -> str:
    """Main text from what ``read`` kept, given how often the host's template and marks are on its pages; ``alone``: the
    host has no other page."""
    rows = json.loads(texts.decode("utf-8", "surrogatepass"))
    count = [common.get(n, 0) for n in numbers]
    template = any(c for c, n in zip(count, numbers, strict=True) if not n & 1)

    def shown(only_articles: bool, use_template: bool, least: int = 1) -> str:
        out, gap = [], 0
        for edge, text, slots, outer, mark, inner, chosen, names in rows:
            gap |= edge
            if only_articles:
                if not chosen:
                    gap = 1
                    continue
                slots = slots[outer:]
                # the author's own names are not the site's
                if any(alone or count[n] > 1 for n in names):
                    inner = max(inner, 1)
                mark = inner
            if mark >= least or use_template and any(count[s >> 1] >= (FIRM if s & 1 else 2) for s in slots):
                gap = 1
                continue
            out.append((gap, text))
            gap = 0
        return _joined(out)

    body = shown(False, True)
    own = shown(True, True) or shown(True, False)
    if own and (not template or 2 * len(own) >= len(body)):
        return own
    if body or own:
        return body or own
    # all is template or marked: first the template stays, then marks are not believed
    tries = (shown(False, t, least) for least in (1, 2, 3) for t in (True, False))
    return next(filter(None, tries), "")


def main_text(html: str | None, others: tuple[str | None, ...] = ()) -> str:
    """Main text of one page, given pages of its host."""
    if not html:
        return ""
    pages = sorted({p for p in (html, *others) if p})
    seed = seed_of(parse(pages[0])) if len(pages) > 1 else None
    found = Counter(n for p in pages for n in set(read(p, seed)[0]))
    common = {n: c for n, c in found.items() if c > 1 and (n & 1 or c > SHARE * len(pages))}
    return text_of(*read(html, seed), common, len(pages) == 1)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html)``."""
    page_id, url, html = named(["page_id", "url", "html"])
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"), F.when(host != "", host).alias("host"), F.xxhash64(html).alias("h"))
    kind = rows.schema["page_id"].dataType.simpleString()
    def seeds(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seed_of(parse(x.as_py())) for x in b.column(1)], pa.binary())], names=["host", "seed"])

    def parsed(batches: Iterator[pa.RecordBatch]):
        names = ["page_id", "url", "host", "h", "slots", "texts"]
        for b in batches:
            found = [read(x, s) if x else ([], None) for x, s in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.binary())], names=names)

    # the page of the least digest lends its tree, for hosts of two distinct pages or more
    own = rows.where("host is not null and html is not null")
    first = own.groupBy("host").agg(F.min_by("html", "h").alias("html"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("host", "html")
    found = cut(map_batches(first, seeds, "host string, seed binary", 200), "html-seeds")
    size = found.agg(F.sum(F.length("seed"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if size <= SEEDS else found, "host", "left").select("page_id", "url", "host", "h", "html", "seed")
    read_pages = cut(map_batches(joined, parsed, f"page_id {kind}, url string, host string, h long, slots array<long>, texts binary", 200), "html-pages")

    # three narrow columns per slot; equal pages of a host count once
    known = read_pages.where("host is not null and texts is not null")
    counted = known.select("host", "h", F.explode(F.array_distinct("slots")).alias("slot")).distinct().groupBy("host", "slot").agg(F.count("*").alias("n")).where("n > 1")
    number = known.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    shared = counted.join(number, "host").where((F.col("slot").bitwiseAND(F.lit(1)) == 1) | (F.col("n") > SHARE * F.col("pages")))
    common = number.join(shared.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("common")), "host", "left")
    common = cut(common.select("host", "common", (F.col("pages") == 1).alias("alone")), "html-wrappers")
    ready = read_pages.join(common, "host", "left").select("page_id", "url", "slots", "texts", "common", F.coalesce("alone", F.lit(True)).alias("alone"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [text_of(n, t, dict(c or ()), a) if t else "" for n, t, c, a in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(ready, run, f"page_id {kind}, url string, text string, n_chars long", 200)
