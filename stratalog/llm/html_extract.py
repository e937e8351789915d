"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed once into a tree of elements; scripts, styles and what HTML itself calls navigation,
footer, aside, form and so on fall away. The trees of a host are aligned by simple tree matching (the
matching that pairs most nodes, keeping order and parents) to its wrappers: its commonest tree shape, and
common shapes that match badly with it, as other layouts do. Over all distinct pages of the host a wrapper's nodes then tell:

* text that is the same in a node on most pages is template and goes;
* the main node is the deepest one that holds most of the text that does not recur;
* outside the main node, nodes whose texts recur on other pages, or are nearly all links, are template;
* an element whose class or id consists of furniture words alone ("comment-list", "ad-slot") goes unless
  the host's main node is in it; words inside other names ("has-sidebar", "share-price-report") mean nothing.

All other text, in varying nodes or outside the wrapper, is content. A host with fewer than ``MIN_PAGES``
distinct pages has no wrapper: the main node is then found on the page alone.

Wrappers and node statistics are aggregated over all pages of all hosts; a host with most of the pages adds
to sums that are combined before the shuffle and gets its wrappers by broadcast, it is never gathered.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, cut, join_hot, scratch_path, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, whatever it holds.
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What is furniture by the meaning that HTML gives to an element or a role.
FURNITURE = frozenset(
    "head nav footer aside form menu dialog select input datalist fieldset script style textarea title noscript iframe template svg "
    "video audio canvas".split()
)
FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Names of classes and ids: words for furniture, and words that only say where or in what form.
FURNITURE_WORD = re.compile(
    r"(?:ads?|advert\w*|sponsor(?:ed|s)?|promo\w*|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|"
    r"gdpr|notices?|popup|modal|newsletter|subscribe|comments?|disqus|repl(?:y|ies)|respond|social|share|sharing|related|recommended|"
    r"pagination|pager|widgets?|toolbar)(?:box|slot|unit|bar|list|wrap|wrapper|container|area|section)?"
)
FORM_WORD = frozenset(
    "area bar block body bottom box button buttons container content div form group header holder inner item items left links list main "
    "outer page panel policy post posts reader right section side site slot space text thread title top unit user wrap wrapper".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Closed by the start of another of them (or of a block, for a paragraph).
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table article section div body html main td th blockquote".split())
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

#: Wrappers of a host, the shapes that they are chosen from, and from what likeness on shapes are one layout.
WRAPPERS, SHAPES, ALIKE = 3, 12, 0.5
#: Distinct pages that a host must have, and pages on which a node must be to tell anything.
MIN_PAGES = 3
#: Shares: of a node's pages with one text; of its pages whose text recurs; of the text in the main node; of links.
CONSTANT, RECURRING, MAIN, LINKS = 0.5, 0.9, 0.5, 0.8
#: What text under furniture names counts when the main node is looked for.
DOUBTED = 0.25
#: Hosts whose wrappers are broadcast all; a host has some kilobytes of them.
FEW_HOSTS = 2_000
#: Cells of an alignment table whose rows are all kept; of larger ones every so many rows are.
CELLS = 1 << 22


class Node:
    __slots__ = ("tag", "drop", "named", "parts")

    def __init__(self, tag: str, drop: bool = False, named: bool = False) -> None:
        self.tag, self.drop, self.named, self.parts = tag, drop, named, []  # parts: texts and Nodes


def is_furniture_name(value: str) -> bool:
    """Whether one of the names in a class or id is made of furniture words, and words of form, alone."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name) if not p.isdigit()]
        if parts and any(FURNITURE_WORD.fullmatch(p) for p in parts) and all(p in FORM_WORD or FURNITURE_WORD.fullmatch(p) for p in parts):
            return True
    return False


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is furniture by HTML's own meaning, and whether it has the name of furniture."""
    if tag in FURNITURE:
        return True, False
    named = False
    if "=" in attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            if name.lower() == "role":
                if value.lower() in FURNITURE_ROLE:
                    return True, False
            elif is_furniture_name(value):
                named = True
    return False, named


def tokens(page: str):
    """(kind, name, attributes) and texts of a page, in one pass: kind is "open", "close" or "text".

    A quote that is never closed is a character like any other. A tag, comment or declaration that does
    not end takes in the rest of the page.
    """
    at, end, closed = 0, len(page), {'"': True, "'": True}
    text_from = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        following = page[start + 1 : start + 2]
        close = following == "/"
        if following == "!" or following == "?" or (close and not page[start + 2 : start + 3].isalpha()):
            if text_from < start:
                yield "text", page[text_from:start], ""
            comment = page.startswith("<!--", start)
            past = page.find("-->", start + 4) if comment else page.find(">", start)
            at = text_from = end if past < 0 else past + (3 if comment else 1)
            continue
        name = TAG_NAME.match(page, start + 2 if close else start + 1)
        if name is None:
            at = start + 1
            continue
        if text_from < start:
            yield "text", page[text_from:start], ""
        at = name.end()
        while True:
            m = TAG_END.search(page, at)
            if m is None:
                return
            at = m.end()
            if m.group() == ">":
                break
            if closed[m.group()]:
                other = page.find(m.group(), at)
                if other < 0:
                    closed[m.group()] = False
                else:
                    at = other + 1
        tag = name.group().lower()
        yield "close" if close else "open", tag, page[name.end() : at - 1]
        if not close and tag in RAW:
            m = RAW_END[tag].search(page, at)
            at = m.end() if m else end
            yield "close", tag, ""
        text_from = at
    if text_from < end:
        yield "text", page[text_from:], ""


def parse(page: str) -> Node:
    """The tree of a page; unclosed elements are closed as HTML closes them, or by the end of the page."""
    root = Node("#root")
    stack, open_tags = [root], Counter()

    def close_from(i: int) -> None:
        for n in stack[i:]:
            open_tags[n.tag] -= 1
        del stack[i:]

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            stack[-1].parts.append(tag)
            continue
        if kind == "close":
            if open_tags[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close_from(i)
            elif tag in ("p", "br"):
                stack[-1].parts.append(Node(tag))
            continue
        if tag in BLOCK and open_tags["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_from(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in CLOSED_BY and any(open_tags[t] > 0 for t in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    close_from(i)
                    if tag != "tr" or i >= len(stack):
                        break
                elif stack[i].tag in SCOPES and not (tag == "tr" and stack[i].tag in ("td", "th")):
                    break
        drop, named = _marks(tag, attributes)
        if tag == "header" and not open_tags["article"] and not open_tags["main"]:
            drop = True
        elif tag == "button" and not open_tags["p"]:
            drop = True
        node = Node(tag, drop, named)
        stack[-1].parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        open_tags[tag] += 1
        stack.append(node)
    return root


def blocks_of(page: str | None) -> tuple[str, list[tuple[int, str, int]], list[int]]:
    """The shape of a page, its text blocks (number of the element, clean text, characters in links), named elements.

    Inline elements belong to the block around them. The shape writes every block as (tag ... ); its k-th
    opening bracket is the k-th block element. Text that goes on after an inner block is a text block more.
    Of elements with a furniture name the outermost are listed, each by its number and that of the last one in it.
    """
    if not page:
        return "", [], []
    shape: list[str] = []
    named: list[int] = []
    out: list[tuple[int, str, int]] = []
    raw: list[str] = []
    current: list[int] = []
    state = {"links": 0, "named": 0, "linked": 0, "count": 0}

    def flush() -> None:
        if raw:
            clean = " ".join(html.unescape("".join(raw)).split())
            if clean:
                out.append((current[-1], clean, min(len(clean), state["linked"])))
            raw.clear()
            state["linked"] = 0

    todo: list = [(parse(page), "open")]
    while todo:
        item, how = todo.pop()
        if how == "text":
            raw.append(item)
            if state["links"]:
                state["linked"] += len(item.strip())
            continue
        block = item.tag in BLOCK or item.tag == "#root"
        inline_named = item.named and not block
        if how == "close":
            if block:
                flush()
                shape.append(")")
                current.pop()
                state["named"] -= item.named
                if item.named and not state["named"]:
                    named.append(state["count"] - 1)
            else:
                state["links"] -= item.tag == "a"
            continue
        if item.drop or inline_named:
            continue
        if block:
            flush()
            shape.append(f"({item.tag}")
            current.append(state["count"])
            if item.named and not state["named"]:
                named.append(state["count"])
            state["named"] += item.named
            state["count"] += 1
        elif item.tag == "br":
            raw.append(" ")
        state["links"] += item.tag == "a"
        todo.append((item, "close"))
        todo.extend((p, "open" if isinstance(p, Node) else "text") for p in reversed(item.parts))
    return "".join(shape), out, named


# Simple tree matching ------------------------------------------------------------------------------


class Tree:
    """A shape as arrays over its block elements: tag, first child and next sibling order, size, end, subtree identity."""

    def __init__(self, shape: str) -> None:
        self.tags: list[str] = []
        self.children: list[list[int]] = []
        self.ends: list[int] = []  # number of the last element below
        self.kinds: list[int] = []  # equal for equal subtrees
        stack: list[int] = []
        self.roots: list[int] = []
        for m in re.finditer(r"\(([^()]*)|\)", shape):
            if m.group(0) == ")":
                if stack:
                    self._done(stack.pop())
                continue
            number = len(self.tags)
            self.tags.append(m.group(1))
            self.children.append([])
            self.ends.append(number)
            self.kinds.append(-1)
            (self.children[stack[-1]] if stack else self.roots).append(number)
            stack.append(number)
        while stack:
            self._done(stack.pop())

    def _done(self, number: int) -> None:
        self.ends[number] = len(self.tags) - 1
        self.kinds[number] = kind_of(self.tags[number], tuple(self.kinds[c] for c in self.children[number]))

    def size(self, number: int) -> int:
        return self.ends[number] - number + 1


#: Subtree kinds of a worker: (tag, kinds of the children) -> number, and for each its tag, children and size.
_KINDS: dict[tuple, int] = {}
_KIND: list[tuple[str, tuple[int, ...], int]] = []
#: Sizes of the largest matchings of two kinds.
_MATCHED: dict[tuple[int, int], int] = {}
_ALIGNED: dict[tuple[str, str], tuple[int, dict[int, int]]] = {}


def kind_of(tag: str, children: tuple[int, ...]) -> int:
    key = (tag, children)
    found = _KINDS.get(key)
    if found is None:
        found = _KINDS[key] = len(_KIND)
        _KIND.append((tag, children, 1 + sum(_KIND[c][2] for c in children)))
    return found


def _middle(left, right) -> tuple[int, int]:
    """How many children at both ends are equal subtrees: some largest matching pairs them."""
    n, m = len(left), len(right)
    head = 0
    while head < n and head < m and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and left[n - 1 - tail] == right[m - 1 - tail]:
        tail += 1
    return head, tail


def _gain(left, right) -> np.ndarray:
    """For each distinct kind on the left a row: the sizes of its matchings with every kind on the right."""
    distinct = sorted(set(right))
    place = {k: i for i, k in enumerate(distinct)}
    at = np.array([place[k] for k in right])
    rows = {}
    for x in set(left):
        rows[x] = np.array([matched(x, y) for y in distinct], np.int32)[at]
    return rows


def _rows(left, rows: dict, before: np.ndarray, lo: int, hi: int):
    """Rows lo + 1 to hi of the alignment table, from row lo."""
    for i in range(lo, hi):
        taken = before[:-1] + rows[left[i]]
        taken[rows[left[i]] == 0] = 0
        after = before.copy()
        np.maximum(after[1:], taken, out=after[1:])
        before = np.maximum.accumulate(after)
        yield before


def _aligned_children(left, right, traced: bool):
    """The best total of an order-keeping matching of two lists of kinds, and if ``traced`` the pairs of places."""
    head, tail = _middle(left, right)
    total = sum(_KIND[k][2] for k in [*left[:head], *left[len(left) - tail :]])
    inner_left, inner_right = left[head : len(left) - tail], right[head : len(right) - tail]
    pairs = [(i, i) for i in range(head)] + [(len(left) - tail + i, len(right) - tail + i) for i in range(tail)] if traced else []
    if not inner_left or not inner_right:
        return total, pairs
    rows = _gain(inner_left, inner_right)
    n, m = len(inner_left), len(inner_right)
    step = 1 if n * m <= CELLS else max(1, int(n**0.5))
    row = np.zeros(m + 1, np.int32)
    kept = {0: row}
    for i, row in enumerate(_rows(inner_left, rows, row, 0, n), 1):
        if traced and i % step == 0:
            kept[i] = row
    total += int(row[-1])
    if traced:
        j, hi = m, n
        while hi > 0 and j > 0:
            lo = (hi - 1) // step * step
            block = [kept[lo], *_rows(inner_left, rows, kept[lo], lo, hi)]
            for i in range(hi, lo, -1):
                now, above = block[i - lo], block[i - lo - 1]
                while j > 0 and now[j] != above[j]:
                    if now[j] == now[j - 1]:
                        j -= 1
                    else:
                        pairs.append((head + i - 1, head + j - 1))
                        j -= 1
                        break
            hi = lo
    return total, pairs


def matched(a: int, b: int) -> int:
    """The size of the largest matching of two subtrees, by their kinds; computed without recursion, inner pairs first."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (x, y) in _MATCHED or x == y or _KIND[x][0] != _KIND[y][0] or not _KIND[x][1] or not _KIND[y][1]:
            todo.pop()
            continue
        left, right = _KIND[x][1], _KIND[y][1]
        head, tail = _middle(left, right)
        inner = {(p, q) for p in set(left[head : len(left) - tail]) for q in set(right[head : len(right) - tail])}
        missing = [
            (p, q) for p, q in inner
            if p != q and (p, q) not in _MATCHED and _KIND[p][0] == _KIND[q][0] and _KIND[p][1] and _KIND[q][1]
        ]
        if missing:
            todo.extend(missing)
            continue
        todo.pop()
        _MATCHED[x, y] = 1 + _aligned_children(left, right, False)[0]
    if a == b:
        return _KIND[a][2]
    if _KIND[a][0] != _KIND[b][0]:
        return 0
    return _MATCHED.get((a, b), 1)


def match(a: Tree, b: Tree) -> tuple[int, dict[int, int]]:
    """Most pairs of nodes of two trees with equal tags, order and parents kept: size, and element -> element."""
    pairs: dict[int, int] = {}
    todo = []
    if a.roots and b.roots and a.tags[0] == b.tags[0]:
        todo.append((0, 0))
    while todo:
        x, y = todo.pop()
        pairs[x] = y
        if a.kinds[x] == b.kinds[y]:
            for k in range(1, a.size(x)):
                pairs[x + k] = y + k
            continue
        left, right = a.children[x], b.children[y]
        if left and right:
            _, places = _aligned_children(tuple(a.kinds[c] for c in left), tuple(b.kinds[c] for c in right), True)
            todo.extend((left[i], right[j]) for i, j in places)
    return len(pairs), pairs


def aligned(shape: str, wrapper: str) -> tuple[int, dict[int, int]]:
    """Size of the matching of a page's shape with a wrapper, and element of the page -> element of the wrapper."""
    key = (shape, wrapper)
    found = _ALIGNED.get(key)
    if found is None:
        if len(_ALIGNED) > 5_000 or len(_KIND) > 200_000 or len(_MATCHED) > 1_000_000:
            for memo in (_ALIGNED, _KINDS, _KIND, _MATCHED):
                memo.clear()
        found = _ALIGNED[key] = match(Tree(shape), Tree(wrapper))
    return found


def likeness(shape: str, wrapper: str) -> float:
    return 2 * aligned(shape, wrapper)[0] / max(1, shape.count("(") + wrapper.count("("))


def best_wrapper(shape: str, wrappers: list[str]) -> tuple[int, dict[int, int]]:
    """The wrapper with the largest matching in proportion to the sizes, and the elements' places in it."""
    best = (-1.0, 0, {})
    for w, wrapper in enumerate(wrappers):
        alike = likeness(shape, wrapper)
        if alike > best[0]:
            best = (alike, w, aligned(shape, wrapper)[1])
    return best[1], best[2]


def main_node(shape: str, chars: dict[int, float]) -> tuple[int, int]:
    """First and last element of the deepest subtree with the share ``MAIN`` of the characters; (0, -1) without any."""
    tree = Tree(shape)
    total = np.zeros(len(tree.tags) + 1)
    for number, n in chars.items():
        total[number + 1] += n
    total = np.cumsum(total)
    if total[-1] <= 0:
        return 0, -1
    at = 0
    while True:
        inner = [c for c in tree.children[at] if total[tree.ends[c] + 1] - total[c] >= MAIN * total[-1]]
        if not inner:
            return at, tree.ends[at]
        at = inner[0]


# Over all pages ------------------------------------------------------------------------------------


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = "page_id long, url string, host string, shape string, owners array<int>, texts array<string>, links array<int>, named array<int>"


def _parsed(batches):
    """Each page once: its host, shape, text blocks and named elements, in pieces of bounded size."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["page_id", "url", "host", "shape", "owners", "texts", "links", "named"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows, size = [], 0
        for page_id, url, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            page = value.as_py()
            shape, blocks, named = blocks_of(page)
            owners, texts, links = zip(*blocks, strict=True) if blocks else ((), (), ())
            rows.append((page_id, url, host_of(url), shape, owners, texts, links, named))
            size += len(page or "")
            if size > 1 << 24:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


FILLED = "host string, page long, slots array<struct<w:int,slot:int,h:long,chars:long,links:long,named:boolean>>"


def _slots(batches):
    """Per page: host, identity (that of its texts), and for each block in a wrapper's node what it holds."""
    struct = pa.struct([("w", pa.int32()), ("slot", pa.int32()), ("h", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("named", pa.bool_())])
    for batch in batches:
        hosts, pages, slots = [], [], []
        for host, shape, owners, hashes, chars, links, named, wrappers in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            w, to = best_wrapper(shape, wrappers)
            hosts.append(host)
            pages.append(xxhash.xxh64_intdigest(np.array(hashes).tobytes()) - (1 << 63))
            slots.append([
                {"w": w, "slot": to[k], "h": h, "chars": c, "links": n, "named": covered(k, named) is not None}
                for k, h, c, n in zip(owners, hashes, chars, links, strict=True) if k in to
            ])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(slots, pa.list_(struct))], names=["host", "page", "slots"])


def covered(number: int, named: list[int]) -> int | None:
    """The named element, as its place in the list, that an element is in."""
    return next((i for i in range(0, len(named), 2) if named[i] <= number <= named[i + 1]), None)


def _described(batches):
    """Per host and wrapper: from the sums of its nodes the main node and the template nodes, as JSON."""
    for batch in batches:
        out = []
        for wrapper, sums in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            chars = {s["slot"]: s["fresh"] for s in sums or ()}
            first, last = main_node(wrapper, chars)
            outside = [s for s in sums or () if not first <= s["slot"] <= last and s["pages"] >= MIN_PAGES]
            template = [s["slot"] for s in outside if s["again"] >= RECURRING * s["pages"] or s["links"] >= LINKS * s["chars"]]
            out.append(json.dumps({"main": [first, last], "template": sorted(template)}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["host", "w", "wrapper", "told"])


def _layouts(batches):
    """Of the commonest shapes of a host, in order, those that are unlike all before."""
    for batch in batches:
        out = []
        for shapes in batch.column(2).to_pylist():
            chosen: list[str] = []
            for shape in shapes:
                if len(chosen) < WRAPPERS and all(likeness(shape, w) < ALIKE for w in chosen):
                    chosen.append(shape)
            out.append(chosen)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["host", "pages", "wrappers"])


def wrappers(parsed: DataFrame) -> DataFrame:
    """(host, pages, wrappers, told, constant) of hosts: their shapes, what the nodes tell, and constant texts of nodes.

    ``pages`` counts the rows of the host. Of equally common shapes the one with the smallest hash is first.
    """
    full = parsed.where(F.size("texts") > 0)
    shapes = full.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    # of a host only the commonest shapes so far are kept while they are merged
    rank = F.struct((-F.col("n")).alias("n"), F.xxhash64("shape").alias("h"), "shape")
    part = F.pmod(F.xxhash64("shape"), F.lit(64))
    kept = F.slice(F.array_sort(F.collect_list("s")), 1, SHAPES)
    some = shapes.select("host", part.alias("p"), rank.alias("s")).groupBy("host", "p").agg(kept.alias("some"), F.sum(-F.col("s.n")).alias("n"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, SHAPES)
    hosts = some.groupBy("host").agg(F.sum("n").alias("pages"), merged.alias("s")).where(F.col("pages") >= MIN_PAGES)
    hosts = cut(hosts.select("host", "pages", F.col("s.shape").alias("shapes")).mapInArrow(_layouts, "host string, pages long, wrappers array<string>"))
    rows = full.select("host", "shape", "owners", F.transform("texts", lambda t: F.xxhash64(t)).alias("hashes"), F.transform("texts", lambda t: F.char_length(t).cast("long")).alias("chars"), "links", "named")
    joined = join_hot(rows, "host", hosts, "pages", rows.count(), FEW_HOSTS)
    filled = joined.mapInArrow(_slots, FILLED)
    distinct = filled.groupBy("host", "page").agg(F.min("slots").alias("slots"))
    texts = distinct.select("host", F.explode("slots").alias("s")).groupBy("host", "s.w", "s.slot", "s.h").agg(
        F.count(F.lit(1)).alias("n"), F.max("s.chars").alias("chars"), F.max("s.links").alias("links"), F.max("s.named").alias("named")
    )
    texts = cut(texts)
    again, doubt = F.col("n") > 1, F.when(F.col("named"), DOUBTED).otherwise(1.0)
    sums = texts.groupBy("host", "w", "slot").agg(
        F.sum("n").alias("pages"),
        F.sum(F.when(again, F.col("n")).otherwise(0)).alias("again"),
        F.sum(F.when(again, 0).otherwise(F.col("chars") * doubt)).alias("fresh"),
        F.sum(F.col("chars") * F.col("n")).alias("chars"),
        F.sum(F.col("links") * F.col("n")).alias("links"),
    )
    same = ["host", "w", "slot"]
    constant = texts.where(F.col("n") >= MIN_PAGES).join(sums.select(*same, F.col("pages").alias("of")), same).where(F.col("n") >= CONSTANT * F.col("of"))
    constant = constant.groupBy("host").agg(F.collect_list(F.struct("w", "slot", "h")).alias("constant"))
    each = hosts.select("host", F.posexplode("wrappers").alias("w", "wrapper"))
    nodes = sums.groupBy("host", "w").agg(F.collect_list(F.struct("slot", "pages", "again", "fresh", "chars", "links")).alias("sums"))
    told = each.join(nodes, ["host", "w"], "left").select("host", "w", "wrapper", "sums").mapInArrow(_described, "host string, w int, wrapper string, told string")
    told = told.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("w", "told"))).alias("t")).select("host", F.col("t.told").alias("told"))
    return cut(hosts.join(told, "host").join(constant, "host", "left").select("host", "pages", "wrappers", "told", "constant"))


def _contents(batches):
    """The text of each page: its blocks without template and without furniture by name outside the main node."""
    read: dict[str, dict] = {}
    for batch in batches:
        out = []
        ids, urls, rest = batch.column(0), batch.column(1), [batch.column(i).to_pylist() for i in range(2, 8)]
        texts = batch.column(8)
        for i, (shape, owners, hashes, named, known, constant) in enumerate(zip(*rest, strict=True)):
            if not owners:
                out.append("")
                continue
            own = texts[i].as_py()
            to, told, w = {}, None, -1
            if known:
                w, to = best_wrapper(shape, [k["wrapper"] for k in known])
                said = known[w]["told"]
                if len(read) > 10_000:
                    read.clear()
                told = read.get(said) or read.setdefault(said, json.loads(said))
            holders = {None}
            if named:  # a named element stays if the main node is in it
                first, last = told["main"] if told else (0, -1)
                main = [k for k, slot in to.items() if first <= slot <= last]
                if not main:
                    chars: dict[int, float] = {}
                    for k, t in zip(owners, own, strict=True):
                        chars[k] = chars.get(k, 0) + len(t) * (1.0 if covered(k, named) is None else DOUBTED)
                    main = [main_node(shape, chars)[0]]
                holders = {None, covered(min(main), named)}
            fixed = set(told["template"]) if told else ()
            same = {(c["slot"], c["h"]) for c in constant or () if c["w"] == w}
            kept = [
                t for k, t, h in zip(owners, own, hashes, strict=True)
                if covered(k, named) in holders and not (k in to and (to[k] in fixed or (to[k], h) in same))
            ]
            out.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without main text, has the empty text; a null or odd url makes the host
    ''. Repeated rows are each returned, but count once in what a host tells. Hosts with fewer than
    ``MIN_PAGES`` pages have no template. Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    path = scratch_path(spark, "pages")  # parsed once, read twice
    picked.mapInArrow(_parsed, PARSED).write.parquet(path)
    parsed = spark.read.parquet(path)
    hosts = wrappers(parsed)
    rows = parsed.select("page_id", "url", "host", "shape", "owners", F.transform("texts", lambda t: F.xxhash64(t)).alias("hashes"), "named", "texts")
    known = hosts.select("host", "pages", F.zip_with("wrappers", "told", lambda w, t: F.struct(w.alias("wrapper"), t.alias("told"))).alias("known"), "constant")
    kind = dict(known.dtypes)
    alone = rows.join(F.broadcast(hosts.select("host")) if hosts.count() <= 100_000 else hosts.select("host"), "host", "left_anti")
    alone = alone.select("*", F.lit(None).cast(kind["known"]).alias("known"), F.lit(None).cast(kind["constant"]).alias("constant"))
    joined = join_hot(rows, "host", known, "pages", rows.count(), FEW_HOSTS).unionByName(alone)
    return joined.select("page_id", "url", "shape", "owners", "hashes", "named", "known", "constant", "texts").mapInArrow(_contents, "page_id long, url string, text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = extract(table(spark, sf_dir, "pages"))
    return extracted.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
