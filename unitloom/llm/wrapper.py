"""Main text of web pages by wrapper induction.

Each page of a host is aligned with the most similar of the host's references (one page for each of its
layouts) by tree matching.  What stays the same at a reference node over the layout's pages is template;
what varies is a slot.  The content is the article and main elements, else the element that holds the
varying text.  In all of them blocks of template go; menus, comments and elements with a label of
boilerplate go too, unless an article or most of the varying text lies inside.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, ship

#: References of all hosts together are broadcast up to so many characters, else joined by a shuffle.
BROADCAST_CHARS = 64_000_000
#: A node is template if it is the same on at least this share of the layout's pages other than the reference, of which there are MIN_PAGES.
TEMPLATE_SHARE, MIN_PAGES = 0.8, 3
#: Pages of a host from which its references are chosen, references it has at most, and tree similarity under which a page is another layout.
SAMPLED, LAYOUTS, ALIKE = 8, 4, 0.5
#: Weight of an equal text when trees are matched (a pair of nodes weighs 1), so that repeated blocks meet at whatever place.
EQUAL_TEXT = 4
#: Siblings below which a row of the matching table is a list and not an array; the values are the same.
SHORT = 48
#: A labelled element with this share of the page's varying text is content.
MOST = 0.5

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same kind ends, and the containers that the search for it doesn't leave.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = frozenset("head script style noscript template title iframe svg nav footer aside form button select textarea dialog menu object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar footer header masthead cookie cookies consent notice notices newsletter subscribe signup login social share sharing related"
    " recommended popup modal overlay pagination pager widget toolbar skip".split()
)
COMMENTS = frozenset("comment comments disqus reply replies".split())

MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
NAME = re.compile(r"</?([A-Za-z][^\s/><]*)")
GAP = re.compile(r"[\s/]*")
#: The usual tag: values without < and >, each followed by a space or the end.
PLAIN_TAG = re.compile(r"((?:\s++[^\s/>=\"'<]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=/]++)(?=[\s>]))?)*+)\s*+>")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
#: What follows an end quote: a space, the tag's end, or another attribute that is glued to it.
AFTER_QUOTE = re.compile(r"[\s/>]|[A-Za-z-]{1,40}=[\"']|\Z")
#: Elements whose text shows that a page has content beside a labelled element.
TELLING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "number", "text", "below", "order")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.number, self.text, self.below = tag, attributes, [], -1, None, None
        self.order = None

    def elements(self) -> list[Node]:
        """Its element children; asked for only when the tree is complete."""
        if self.below is None:
            self.below = [c for c in self.children if isinstance(c, Node)]
        return self.below

    def preorder(self) -> list[Node]:
        """All nodes from this one down; read backwards, children come before their parents."""
        if self.order is None:
            # Without the node itself, which would be a cycle.
            self.order, todo = [], self.elements()[::-1]
            while todo:
                node = todo.pop()
                self.order.append(node)
                below = node.elements()
                if below:
                    todo += below[::-1]
        return [self, *self.order]

    def own_text(self) -> str:
        if self.text is None:
            self.text = " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())
        return self.text


def read_tag(source: str, at: int) -> tuple[list[tuple[str, str]], int, int, bool]:
    """Attributes of the tag whose name ends at ``at``, where they end, where the tag ends and whether a slash ends it.

    Quotes inside an unquoted value belong to it.  A quoted value that runs over a ``>`` to a quote in mid-word lacks its end quote
    and ends at the ``>``.  A tag without ``>`` ends where the next one begins, or at the end of the page.
    Every search starts at a quote of its own, so the time is linear in the page.
    """
    found = []
    while True:
        gap = GAP.match(source, at).end()
        slash, at = gap > at and source[gap - 1] == "/", gap
        if at >= len(source) or source[at] == ">":
            return found, at, min(at + 1, len(source)), slash
        if source[at] == "<" and MARKUP.match(source, at):
            return found, at, at, slash
        m = ATTRIBUTE.match(source, at)
        value, at = m[3] or "", m.end()
        if m[2]:
            end = source.find(m[2], at)
            if end < 0 or (not AFTER_QUOTE.match(source, end + 1) and source.find(">", at, end) >= 0):
                close = source.find(">", at)
                end = after = close if close >= 0 else len(source)
            else:
                after = end + 1
            value, at = source[at:end], after
        found.append((m[1].lower(), value.lower()))


def after_markup(source: str, at: int) -> tuple[int, str]:
    """Where the comment, declaration or other markup at ``at`` that is no tag ends, and the text it stands for."""
    if source.startswith("<!--", at):
        if source.startswith((">", "->"), at + 4):
            return source.index(">", at + 4) + 1, ""
        end, width = source.find("-->", at + 4), 3
    elif source.startswith("<![CDATA[", at):
        end = source.find("]]>", at)
        return (end + 3, source[at + 9 : end]) if end >= 0 else (len(source), source[at + 9 :])
    else:
        end, width = source.find(">", at), 1
    return (end + width if end >= 0 else len(source)), ""


def raw_end(source: str, tag: str, at: int) -> tuple[int, int]:
    """Begin and end of the end tag of an element of plain text, or the end of the page."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
    return m.span() if m else (len(source), len(source))


class Open:
    """The open elements, with the depths of each kind, so that no tag searches the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        depths = self.depths.get(node.tag)
        if depths is None:
            depths = self.depths[node.tag] = []
        depths.append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        depth = 0
        for tag in tags:
            depths = self.depths.get(tag)
            if depths and depths[-1] > depth:
                depth = depths[-1]
        return depth

    def end(self, tag: str) -> None:
        """An end tag; an inline one doesn't close a block."""
        depth = self.last(tag)
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):
            self.cut(depth)

    def begin(self, tag: str) -> None:
        """Ends what a new element of this kind ends."""
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in ENDED_BY:
            kinds, limits = ENDED_BY[tag]
            depth = self.last(*kinds)
            if depth > self.last(*limits):
                self.cut(depth)


def parse(source: str | None) -> Node:
    """The page's tree.  Unclosed elements end with their parent, or where the next block or item begins."""
    root = Node("#root")
    opened, at, source = Open(root), 0, source or ""
    while at < len(source):
        m = MARKUP.search(source, at)
        start = m.start() if m else len(source)
        if start > at:
            opened.stack[-1].children.append(entities.unescape(source[at:start]))
        if not m:
            break
        name = NAME.match(source, start)
        if not name:
            at, text = after_markup(source, start)
            if text:
                opened.stack[-1].children.append(text)
            continue
        tag, plain = name[1].lower(), PLAIN_TAG.match(source, name.end())
        if plain:
            at, slash, held = plain.end(), False, plain[1]
        else:
            _, end, at, slash = read_tag(source, name.end())
            held = source[name.end() : end]
        if source[start + 1] == "/":
            opened.end(tag)
            continue
        opened.begin(tag)
        node = Node(tag, held)
        opened.stack[-1].children.append(node)
        if tag in RAW and not slash:
            end, after = raw_end(source, tag, at)
            node.children.append(source[at:end])
            at = after
        elif tag not in VOID and not (slash and tag not in BLOCK):
            opened.push(node)
    for number, node in enumerate(root.preorder()):
        node.number = number
    return root


def hidden(node: Node) -> bool:
    """Menus, buttons, scripts and what isn't shown; a form may hold the whole page, so it counts as a label."""
    if node.tag in LEFT_OUT and node.tag != "form":
        return True
    for name, value in attributes(node):
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def attributes(node: Node) -> list[tuple[str, str]]:
    return read_tag(node.attributes + ">", 0)[0] if node.attributes.strip() else []


def labels(node: Node) -> tuple[set[str], bool]:
    """Words of boilerplate in the element's tag, role, class and id, and whether one is a whole name and not a part of one.

    Articles and the page itself can only be comments.
    """
    found = {"form"} if node.tag == "form" else set()
    whole = bool(found)
    for name, value in attributes(node):
        if name == "role" and value in ROLES:
            found.add(value)
            whole = True
        if name in ("class", "id"):
            found |= (LABELS | COMMENTS) & set(re.split(r"[\s_-]+", value))
            whole = whole or not LABELS.isdisjoint(value.split())
    if node.tag in ("html", "body", "main"):
        return set(), False
    return (found & COMMENTS, False) if node.tag == "article" else (found, whole)


def judge(page: Node, constant: set[int], believed: bool = True) -> tuple[set[int], dict[int, int]]:
    """Numbers of the elements to leave out, and the length of the varying text under each of the others.

    ``believed`` tells whether labels count at all.  A labelled element stays if it holds an article or main element.  Without those
    and an h1, a form or an element whose whole name is a label goes if the page has TELLING text outside labelled elements;
    other labelled elements stay with MOST of the varying text.  A header inside an article may be the article's own.
    """
    known: dict[int, set[str]] = {}
    whole: set[int] = set()
    holds: dict[int, set[str]] = {}
    raw: dict[int, int] = {}
    plain = False  # an article or main element outside comments
    beside = 0  # varying text outside labelled elements
    shown: list[Node] = []
    todo = [(page, False, False, False)]
    while todo:
        node, commented, labelled, telling = todo.pop()
        n = node.number
        if hidden(node):
            raw[n], holds[n], known[n] = -1, set(), set()
            continue
        shown.append(node)
        known[n], named = labels(node) if believed else (set(), False)
        if named:
            whole.add(n)
        commented = commented or not COMMENTS.isdisjoint(known[n])
        labelled = labelled or bool(known[n]) or node.tag == "header"
        telling = telling or node.tag in TELLING
        plain = plain or (node.tag in ("article", "main") and not commented)
        raw[n] = 0 if n in constant else len(node.own_text())
        beside += raw[n] if telling and not labelled else 0
        holds[n] = {node.tag} & {"article", "main", "h1"}
        todo += [(c, commented, labelled, telling) for c in reversed(node.elements())]
    for node in reversed(shown):
        for child in node.elements():
            holds[node.number] |= holds[child.number]
            if raw[child.number] > 0 and COMMENTS.isdisjoint(known[child.number]):
                raw[node.number] += raw[child.number]

    def goes(node: Node, inside: bool, opened: bool) -> bool:
        n = node.number
        if raw[n] < 0:
            return True
        if not COMMENTS.isdisjoint(known[n]):
            return opened or not ("main" in holds[n] or "h1" in holds[n] or ("article" in holds[n] and not plain))
        words = known[n] - {"header"} if inside else known[n]
        if not words or not holds[n].isdisjoint(("article", "main")):
            return False
        if n in whole and beside and "h1" not in holds[n]:
            return True
        return raw[n] < MOST * raw[page.number] or not raw[n]

    left_out: set[int] = set()
    varying: dict[int, int] = {}
    kept: list[Node] = []
    todo = [(page, False, False)]
    while todo:
        node, inside, opened = todo.pop()
        n = node.number
        varying[n] = 0
        if goes(node, inside, opened):
            left_out.add(n)
            continue
        inside = inside or node.tag in ("article", "main")
        opened = opened or node.tag == "article" or not COMMENTS.isdisjoint(known[n])
        if not (node.tag == "header" and not inside and holds[n].isdisjoint(("article", "main"))):
            kept.append(node)
            varying[n] = 0 if n in constant else len(node.own_text())
        todo += [(c, inside, opened) for c in reversed(node.elements())]
    for node in reversed(kept):
        varying[node.number] += sum(varying.get(c.number, 0) for c in node.elements())
    return left_out, varying


class Matcher:
    """Weights of simple tree matching between two pages.

    Subtrees are numbered by what the matching can see of them: tags, and texts (with their attributes) that both pages have.
    Weights depend on these numbers alone, so repeated structures with other texts are compared once.  Equal
    subtrees at both begins or both ends of two lists of siblings can be paired without loss; tables are for what lies between.
    """

    def __init__(self, a: Node, b: Node):
        pages = [(nodes, [self.text_key(node) for node in nodes]) for nodes in (a.preorder(), b.preorder())]
        self.tags, self.texts, self.children, self.whole = [], [], [], []
        shared = set(pages[0][1]) & set(pages[1][1]) - {None}
        names: dict[tuple, int] = {}
        self.kind = tuple(self.number(nodes, keys, shared, names) for nodes, keys in pages)
        self.known: dict[tuple[int, int], int] = {}

    @staticmethod
    def text_key(node: Node) -> tuple[str, str, str] | None:
        text = node.own_text()
        return (node.tag, node.attributes, text) if text else None

    def number(self, nodes: list[Node], keys: list, shared: set, names: dict[tuple, int]) -> dict[int, int]:
        kind: dict[int, int] = {}
        for node, key in zip(reversed(nodes), reversed(keys)):
            below = node.elements()
            seen = (node.tag, key if key in shared else None, tuple([kind[c.number] for c in below]) if below else ())
            if seen not in names:
                names[seen] = len(names)
                self.tags.append(seen[0])
                self.texts.append(seen[1])
                self.children.append(seen[2])
                self.whole.append(1 + (EQUAL_TEXT if seen[1] else 0) + sum(self.whole[c] for c in seen[2]))
            kind[node.number] = names[seen]
        return kind

    @staticmethod
    def ends(xs: list[int], ys: list[int]) -> tuple[int, int]:
        """How many equal subtrees the two lists begin and end with."""
        most, first, last = min(len(xs), len(ys)), 0, 0
        while first < most and xs[first] == ys[first]:
            first += 1
        while last < most - first and xs[-1 - last] == ys[-1 - last]:
            last += 1
        return first, last

    def weight(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            x, y = pair = todo[-1]
            if self.at(x, y) is not None:
                todo.pop()
                continue
            xs, ys = self.children[x], self.children[y]
            first, last = self.ends(xs, ys)
            inner = xs[first : len(xs) - last], ys[first : len(ys) - last]
            waiting = [(p, q) for p in set(inner[0]) for q in set(inner[1]) if self.at(p, q) is None]
            if waiting:
                todo += waiting
                continue
            total = 1 + (EQUAL_TEXT if self.texts[x] and self.texts[x] == self.texts[y] else 0)
            total += sum(self.whole[c] for c in (*xs[:first], *xs[len(xs) - last :]))
            if inner[0] and inner[1]:
                *_, row = self.rows(*inner)
                total += int(row[-1])
            self.known[pair] = total
            todo.pop()
        return self.at(x, y)

    def at(self, x: int, y: int) -> int | None:
        """A weight if it is known; subtrees of other tags weigh nothing together."""
        if x == y:
            return self.whole[x]
        return self.known.get((x, y)) if self.tags[x] == self.tags[y] else 0

    def rows(self, xs, ys, begin=None) -> Iterator[list[int] | np.ndarray]:
        """The table of two lists of siblings row by row, from a given row on; inner weights are known."""
        kinds = {y: k for k, y in enumerate(dict.fromkeys(ys))}
        place = [kinds[y] for y in ys]
        against = {x: [self.at(x, y) for y in kinds] for x in set(xs)}
        if len(ys) < SHORT:
            row = [0] * (len(ys) + 1) if begin is None else begin
            yield row
            for x in xs:
                above, row, weights = row, [0], against[x]
                for j, k in enumerate(place):
                    row.append(max(above[j + 1], row[j], above[j] + weights[k]))
                yield row
            return
        place, against = np.array(place), {x: np.array(weights, dtype=np.int32) for x, weights in against.items()}
        row = np.zeros(len(ys) + 1, dtype=np.int32) if begin is None else begin
        yield row
        for x in xs:
            above, row = row, np.zeros(len(ys) + 1, dtype=np.int32)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + against[x][place]), out=row[1:])
            yield row

    def siblings(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Places of the paired siblings.  Of a long table every so many rows are kept and those between made again."""
        first, last = self.ends(xs, ys)
        found = [(k, k) for k in range(first)] + [(len(xs) - k, len(ys) - k) for k in range(1, last + 1)]
        xs, ys = xs[first : len(xs) - last], ys[first : len(ys) - last]
        if not xs or not ys:
            return found
        for x in set(xs):
            for y in set(ys):
                if self.tags[x] == self.tags[y]:
                    self.weight(x, y)
        step = math.isqrt(len(xs)) + 1
        held = [row for i, row in enumerate(self.rows(xs, ys)) if i % step == 0]
        j = len(ys)
        for begin in range((len(xs) - 1) // step * step, -1, -step):
            part = xs[begin : begin + step]
            rows = list(self.rows(part, ys, held[begin // step]))
            i = len(part)
            while i and j:
                p, q = part[i - 1], ys[j - 1]
                if self.tags[p] == self.tags[q] and rows[i][j] == rows[i - 1][j - 1] + self.at(p, q):
                    i, j = i - 1, j - 1
                    found.append((first + begin + i, first + j))
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return found


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the heaviest set of equal-tag pairs that keeps parents and order, top down; equal texts weigh more."""
    matcher = Matcher(a, b)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = x.elements(), y.elements()
        if xs and ys:
            kinds = [matcher.kind[0][c.number] for c in xs], [matcher.kind[1][c.number] for c in ys]
            todo += [(xs[i], ys[j]) for i, j in matcher.siblings(*kinds)]
    return pairs


def content_nodes(page: Node, left_out: set[int], varying: dict[int, int]) -> list[Node]:
    """The elements with the page's varying text: all outermost articles and mains in page order, else where most of it meets."""
    todo, marked = [page], []
    while todo:
        node = todo.pop()
        if node.number in left_out:
            continue
        if node.tag in ("article", "main"):
            marked.append(node)
        else:
            todo += reversed(node.elements())
    if marked:
        return marked
    node = page
    while True:
        parts = [c for c in node.elements() if varying.get(c.number, 0) > 0]
        rich = [c for c in parts if varying[c.number] >= 0.8 * varying[node.number] and c.tag in BLOCK]
        if len(rich) != 1 or rich[0].tag in ("p", "pre", "table"):
            return [node]
        node = rich[0]


def blocks(node: Node, constant: set[int], left_out: set[int], strict: bool) -> list[str]:
    """Texts of the blocks under ``node`` in page order; ``strict`` leaves out blocks that are all template."""
    out: list[str] = []
    pending: list[tuple[str, bool]] = []

    def close() -> None:
        text = " ".join("".join(part for part, _ in pending).split())
        varies = any(part.strip() and not fixed for part, fixed in pending)
        pending.clear()
        if text and (varies or not strict):
            out.append(text)

    todo: list[tuple[Node | str | None, bool]] = []

    def open_up(at: Node) -> None:
        todo.extend((child, at.number in constant) for child in reversed(at.children))

    open_up(node)
    while todo:
        child, fixed = todo.pop()
        if child is None:
            close()
        elif isinstance(child, str):
            pending.append((child, fixed))
        elif child.tag == "br":
            pending.append((" ", True))
        elif child.number not in left_out:
            if child.tag in BLOCK:
                close()
                todo.append((None, False))
            open_up(child)
    close()
    return out


def main_text(page: Node, constant: set[int]) -> str:
    for believed in (True, False):
        left_out, varying = judge(page, constant, believed)
        nodes = content_nodes(page, left_out, varying)
        out = [text for node in nodes for text in blocks(node, constant, left_out, strict=True)]
        if not out and nodes[0].tag in ("article", "main"):
            # Nothing varies in it: the host repeats the article itself.
            out = [text for node in nodes for text in blocks(node, constant, left_out, strict=False)]
        if out:
            break
    return "\n".join(out)


def shape(page: Node) -> frozenset[int]:
    """The paths of the page's block elements, each as the hash of its parent's path and its tag."""
    found, todo = set(), [(page, 0)]
    while todo:
        node, path = todo.pop()
        if node.tag in BLOCK:
            path = int.from_bytes(hashlib.blake2b(b"%d %s" % (path, node.tag.encode(errors="replace")), digest_size=8).digest())
        found.add(path)
        todo += [(c, path) for c in node.elements()]
    return frozenset(found)


def alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b)


def chosen_references(sources: list[str]) -> list[str]:
    """The first page, then each time the page least like those chosen, while it is of another layout."""
    shapes = [shape(parse(source)) for source in sources]
    chosen = [0]
    while len(chosen) < LAYOUTS:
        nearness = [max(alike(s, shapes[c]) for c in chosen) for s in shapes]
        least = min(range(len(shapes)), key=nearness.__getitem__)
        if nearness[least] >= ALIKE:
            break
        chosen.append(least)
    return [sources[c] for c in chosen]


class References:
    """Parsed reference pages, the latest ones only."""

    def __init__(self, most: int = 200):
        self.kept, self.most = OrderedDict(), most

    def __call__(self, source: str) -> tuple[Node, frozenset]:
        if source not in self.kept:
            page = parse(source)
            self.kept[source] = (page, shape(page))
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[source]

    def nearest(self, page: Node, sources: list[str]) -> tuple[int, Node]:
        """Number and tree of the reference most like the page."""
        if len(sources) == 1:
            return 0, self(sources[0])[0]
        own = shape(page)
        best = max(range(len(sources)), key=lambda i: (alike(own, self(sources[i])[1]), -i))
        return best, self(sources[best])[0]


def _counted(aligned: DataFrame) -> DataFrame:
    """(host, layout, node, seen, same) sums of each task's pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference = References()
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            for host, source, refs in zip(batch["host"], batch["html"], batch["refs"]):
                page = parse(source)
                layout, ref = reference.nearest(page, refs)
                for r, p in match_trees(ref, page):
                    count = sums.setdefault((host, layout, r.number), [0, 0])
                    count[0] += 1
                    count[1] += r.own_text() == p.own_text() and r.attributes == p.attributes
            rows = [(*place, seen, same) for place, (seen, same) in sums.items()]
            yield pd.DataFrame(rows, columns=["host", "layout", "node", "seen", "same"])

    return aligned.mapInPandas(run, "host string, layout int, node int, seen long, same long")


def _referenced(sampled: DataFrame) -> DataFrame:
    """(host, refs) from (host, pages), which are pairs of digest and html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            refs = [chosen_references([p["html"] for p in sorted(pages, key=lambda p: p["digest"])]) for pages in batch["pages"]]
            yield pd.DataFrame({"host": batch["host"], "refs": refs})

    return sampled.mapInPandas(run, "host string, refs array<string>")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    A null or empty page has an empty text; pages without a host are judged by their own structure alone, as are layouts
    of fewer than MIN_PAGES pages besides the reference.  Pages of a host's further layouts beyond LAYOUTS are aligned with the most
    similar reference.  Repeated rows are each answered; other columns are ignored.  Nesting of any depth is walked without
    recursion, and long lists of siblings are matched in memory linear in their length; in the worst case, where hardly any two of
    their subtrees are alike, time grows with the product of the two pages' sizes.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    usable = rows.filter("html <> '' and host <> ''")
    digest = F.md5(F.col("html").cast("binary"))
    # One page for each of SAMPLED parts of the digests, whatever the number of the host's pages.
    part = F.pmod(F.xxhash64(digest), F.lit(SAMPLED)).alias("part")
    sampled = usable.groupBy("host", part).agg(F.min(digest).alias("digest"), F.min_by("html", digest).alias("html"))
    refs = durable(_referenced(sampled.groupBy("host").agg(F.collect_list(F.struct("digest", "html")).alias("pages"))))
    held_chars = F.aggregate("refs", F.lit(0).cast("long"), lambda total, ref: total + F.length(ref))
    size = refs.agg(F.coalesce(F.sum(held_chars), F.lit(0))).first()[0]
    small = size <= BROADCAST_CHARS
    # A reference's own copies would make its content look like template.
    others = usable.join(F.broadcast(refs) if small else refs, "host").filter(~F.array_contains("refs", F.col("html")))
    seen = _counted(others.select("host", "html", "refs"))
    sums = seen.groupBy("host", "layout", "node").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    held = sums.groupBy("host", "layout").agg(F.max("seen").alias("n_pages"), F.collect_list(F.struct("node", "seen", "same")).alias("nodes"))
    constant = F.transform(F.filter("nodes", lambda n: n["same"] >= TEMPLATE_SHARE * F.col("n_pages")), lambda n: n["node"])
    layouts = held.filter(F.col("n_pages") >= MIN_PAGES).select("host", F.struct("layout", constant.alias("constant")).alias("layout"))
    wrappers = durable(refs.join(layouts.groupBy("host").agg(F.collect_list("layout").alias("layouts")), "host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference = References()
        for batch in batches:
            texts = []
            for source, refs, layouts in zip(batch["html"], batch["refs"], batch["layouts"]):
                page, same = parse(source if isinstance(source, str) else ""), set()
                if refs is not None:
                    layout, ref = reference.nearest(page, refs)
                    fixed = {n for held in layouts if held["layout"] == layout for n in held["constant"]}
                    if fixed:
                        same = {p.number for r, p in match_trees(ref, page) if r.number in fixed and r.own_text() == p.own_text()}
                texts.append(main_text(page, same))
            out = batch[["page_id", "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    joined = rows.join(F.broadcast(wrappers) if small else wrappers, "host", "left").select("page_id", "url", "html", "refs", "layouts")
    kind = pages.schema[page_id].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
