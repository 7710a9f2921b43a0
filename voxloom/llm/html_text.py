"""Main text of web pages by wrapper induction (operator 4).

The most frequent page shapes of a host are aligned by simple tree matching and merged into the host's
skeleton. Every page of the host is then aligned with it, and the texts at each node are counted over
all pages: texts that stand on most pages are template, nodes whose text varies are slots, and the slots with
the running text are the host's content slots. Every page is aligned once more and gives the text of those
slots, without template and without the parts that markup names as menus, adverts, forms, comments and the like.
A host's other shapes are dealt into groups, each with a skeleton, template and slots of its own beside the host's.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import free_name, give_back, stage, table

SHAPES = 12  # most frequent shapes of a host's pages, of which one page each makes the skeleton; its other shapes are in groups of about so many
SENT_BYTES = 16_000_000  # skeletons or wrappers together, up to which they are broadcast; beyond, a shuffled join
SENT = 1_000_000  # most rows of keys that are broadcast
SENT_HOSTS = 50_000  # most hosts with further shapes that are broadcast
MIN_PAGES, MOST = 3, 0.7  # different pages, and part of the pages with the node, on which a text is template
DEEPEST = 150  # levels; deeper elements count as their ancestor at this level
CELLS = 100_000  # pairs of children aligned at once; longer stretches that differ are cut in proportion
HELD = 100_000  # counts that a task holds before it sends them

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

# Element names of HTML, as the standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROP = frozenset("head script style noscript template iframe svg math canvas object embed audio video nav aside footer form button select option textarea input label menu dialog".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"} | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name parts which are not the article, and words that say nothing next to them. A name counts
# if it holds one of the former and nothing but these: "related-posts" does, "related-work" or "comment-policy-article" does not.
BOILERPLATE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations comment comments disqus discussion pagination pager search complementary contentinfo skip".split()
)
BESIDE = frozenset(
    "site page slot bar box list top bottom left right wrapper wrap container block area inner outer item items post posts article articles link links form unit text row col column section panel main global primary secondary header head foot icon button btn count fixed sticky mobile desktop small large mini full is has more latest popular content body author thread reply replies reader readers user users visitor visitors group view region module zone first last odd even depth level by on in and the".split()
)
JUNK = "~"  # stands among the words of an element that such a name marks
COMMENT = "~~"  # and of one that is an item of an unnamed thread of comments
THREAD, BEFORE, HEAD = 3, 200, 60  # least items of an unnamed thread of comments, code points of running text before it, and most of an item's head
RUNNING = frozenset("p blockquote pre ul ol dl table".split()) | HEADINGS
NAMED = (1.0, 1.5, 2.0)  # weight of text in a node that no name, main or article marks
SHARE = 0.2  # of the best slot's score that makes another node a slot
CONTENT = frozenset("article content post entry story main body text".split())


class Node:
    __slots__ = ("tag", "words", "kids", "up", "off", "level")

    def __init__(self, tag, words, up, off, level):
        self.tag, self.words, self.kids, self.up, self.off, self.level = tag, words, [], up, off, level


def _attributes(tag: str, raw: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role, and whether the element is not shown."""
    words, off = [], False
    if raw and not raw.isspace():
        for m in _NAMED.finditer(raw):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                off = True
            elif name in ("class", "id", "role", "itemprop"):
                words += [w.lower() for w in _SPLIT.split(value) if w]
                if name != "itemprop" and any(map(_is_junk, value.split())) and JUNK not in words:
                    words.append(JUNK)
    return tuple(words), off


@lru_cache(maxsize=10_000)
def _is_junk(name: str) -> bool:
    parts = [w for w in (re.sub(r"[0-9]+", "", w.lower()) for w in _SPLIT.split(name)) if len(w) > 1]
    return any(w in BOILERPLATE for w in parts) and all(w in BOILERPLATE or w in BESIDE for w in parts)


def parse(page: str) -> Node:
    """A tree of the page; kids are nodes and strings (raw text, references not yet decoded)."""
    root = cur = Node("#", (), None, False, 0)
    at, n, text = 0, len(page), page
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            cur.kids.append(text[at:])
            break
        if m.start() > at:
            cur.kids.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            x = cur
            while x.up is not None and x.tag != tag:
                x = x.up
            if x.up is not None:
                cur = x.up
            elif tag == "br" or tag == "p":
                cur.kids.append(Node(tag, (), cur, False, cur.level + 1))
            continue
        raw = m[3] if m[2] else m[6]
        if tag in ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            cur = _implied_end(cur, tag)
        words, off = _attributes(tag, raw)
        node = Node(tag, words, cur, off, cur.level + 1)
        cur.kids.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if node.level <= DEEPEST:
            cur = node
    _mark_threads(root)
    return root


def _texts(node: Node) -> str:
    """All text under a node that may be content, references not decoded."""
    out, stack = [], [iter(node.kids)]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
        elif isinstance(k, str):
            out.append(k)
        elif not _no_content(k):
            stack.append(iter(k.kids))
    return " ".join(" ".join(out).split())


def _comment_head(item: Node) -> str | None:
    """The short first part of an item that has more text in a part of its own; None if it is not made so."""
    parts = [(k, t) for k in item.kids if isinstance(k, Node) and (k.tag in BLOCK or k.tag in ("b", "strong", "span", "a", "i", "em", "small", "cite", "time")) and (t := _texts(k))]
    if len(parts) < 2 or any(isinstance(k, str) and not k.isspace() for k in item.kids):
        return None
    head, body = parts[0], parts[1:]
    if head[0].tag in HEADINGS or len(head[1]) > HEAD or not any(k.tag in BLOCK and len(t) >= len(head[1]) for k, t in body):
        return None
    return re.sub(r"[0-9]+", "#", head[1].lower())


def _last_alike(node: Node, first: Node) -> list[Node]:
    """The elements of one name at the end of a node, not before ``first``; none if text stands between them."""
    items: list[Node] = []
    for x in reversed(node.kids):
        if isinstance(x, str):
            if not x.isspace() and x:
                break
        elif x.tag not in ("br", "hr", "script") and not _no_content(x):
            if x.tag not in ("div", "li", "section", "article") or (items and (x.tag, x.words) != (items[-1].tag, items[-1].words)):
                break
            items.append(x)
        if x is first:
            break
    return items[::-1]


def _mark_threads(root: Node) -> None:
    """Mark readers' comments that no name gives away: after running text, siblings of one shape with a short head that varies.

    They stand last in their parent. Plain paragraphs, lists with words in bold, and items under headings are
    not made so; items whose heads only count (step 1, step 2) are content.
    """
    seen, stack, looked = 0, [(root, iter(root.kids))], set()
    while stack:
        node, kids = stack[-1]
        k = next(kids, None)
        if k is None:
            stack.pop()
            continue
        if isinstance(k, str):
            if any(n.tag in RUNNING for n, _ in stack[-2:]):
                seen += len(k.strip())
            continue
        if _no_content(k):
            continue
        if seen >= BEFORE and id(node) not in looked:
            looked.add(id(node))
            items = _last_alike(node, k)
            heads = [_comment_head(x) for x in items] if len(items) >= THREAD else []
            if heads and None not in heads and len(set(heads)) >= max(THREAD, 0.3 * len(heads)):
                for x in items:
                    x.words = (*x.words, COMMENT)
            if COMMENT in k.words:
                continue
        stack.append((k, iter(k.kids)))


def _implied_end(cur: Node, tag: str) -> Node:
    """The element in which ``tag`` opens, after what it ends without an end tag."""
    ends, stop = {
        "li": ({"li"}, {"ul", "ol", "menu"}),
        "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"}),
    }.get(tag, ({"p"}, {"table", "td", "th", "button"}))
    x, out = cur, cur
    while x.up is not None and x.tag not in stop:
        if x.tag in ends:
            out = x.up
            if tag not in ("tr",):
                break
        elif tag in ENDS_P and x.tag in BLOCK and x.tag != "p":
            break
        x = x.up
    return out


def _has(node: Node, tags) -> bool:
    stack = [node]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node):
                if k.tag in tags:
                    return True
                stack.append(k)
    return False


def _no_content(node: Node) -> bool:
    if node.tag in DROP or node.off or COMMENT in node.words:
        return True
    if JUNK not in node.words or node.tag in ("html", "body", "main", "#"):
        return False
    if node.tag == "article":  # a comment in an article
        up = node.up
        while up is not None and up.tag != "article":
            up = up.up
        return up is not None
    return not _has(node, ("article", "main"))


def _is_header(node: Node) -> bool:
    return node.tag == "header" or (node.tag in ("div", "section", "hgroup") and "header" in node.words)


def _blocks(node: Node, out: list[list[str]], header: bool = False, inside: bool = False) -> None:
    """Text runs of the block elements under ``node``; of a header only its headings."""
    for k in node.kids:
        if isinstance(k, str):
            if not header or inside:
                out[-1].append(k)
        elif k.tag == "br":
            out[-1].append(" ")
        elif not _no_content(k):
            is_block = k.tag in BLOCK
            if is_block:
                out.append([])
            _blocks(k, out, header or (_is_header(k) and not _has(k, ("article", "main"))), inside or k.tag in HEADINGS)
            if is_block:
                out.append([])


def _clean(run: list[str]) -> str:
    s = "".join(run)
    if "&" in s:
        s = html_lib.unescape(s)
    return _SPACE.sub(" ", s).strip()


def block_texts(node: Node) -> list[str]:
    out: list[list[str]] = [[]]
    _blocks(node, out)
    return [t for run in out if (t := _clean(run))]


class Group:
    """Sibling elements of one shape: a repeated node of the aligned trees."""

    __slots__ = ("key", "kids", "members", "sig", "size")

    def __init__(self, key, kids, members):
        self.key, self.kids, self.members = key, kids, members
        self.sig = hash((key, *(k.sig for k in kids)))
        self.size = 1 + sum(k.size for k in kids)


def grouped(node: Node) -> Group:
    """The tree with runs of equally shaped siblings as one node; block elements only."""
    kids: list[Group] = []
    for k in node.kids:
        if isinstance(k, Node) and (k.tag in BLOCK or k.tag in DROP) and k.tag not in ("script", "style"):
            g = grouped(k)
            if kids and kids[-1].sig == g.sig:
                _join(kids[-1], g)
            else:
                kids.append(g)
    return Group((node.tag, " ".join(node.words)), kids, [node])


def _join(a: Group, b: Group) -> None:
    a.members += b.members
    for x, y in zip(a.kids, b.kids, strict=True):
        _join(x, y)


class Match:
    """Simple tree matching of trees: the largest order-keeping map between nodes of equal names.

    Children of equal shape at either end are paired at once, which loses nothing; scores are kept by
    shape. Where more than ``CELLS`` pairs of children are left, both sides are cut in proportion.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: Group, b: Group) -> int:
        if a.key != b.key:
            return 0
        if a.sig == b.sig:
            return a.size
        if (got := self.known.get((a.sig, b.sig))) is None:
            got = self.known[a.sig, b.sig] = 1 + sum(self.score(a.kids[i], b.kids[j]) for i, j in self.children(a.kids, b.kids))
        return got

    def children(self, xs: list[Group], ys: list[Group]) -> list[tuple[int, int]]:
        """Pairs (i, j) of children that the largest map pairs, in order."""
        n, m, s = len(xs), len(ys), 0
        while s < min(n, m) and xs[s].sig == ys[s].sig:
            s += 1
        head = [(i, i) for i in range(s)]
        tail = []
        while n > s and m > s and xs[n - 1].sig == ys[m - 1].sig:
            n, m = n - 1, m - 1
            tail.append((n, m))
        parts = -(-(n - s) * (m - s) // CELLS) if n > s and m > s else 0
        parts = max(1, int(np.ceil(np.sqrt(parts)))) ** 2 if parts > 1 else parts
        for k in range(parts):
            i, j = (s + (z - s) * k // parts for z in (n, m))
            p, q = (s + (z - s) * (k + 1) // parts for z in (n, m))
            head += [(i + x, j + y) for x, y in self._table(xs[i:p], ys[j:q])]
        return head + tail[::-1]

    def _table(self, xs: list[Group], ys: list[Group]) -> list[tuple[int, int]]:
        n, m = len(xs), len(ys)
        part = [[self.score(x, y) for y in ys] for x in xs]
        w = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            row, up, here = part[i], w[i], w[i + 1]
            for j in range(m):
                here[j + 1] = max(up[j + 1], here[j], up[j] + row[j])
        out, i, j = [], n, m
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def pairs(self, a: Group, b: Group) -> list[tuple[Group, Group]]:
        out, stack = [], [(a, b)] if a.key == b.key else []
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            stack += [(x.kids[i], y.kids[j]) for i, j in self.children(x.kids, y.kids)]
        return out

    def merged(self, a: Group, b: Group) -> Group:
        """``a`` with what only ``b`` has put in where it stands among its siblings."""
        if a.sig == b.sig:
            return a
        kids, i, j = [], 0, 0
        for p, q in [*self.children(a.kids, b.kids), (len(a.kids), len(b.kids))]:
            kids += a.kids[i:p] + b.kids[j:q]
            if p < len(a.kids):
                kids.append(self.merged(a.kids[p], b.kids[q]))
            i, j = p + 1, q + 1
        return Group(a.key, kids, a.members)


def tree_match(a: Group, b: Group) -> tuple[int, list[tuple[Group, Group]]]:
    """Score and pairs of the largest map between two trees."""
    m = Match()
    return m.score(a, b), m.pairs(a, b)


def _walk(g: Group, path=(), off=False):
    """(path, group, whether it or what holds it is no content), in page order."""
    off = off or _no_content(g.members[0])
    yield path, g, off
    for i, k in enumerate(g.kids):
        yield from _walk(k, (*path, i), off)


def _own_texts(g: Group) -> list[tuple[Node, str]]:
    """Of each of the group's elements the text that stands in itself, not in block elements below it."""
    out = []
    for m in g.members:
        run: list[str] = []
        stack = [iter(m.kids)]
        while stack:
            k = next(stack[-1], None)
            if k is None:
                stack.pop()
            elif isinstance(k, str):
                run.append(k)
            elif k.tag not in BLOCK and k.tag not in DROP:
                stack.append(iter(k.kids))
        if t := _clean(run):
            out.append((m, t))
    return out


def _named(g: Group) -> int:
    """2 for an article, 1 for a main part, by tag or class; else 0."""
    tag, words = g.members[0].tag, g.members[0].words
    if tag == "article" or "articlebody" in "".join(words):
        return 2
    return int(tag == "main" or "main" in words and tag in ("div", "section"))


def _content_slots(tree: Group, chars: dict[int, int]) -> set[int]:
    """Numbers (in page order) of the nodes with the most varying running text; what markup names as the article has a bonus.

    The best node goes first, with every article if it is one; then those that have, outside of the
    chosen ones, ``SHARE`` of its score.
    """
    up, nodes, total = [], [], []

    def add(g: Group, parent: int, off: bool) -> None:
        off = off or _no_content(g.members[0])
        me = len(nodes)
        up.append(parent)
        nodes.append((g, off))
        total.append(0 if off else chars.get(me, 0))
        for k in g.kids:
            add(k, me, off)

    add(tree, -1, False)
    own = list(total)
    run = list(total)  # what stands in the node and in running-text elements right below it
    for i in range(len(nodes) - 1, 0, -1):
        total[up[i]] += total[i]
        if nodes[i][0].key[0] in RUNNING:
            run[up[i]] += total[i]

    def score(i: int) -> float:
        if kind := _named(nodes[i][0]):
            return total[i] * NAMED[kind]
        return run[i] * (1.25 if CONTENT.intersection(nodes[i][0].members[0].words) else 1.0)

    def choose(i: int) -> None:
        taken, end = total[i], i + nodes[i][0].size
        for k in range(i, end):
            total[k] = run[k] = own[k] = 0
        k, running = up[i], nodes[i][0].key[0] in RUNNING
        while k >= 0:
            total[k] -= taken
            run[k] -= taken if running else 0
            running = nodes[k][0].key[0] in RUNNING
            k = up[k]

    left = [i for i, (g, off) in enumerate(nodes) if not off and g.key[0] != "#" and total[i]]
    slots: set[int] = set()
    first = 0.0
    while left:
        best = max(left, key=lambda i: (score(i), -i))
        top = score(best)
        if top <= 0 or top < SHARE * first:
            break
        found = [best]
        if not slots:
            first = top
            if _named(nodes[best][0]) == 2:
                found = [i for i in left if _named(nodes[i][0]) == 2]
        for i in found:
            if total[i]:
                slots.add(i)
                choose(i)
        left = [i for i in left if score(i) >= SHARE * first]
    return slots


def _outermost(nodes: list[Node]) -> list[Node]:
    """``nodes`` in page order, without those that another one holds."""
    if len(nodes) < 2:
        return nodes
    wanted, out, root = {id(x) for x in nodes}, [], nodes[0]
    while root.up is not None:
        root = root.up
    stack = [root]
    while stack:
        x = stack.pop()
        if id(x) in wanted:
            out.append(x)
        else:
            stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def skeleton(pages: list[str]) -> str | None:
    """The merged tree of some pages, as JSON."""
    trees = sorted(((t := grouped(parse(p))).size, p, t) for p in set(pages))
    if not trees:
        return None
    m, base = Match(), trees[-1][2]
    for _, _, t in trees[-2::-1]:
        base = m.merged(base, t)

    def plain(g):
        return [*g.key, [plain(k) for k in g.kids]]

    return json.dumps(plain(base))


class Skeleton:
    """A host's tree. Siblings of one name share a pool of texts, numbered as the first of them is in page order."""

    def __init__(self, text: str):
        self.number: dict[int, int] = {}
        self.pool: dict[int, dict[tuple, int]] = {}
        self.match = Match()
        self.tree = self._build(json.loads(text))
        self._count(self.tree)

    def _build(self, x) -> Group:
        return Group((x[0], x[1]), [self._build(k) for k in x[2]], [Node(x[0], tuple(x[1].split()), None, False, 0)])

    def _count(self, g: Group) -> None:
        self.number[id(g)] = len(self.number)
        pools = self.pool[id(g)] = {}
        for k in g.kids:
            pools.setdefault(k.key, len(self.number))
            self._count(k)

    def aligned(self, tree: Group) -> tuple[list[tuple[int, Group]], list[tuple[int, Group]]]:
        """Of a page: (number, group) of the matched nodes, and (pool, group) of all whose parent is matched."""
        if self.tree.key != tree.key:
            return [], []
        if len(self.match.known) > HELD:
            self.match = Match()
        pairs = self.match.pairs(self.tree, tree)
        pooled = [(0, tree)]
        for a, b in pairs:
            pools = self.pool[id(a)]
            pooled += [(pools[k.key], k) for k in b.kids if k.key in pools]
        return [(self.number[id(a)], b) for a, b in pairs], pooled


@lru_cache(maxsize=64)
def _skeleton(text: str) -> Skeleton:
    return Skeleton(text)


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def observed(skel: Skeleton, page: str, wrapper: str | None = None) -> dict[tuple[int, int | None], int]:
    """Of one page: (pool, text hash) -> code points, and (pool, None) -> 0 for each pool that it has; without what ``wrapper`` knows as template."""
    out: dict[tuple[int, int | None], int] = {}
    tree = grouped(parse(page))
    fixed = _wrapper(wrapper).content(tree)[1] if wrapper else ()
    for pool, g in skel.aligned(tree)[1]:
        out[pool, None] = 0
        for m, t in _own_texts(g):
            if id(m) not in fixed:
                out[pool, _hashed(t)] = len(t)
    return out


def finished(text: str, stats: list[tuple[int, int, list[int]]]) -> str | None:
    """The wrapper of a skeleton and its (pool, varying code points, template texts); it may have no content slot."""
    skel = _skeleton(text)
    slots = _content_slots(skel.tree, {pool: chars for pool, chars, _ in stats})
    return json.dumps([text, sorted(slots), {pool: fixed for pool, _, fixed in stats if fixed}])


def is_template(pages_with_text: float, pages_with_node: float) -> bool:
    return pages_with_text >= MIN_PAGES - 1e-6 and pages_with_text >= MOST * pages_with_node - 1e-6


def induce(pages: list[str]) -> str | None:
    """Wrapper of one host from its pages: what the Spark job does, for a few pages at hand."""
    text = skeleton(pages)
    if text is None:
        return None
    times: dict[tuple, int] = {}
    size: dict[tuple, int] = {}
    for page in set(pages):
        got = observed(_skeleton(text), page)
        size |= got
        for k in got:
            times[k] = times.get(k, 0) + 1
    stats: dict[int, tuple[int, int, list[int]]] = {}
    for (pool, h), n in times.items():
        _, chars, fixed = stats.setdefault(pool, (pool, 0, []))
        if h is not None:
            same = is_template(n, times[pool, None])
            stats[pool] = (pool, chars + (0 if same else n * size[pool, h]), fixed + [h] * same)
    return finished(text, sorted(stats.values()))


class Wrapper:
    def __init__(self, text: str):
        skel, slots, fixed = json.loads(text)
        self.skel, self.slots = _skeleton(skel), frozenset(slots)
        self.fixed = {int(k): frozenset(v) for k, v in fixed.items()}

    def content(self, tree: Group) -> tuple[list[Node], set[int]]:
        """The page's elements in the content slots, and elements whose own text is template."""
        matched, pooled = self.skel.aligned(tree)
        found = [m for n, g in matched if n in self.slots for m in g.members]
        fixed = {id(m) for pool, g in pooled if pool in self.fixed for m, t in _own_texts(g) if _hashed(t) in self.fixed[pool]}
        return found, fixed


@lru_cache(maxsize=64)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(text)


def extract(page: str, wrapper: str | None, other: str | None = None) -> str:
    """Main text of a page: its content slots by the wrapper, or by the same choice on the page alone, without what the wrapper knows as template.

    ``other`` is the wrapper of the page's group of further shapes; the slots and the template of both count.
    """
    tree = grouped(parse(page))
    nodes, fixed = [], set()
    for w in (wrapper, other):
        if w:
            slots, known = _wrapper(w).content(tree)
            nodes, fixed = nodes + slots, fixed | known
    if not nodes:
        groups = [g for _, g, _ in _walk(tree)]
        slots = _content_slots(tree, {i: sum(len(t) for m, t in _own_texts(g) if id(m) not in fixed) for i, g in enumerate(groups)})
        nodes = [m for i in sorted(slots) for m in groups[i].members] or tree.members[:1]
    out = []
    for node in _outermost(nodes):
        if fixed:
            if id(node) in fixed:
                node.kids = [x for x in node.kids if isinstance(x, Node) and x.tag in BLOCK]
            _cut(node, fixed)
        out += block_texts(node)
    return "\n".join(out)


def _cut(node: Node, fixed: set[int]) -> None:
    """Take the text of template elements out of a slot."""
    for k in node.kids:
        if isinstance(k, Node):
            if id(k) in fixed:
                k.kids = [x for x in k.kids if isinstance(x, Node) and x.tag in BLOCK]
            _cut(k, fixed)


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _shape(html_col: str):
    """A hash of the names and classes of a page's structural elements, digits apart, each once."""
    tags = F.regexp_extract_all(F.lower(F.col(html_col)), F.lit(r"""<(?:div|section|article|main|header|footer|nav|aside|form|table)\b(?:[^>]{0,200}?\bclass\s*=\s*["']?[^"'>]*)?"""), F.lit(0))
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, r"\s+(?!class)[a-z-]+\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)|[0-9]+", "")))), " "))


def _with_texts(rows: DataFrame, small: DataFrame, on: list[str], size: int, how: str) -> DataFrame:
    """Join pages with a row for each host; sent to every task where it is small enough."""
    return rows.join(F.broadcast(small) if size <= SENT_BYTES else small, on, how)


def _bytes(made: DataFrame) -> int:
    return made.agg(F.sum(F.length(made.columns[-1]) + F.length("host"))).head()[0] or 0


def _sent(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= SENT_HOSTS else hosts


def _group(shape: F.Column, tops: str, groups: str) -> F.Column:
    """The group of a shape of a host: 0 for the most frequent ones, and for all where a host has no others."""
    return F.when(F.col(groups).isNull(), 0).otherwise(F.transform(F.array(shape), lambda s: F.when(F.array_contains(F.col(tops), s), 0).otherwise(1 + F.pmod(F.xxhash64(s), F.col(groups))))[0]).cast("long")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", shapes: int = SHAPES) -> tuple[DataFrame, DataFrame | None]:
    """(host, part, wrapper) of every host and group of its shapes, and (host, tops, groups) of hosts with more than ``shapes`` shapes, if there are any.

    The skeleton of part 0 merges one page of each of a host's ``shapes`` most frequent shapes. The texts at its nodes are
    counted over all of the host's pages, equal pages as one; tasks sum their counts before they are dealt out by host, node
    and text, so a host with a third of all pages is no hot key. All other shapes of a host are dealt by hash into groups of about
    ``shapes``. Part k merges one page of each shape of group k and counts over that group's pages what part 0 does not know as template.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    h = F.xxhash64("html").alias("h")
    keys = stage(rows.select("host", h, _shape("html").alias("shape")).groupBy("host", "h").agg(F.min("shape").alias("shape"), F.count(F.lit(1)).alias("n")), "page-keys")
    by_shape = keys.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.min("h").alias("h"))
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "h"))  # only the first rows of a host are dealt out
    chosen = stage(by_shape.withColumn("nth", nth).where(F.col("nth") <= shapes).select("host", F.lit(0).cast("long").alias("part"), "shape", "h"), "page-shapes")
    more = by_shape.groupBy("host").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > shapes)
    more = more.join(chosen.groupBy("host").agg(F.collect_list("shape").alias("tops")), "host").select("host", "tops", F.ceil((F.col("all") - shapes) / shapes).alias("groups"))
    more = stage(more, "page-groups")
    if more.take(1):
        rest = by_shape.join(_sent(more), "host").withColumn("part", _group(F.col("shape"), "tops", "groups")).where("part > 0")
        chosen = stage(chosen.unionByName(rest.select("host", "part", "shape", "h")), "page-shapes")
    else:
        more = None
    few = chosen.count() <= SENT
    chosen = chosen.select("host", "h", "part")
    taken = rows.select("host", h, "html").join(F.broadcast(chosen) if few else chosen, ["host", "h"]).dropDuplicates(["host", "h"])

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"host": [group.column("host")[0].as_py()], "part": [group.column("part")[0].as_py()], "skeleton": pa.array([skeleton(group.column("html").to_pylist())], pa.string())})

    made = stage(taken.groupBy("host", "part").applyInArrow(merge, "host string, part long, skeleton string"), "skeletons")
    copies = stage(keys.where("n > 1").select("host", "h", "n"), "page-copies")
    few = copies.count() <= SENT
    each = rows.select("host", h, "html").join(F.broadcast(copies) if few else copies, ["host", "h"], "left").select("host", "html", (1.0 / F.coalesce("n", F.lit(1))).alias("w"))
    first = made.where("part = 0")
    found = _finished(_with_texts(each, first, ["host"], _bytes(first), "inner").withColumn("wrapper", F.lit(None).cast("string")), first)
    if more is None:
        return found, None
    found = stage(found, "wrappers")
    others = made.where("part > 0")
    each = each.join(_sent(more), "host").withColumn("part", _group(_shape("html"), "tops", "groups")).where("part > 0").select("host", "part", "html", "w")
    each = _with_texts(each, others, ["host", "part"], _bytes(others), "inner")
    known = found.where("wrapper is not null").select("host", "wrapper")
    each = _with_texts(each, known, ["host"], _bytes(known), "left")
    return found.unionByName(_finished(each, others)), more


def _finished(each: DataFrame, made: DataFrame) -> DataFrame:
    """(host, part, wrapper) of the skeletons ``made`` (host, part, skeleton), by pages (host, part, html, w, skeleton, wrapper that knows template already)."""

    def count(batches):
        held: dict[tuple, list] = {}

        def sent():
            cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["host", "part", "pool", "text", "chars", "w"])

        for b in batches:
            for host, part, page, w, skel, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for (pool, t), n in observed(_skeleton(skel), page, known).items():
                    x = held.setdefault((host, part, pool, t), [n, 0.0])
                    x[1] += w
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()
        give_back()

    counted = each.select("host", "part", "html", "w", "skeleton", "wrapper").mapInArrow(count, "host string, part long, pool long, text long, chars long, w double")
    counted = stage(counted.groupBy("host", "part", "pool", "text").agg(F.max("chars").alias("chars"), F.sum("w").alias("w")), "page-texts")
    held = counted.where("text is null").select("host", "part", "pool", F.col("w").alias("all"))
    same = (F.col("w") >= MIN_PAGES - 1e-6) & (F.col("w") >= MOST * F.col("all") - 1e-6)
    stats = counted.where("text is not null").join(held, ["host", "part", "pool"])
    stats = stats.groupBy("host", "part", "pool").agg(F.sum(F.when(same, 0).otherwise(F.col("chars") * F.col("w"))).cast("long").alias("chars"), F.collect_list(F.when(same, F.col("text"))).alias("fixed"))
    stats = stats.groupBy("host", "part").agg(F.array_sort(F.collect_list(F.struct("pool", "chars", "fixed"))).alias("stats"))  # a row a node

    def finish(batches):
        for b in batches:
            got = [finished(t, [(x["pool"], x["chars"], x["fixed"]) for x in s]) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["host", "part", "wrapper"])

    return made.join(stats, ["host", "part"]).select("host", "part", "skeleton", "stats").mapInArrow(finish, "host string, part long, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id``, ``url``, text and n_chars (code points) of every page.

    Null and empty html give an empty text; a null or odd url shares the wrapper of the empty host;
    repeated rows are extracted each, and count as one page; an empty table gives no rows; a host with one page, and a page that does not fit its host's
    wrapper, choose the slots on the page alone; other columns are not read, whatever their names. Pages of any length are
    read whole: time grows with a page's length, and elements more than ``DEEPEST`` levels deep count as part of the one at that level.
    Pages are not shuffled while the wrappers are small enough to broadcast.
    """
    made, more = wrappers(pages, url_col, html_col)
    made = stage(made.where("wrapper is not null"), "wrappers")
    host = free_name("host", pages)
    part, one, two, tops, groups = (f"{host}_{c}" for c in ("part", "wrapper", "other", "tops", "groups"))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), _host(url_col).alias(host))
    first, others = made.where("part = 0"), made.where("part > 0")
    rows = _with_texts(rows, first.select(F.col("host").alias(host), F.col("wrapper").alias(one)), [host], _bytes(first), "left")
    if more is None:
        rows = rows.withColumn(two, F.lit(None).cast("string"))
    else:
        rows = rows.join(_sent(more).toDF(host, tops, groups), host, "left").withColumn(part, _group(_shape(html_col), tops, groups))
        rows = _with_texts(rows, others.select(F.col("host").alias(host), F.col("part").alias(part), F.col("wrapper").alias(two)), [host, part], _bytes(others), "left")
    rows = rows.select(id_col, url_col, html_col, one, two)

    def run(batches):
        for b in batches:
            got = [extract(p, w, v) if p else "" for p, w, v in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=[id_col, url_col, "text", "n_chars"])
        give_back()

    out = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, out)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
