"""HTML extraction by union-free regular-expression wrappers, one for each host.

All pages of each host become trees of blocks, which are aligned one after another: first the pages of each task, by host, and then
the wrappers that tasks found. Texts are not shuffled for it. What differs is resolved into repeated groups (a run of like siblings, or a run of like sequences of siblings, counts as one that repeats),
optional groups (a node that some page lacks) and text slots. A slot whose text is the same wherever it occurs, optional or not,
is part of the template, if the pages that have it are otherwise different articles; a repeated group that is mostly links is
navigation. Names tell roles: outside the article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments),
inside it, or undecided. Every page is then aligned with its host's wrapper and keeps the text inside, without the template's
texts (a slot goes only where its text is the template's) and without navigation, also within an article. Of a repeated group, whose members
share a slot, those texts are the template's that nine in ten of the pages with the group carry, GROUPED different articles at least. Optional groups whose
text differs are data and stay. A node that the wrapper does not have is judged by its names alone.

Pages are different articles for a slot by their three longest other blocks: at least DIFFERENT texts in two of the three places.
So copies of a page, or copies with one edited block, do not make a template of what they share. (Where three or more longer
template blocks outweigh every block of the articles, they are taken for such copies, and the template's text stays.)

Character references are decoded, white space inside a block is one space, blocks are joined by a line feed in page order.
Null or empty html gives the empty text, as does a page without any text of its own; null urls share one host. Repeated rows
are pages of their own. Pages may nest to any depth and be of any length. A host with one page has that page as its wrapper. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections import deque
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate, zip_longest

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small, stored

#: Pages of a task after which the wrappers found so far are given out, and wrappers of a host that are merged at once.
PAGES, MERGED = 20_000, 64
#: Articles that have to differ before what they share is the template's, and repeated links are navigation; and before a text of a group is, as
#: a group offers many texts to be alike by chance.
DIFFERENT, GROUPED = 3, 6
#: Texts that the slot of a group remembers; beyond twice as many the rarest go, of equally rare ones those of the greatest hashes.
TEXTS = 64
#: Bits of the table of one alignment; longer sequences of siblings are cut in two where a longest common subsequence may be cut.
TABLE = 1 << 28
#: Bytes of all wrappers up to which every task holds them.
HELD_BYTES = 32 << 20
#: Pages of a host that one task reads beside its wrapper.
CELL_PAGES = 5_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
OUTSIDE = set("nav footer aside form button select option datalist fieldset dialog menu noscript template svg canvas object audio video map head".split())
ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words of class, id or label that name what is not the article.
WORDS_OUT = set(
    "nav navbar navigation menu menubar footer sidebar sidenav aside ad ads advert adverts advertisement advertising adsense banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices notification alert disclaimer comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination "
    "pager toolbar widget widgets popup modal overlay search skip masthead topbar copyright legal paywall".split()
)
WORDS_TOP = {"header", "head", "top"}
WORDS_IN = {"content", "article", "post", "entry", "story", "maincontent", "articlebody"}
CLOSES = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}


class El:
    """A block of a page: its tag, its signature, whether it is named as outside (x) or inside (m), and its parts: (text, in a
    link), blocks, or None for a break."""

    __slots__ = ("deeper", "kids", "role", "sig", "tag")

    def __init__(self, tag: str, sig: str = "", role: str = ""):
        self.tag, self.sig, self.role, self.kids, self.deeper = tag, sig or tag, role, [], 0


def _named(tag: str, attributes: str) -> tuple[str, str]:
    """Signature and role by the element's own name and attributes. Elements of different roles are never alike."""
    words: list[str] = []
    sig, role = tag, ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words += [w.lower() for w in _WORD.findall(value)]
                sig += f".{' '.join(sorted(re.sub(r'[0-9]+', '', value).split()))}" if value else ""
            elif key == "aria-label":
                words += [w.lower() for w in _WORD.findall(value)][:2]
            elif key == "role":
                role = "x" if value.lower() in ROLES_OUT else "m" if value.lower() in ("main", "article") else role
            elif key == "itemprop" and value.lower() == "articlebody":
                role = role or "m"
            elif (key == "hidden" and value in ("", "hidden")) or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                role = "x"
    if tag in OUTSIDE or (tag not in ("body", "html", "main") and not WORDS_OUT.isdisjoint(words)):
        role = "x"
    elif tag == "header" or (tag in ("div", "section") and not WORDS_TOP.isdisjoint(words)):
        role = role or "h"
    elif tag in ("article", "main"):
        role = role or "m"
    elif not WORDS_IN.isdisjoint(words) and tag in ("div", "section", "td"):
        role = role or "c"
    return f"{sig}!{role}" if role else sig, role


def parse(html: str) -> El:
    root = El("#root")
    stack, links, pos, n = [root], 0, 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        if m is None:
            stack[-1].kids.append((html[pos:], links > 0))
            break
        if m.start() > pos:
            stack[-1].kids.append((html[pos : m.start()], links > 0))
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), m[1], m[3]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[i].deeper:
                        stack[i].deeper -= 1
                    else:
                        del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(None)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].kids.append(None)
            continue
        if tag == "a":
            links = 1
        if tag in INLINE:
            sig, role = _named(tag, attributes) if attributes else (tag, "")
            if role == "x":
                stack.append(El(tag, sig, role))
                stack[-2].kids.append(stack[-1])
            elif stack[-1].tag == tag:
                stack[-1].deeper += 1
            continue
        while stack[-1].tag == "p" or (stack[-1].tag in INLINE and len(stack) > 1):
            stack.pop()
        links = 0
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("td", "th") and stack[i].tag in ("td", "th")) or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")):
                    del stack[i:]
                    break
                if stack[i].tag in CLOSES[tag]:
                    break
        el = El(tag, *_named(tag, attributes))
        stack[-1].kids.append(el)
        if attributes.rstrip().endswith("/") and tag not in ("p", "div", "li"):
            continue
        stack.append(el)
    return root


def own_text(el: El) -> str:
    return " ".join("".join([k[0] for k in el.kids if isinstance(k, tuple)]).split())


def hashed(text: str) -> int:
    """Of a text; 0 of none."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little") if text else 0


def longest(root: El) -> list[int]:
    """Hashes of the four longest different texts of a page that are not named as outside."""
    texts: set[str] = set()
    stack = [root]
    while stack:
        el = stack.pop()
        texts.add(own_text(el))
        stack += [k for k in el.kids if isinstance(k, El) and k.role != "x"]
    return [hashed(t) for t in sorted(texts - {""}, key=lambda t: (-len(t), t))[:4]]


class Node:
    """A node of a wrapper. others: of the pages with this node, the texts (GROUPED at most) in each of the three places of
    their longest other blocks."""

    __slots__ = ("chars", "const", "kids", "link", "opt", "others", "rep", "role", "seen", "sig", "text", "texts")

    def __init__(self, el: El, page: list[int]):
        self.sig, self.role, self.seen, self.opt, self.rep = el.sig, el.role, 1, False, False
        text = own_text(el)
        self.text, self.chars, self.const = hashed(text), len(text), True
        self.link = sum(len(k[0].strip()) for k in el.kids if isinstance(k, tuple) and k[1])
        self.others = [[h] for h in page if h != self.text][:3]
        self.texts: dict[int, list] = {self.text: [1, self.others]} if text else {}  # by text, the pages that have it and what others is to them
        self.kids: list[Node] = []

    def different(self) -> bool:
        """Whether different articles have this node."""
        return _different(self.others)

    def template(self) -> list[int]:
        """The texts that are the template's: of a group those that nine in ten of its pages have, of another node the only one."""
        if self.rep:
            return sorted(t for t, (seen, others) in self.texts.items() if 10 * seen >= 9 * self.seen and _different(others, GROUPED))
        return [self.text] if self.const and self.text and self.different() else []


def _different(others: list[list[int]], least: int = DIFFERENT) -> bool:
    return sum(len(hashes) >= least for hashes in others) >= 2


def _told(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """What the other blocks of two sets of pages are, GROUPED at most in each place."""
    if a == b or (all(len(hashes) >= GROUPED for hashes in a) and len(a) >= len(b)):
        return a
    return [[*x, *[h for h in y if h not in x][: GROUPED - len(x)]] for x, y in zip_longest(a, b, fillvalue=[])]


def _texts(a: dict[int, list], b: dict[int, list], one_page: bool) -> dict[int, list]:
    for t, (seen, others) in b.items():
        if t in a:
            had, known = a[t]
            a[t] = [max(had, seen) if one_page else had + seen, _told(known, others)]
        else:
            a[t] = [seen, others]
    if len(a) > 2 * TEXTS:
        return dict(sorted(a.items(), key=lambda x: (-x[1][0], x[0]))[:TEXTS])
    return a


#: Pairs of nodes still to be joined, in order: (node, node it also stands for, whether they are of one run). A queue takes the place of
#: recursion, so pages may nest as deep as they like.
Queue = deque[tuple[Node, Node, bool]]


def of_page(root: El, page: list[int]) -> Node:
    """The nodes of a page's blocks, with runs folded from the innermost blocks outwards."""
    top = Node(root, page)
    made, open_ = [top], [(root, top)]
    while open_:
        el, node = open_.pop()
        for k in el.kids:
            if isinstance(k, El):
                kid = Node(k, page)
                node.kids.append(kid)
                made.append(kid)
                open_.append((k, kid))
    for node in reversed(made):
        if len(node.kids) > 1:
            queue: Queue = deque()
            node.kids = folded(node.kids, queue)
            join_all(queue)
    return top


def joined(a: Node, b: Node, repeat: bool = False) -> Node:
    """a, now also standing for b: another page's node, or (repeat) another one of the same run."""
    join_all(deque([(a, b, repeat)]))
    return a


def join_all(queue: Queue) -> None:
    while queue:
        a, b, repeat = queue.popleft()
        a.const &= b.const and a.text == b.text
        a.others = _told(a.others, b.others)
        a.texts = _texts(a.texts, b.texts, repeat)
        a.chars += b.chars
        a.link += b.link
        a.rep |= b.rep or repeat
        a.opt |= b.opt
        a.seen = max(a.seen, b.seen) if repeat else a.seen + b.seen
        a.kids = aligned(a.kids, b.kids, repeat, queue)


def folded(nodes: list[Node], queue: Queue) -> list[Node]:
    """Runs of like nodes, then runs of like sequences of two to four nodes, as one that repeats."""
    for width in (1, 2, 3, 4):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * width and [x.sig for x in out[-width:]] == [x.sig for x in out[-2 * width : -width]]:
                last = out[-width:]
                del out[-width:]
                queue += [(a, b, True) for a, b in zip(out[-width:], last, strict=True)]
        nodes = out
    return nodes


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two sequences of signatures: what is alike at both ends, and one of what is between."""
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    inner = _longest(a[begin : len(a) - end], b[begin : len(b) - end])
    return [*((i, i) for i in range(begin)), *((begin + i, begin + j) for i, j in inner), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """By node of b, a number with a zero bit at each node of a where the longest common subsequence of what is read so far grows."""
    bits: dict[str, int] = {}
    for i, sig in enumerate(a):
        bits[sig] = bits.get(sig, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for sig in b:
        both = row & bits.get(sig, 0)
        row = ((row + both) | (row - both)) & every
        yield row


def _grown(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of b and each beginning of a."""
    row = deque(_rows(a, b), maxlen=1)[0]
    return [0, *accumulate(bit == "0" for bit in reversed(f"{row:0{len(a)}b}"))]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; what is longer than its table may be is cut in two, b in the middle."""
    if not a or not b:
        return []
    if len(b) == 1:
        return [(a.index(b[0]), 0)] if b[0] in a else []
    if len(a) * len(b) > TABLE:
        half = len(b) // 2
        both = [x + y for x, y in zip(_grown(a, b[:half]), reversed(_grown(a[::-1], b[half:][::-1])), strict=True)]
        cut = both.index(max(both))
        return _longest(a[:cut], b[:half]) + [(cut + i, half + j) for i, j in _longest(a[cut:], b[half:])]
    rows, pairs, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def aligned(a: list[Node], b: list[Node], repeat: bool, queue: Queue) -> list[Node]:
    """Two sequences of nodes as one: like nodes are joined along a common subsequence, all others are optional."""
    pairs = common([x.sig for x in a], [x.sig for x in b])
    queue += [(a[i], b[j], repeat) for i, j in pairs]
    if len(pairs) == len(a) == len(b):
        return a
    out: list[Node] = []
    at = to = 0
    for i, j in [*pairs, (len(a), len(b))]:
        for x in (*a[at:i], *b[to:j]):
            x.opt = True
            out.append(x)
        out += a[i : i + 1]
        at, to = i + 1, j + 1
    return folded(out, queue)


def infer(pages: list[str]) -> list:
    """The wrapper of pages: nested [signature, role, flags, children, hashes of the template's texts]; flags: 1 optional, 2 repeated,
    4 template text, 8 mostly links."""
    wrapper = None
    for html in pages:
        wrapper = with_page(wrapper, html)
    return nested(plain_rows(wrapper))


def with_page(wrapper: Node | None, html: str) -> Node:
    root = parse(html)
    node = of_page(root, longest(root))
    return node if wrapper is None else joined(wrapper, node)


def listed(top: Node) -> list[tuple[Node, int]]:
    """All nodes, each before its kids, and how many kids it has."""
    out, open_ = [], [top]
    while open_:
        node = open_.pop()
        out.append((node, len(node.kids)))
        open_ += reversed(node.kids)
    return out


def packed(top: Node | None) -> bytes:
    names = [x for x in Node.__slots__ if x != "kids"]
    return pickle.dumps([(n, *[getattr(node, x) for x in names]) for node, n in listed(top)] if top else [])


def unpacked(raw: bytes) -> Node | None:
    names = [x for x in Node.__slots__ if x != "kids"]
    top, open_ = None, []
    for n, *values in pickle.loads(raw):
        node = Node.__new__(Node)
        for name, value in zip(names, values, strict=True):
            setattr(node, name, value)
        node.kids = []
        if open_:
            open_[-1][0].kids.append(node)
        top = top or node
        open_.append([node, n + 1])
        while open_ and open_[-1][1] == 1:  # it has all its kids
            open_.pop()
            if open_:
                open_[-1][1] -= 1
    return top


def plain_rows(wrapper: Node | None) -> list[list]:
    """The wrapper for use, each node before its kids: [signature, role, flags, number of kids, hashes of the template's texts]."""
    if wrapper is None:
        return [["#root", "", 0, 0, []]]
    rows = []
    for n, kids in listed(wrapper):
        fixed, links = n.template(), n.different() and 2 * n.link > n.chars
        rows.append([n.sig, n.role, n.opt | n.rep << 1 | bool(fixed) << 2 | links << 3, kids, fixed])
    return rows


def nested(rows: list[list]) -> list:
    """Rows of plain_rows() with a list of kids in place of their number."""
    top, open_ = [], []
    for sig, role, flags, n, text in rows:
        node = [sig, role, flags, [], text]
        if open_:
            open_[-1][0][3].append(node)
        top = top or node
        open_.append([node, n + 1])
        while open_ and open_[-1][1] == 1:
            open_.pop()
            if open_:
                open_[-1][1] -= 1
    return top


def _any(root: El, test: Callable[[El], bool]) -> bool:
    """Whether test holds for a block below root that is not within one named as outside."""
    open_ = [root]
    while open_:
        for k in open_.pop().kids:
            if isinstance(k, El) and k.role != "x":
                if test(k):
                    return True
                open_.append(k)
    return False


class Walk:
    """A block that extract() is in: what of it is still to come, the text since the last break, and its place in the wrapper."""

    __slots__ = ("at", "buffer", "kids", "linked", "navigation", "slots", "template", "total", "within")

    def __init__(self, el: El, node: list | None, within: bool):
        self.kids, self.within = iter(el.kids), within
        self.buffer: list[str] = []
        self.linked = self.total = self.at = 0
        self.template = bool(node and node[4]) and hashed(own_text(el)) in node[4]
        self.navigation = node is not None and node[2] & 10 == 10
        self.slots = node[3] if node else []

    def slot(self, k: El) -> list | None:
        """The slot of a part, sought forward and then from the start, as a repeated group begins again; the slot of its own text before others."""
        n = len(self.slots)
        like = [i % n for i in range(self.at, self.at + n) if self.slots[i % n][0] == k.sig]
        if not like:
            return None
        own = hashed(own_text(k)) if len(like) > 1 else 0
        self.at = next((i for i in like if own and own in self.slots[i][4]), like[0])
        return self.slots[self.at]


def extract(html: str | None, wrapper: list) -> str:
    """The article's text."""
    if not html:
        return ""
    root = parse(html)
    inside: Callable[[El], bool] | None = None
    if _any(root, lambda k: k.tag == "article"):
        inside = lambda el: el.tag == "article" or (el.role == "m" and el.tag != "main")
    elif _any(root, lambda k: k.role == "m"):
        inside = lambda el: el.role == "m"
    elif _any(root, lambda k: k.role == "c"):
        inside = lambda el: el.role == "c"
    blocks: list[str] = []

    def flush(w: Walk) -> None:
        text = " ".join(unescape("".join(w.buffer)).split())
        w.buffer.clear()
        if text and not w.template and (2 * w.linked <= w.total or (w.within and not w.navigation)) and (w.within or inside is None):
            blocks.append(text)
        w.linked = w.total = 0

    path = [Walk(root, wrapper if wrapper and wrapper[0] == root.sig else None, False)]
    while path:
        w = path[-1]
        for k in w.kids:
            if k is None:
                flush(w)
            elif isinstance(k, tuple):
                w.buffer.append(k[0])
                size = len(k[0].strip())
                w.total += size
                w.linked += size * k[1]
            else:
                slot = w.slot(k)
                if k.tag not in INLINE:
                    flush(w)
                if not (k.role == "x" or (k.role == "h" and not w.within)):
                    path.append(Walk(k, slot, w.within or (inside is not None and inside(k))))
                    break
        else:
            flush(w)
            path.pop()
    return "\n".join(blocks)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(_host, wrapper) of every host of pages, from all of them. A task meets its own pages and then no more than MERGED of one
    host's wrappers; equal pages of a task count once."""
    spark = pages.sparkSession

    def run(batches):
        found: dict[str, Node | None] = {}
        met: set[tuple[str, int]] = set()

        def close():
            rows = [(host, packed(node)) for host, node in found.items()]
            found.clear(), met.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["_host", "node"])

        for b in batches:
            for host, html in zip(b.column("_host").to_pylist(), b.column("html").to_pylist(), strict=True):
                key = (host, hashed(html or ""))
                if key in met:
                    continue
                met.add(key)
                found[host] = with_page(found.get(host), html) if html else found.get(host)
                if len(met) >= PAGES:
                    yield close()
        if found:
            yield close()

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        node = None
        for other in filter(None, map(unpacked, sorted(pdf["node"]))):
            node = other if node is None else joined(node, other)
        return pd.DataFrame({"_host": [key[0]], "node": [packed(node)]})

    def last(batches):
        for b in batches:
            made = [json.dumps(plain_rows(unpacked(raw))) for raw in b.column("node").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_host"), pa.array(made, pa.string())], ["_host", "wrapper"])

    parts = stored(arrow_map(with_host(pages.select("url", "html")).select("_host", "html"), run, "_host string, node binary"), "wrapper-parts")
    while True:
        cells = parts.groupBy("_host").agg(F.ceil(F.count("*") / MERGED).cast("int").alias("_n"), F.count("*").alias("_k"))
        if not cells.filter("_k > 1").limit(1).count():
            return arrow_map(parts.select("_host", "node"), last, "_host string, wrapper string")
        dealt = parts.join(small(cells.drop("_k")), "_host").withColumn("_cell", F.pmod(F.xxhash64("node"), F.col("_n")))
        parts = stored(dealt.select("_host", "_cell", "node").groupBy("_host", "_cell").applyInPandas(merge, "_host string, node binary"), "wrapper-parts")


PAGE = "page_id long, url string, text string"


def _texts_of(b: pa.RecordBatch, wrapper_of: Callable[[str], list]) -> pa.RecordBatch:
    texts = [extract(html, wrapper_of(host)) for host, html in zip(b.column("_host").to_pylist(), b.column("html").to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of rows where the wrappers are too large for every task to hold: each goes to its pages, once for each of the cells that a hot host's pages
    are dealt to, and comes before them."""
    counts = rows.groupBy("_host").agg(F.count("*").alias("_n"))
    cells = F.ceil(F.col("_n") / CELL_PAGES).cast("int")
    found = found.join(counts, "_host").select("_host", F.explode(F.sequence(F.lit(0), cells - 1)).alias("_cell"), "wrapper")
    own = rows.join(small(counts.select("_host", cells.alias("_cells")).filter("_cells > 1")), "_host", "left")
    own = own.withColumn("_cell", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("_cells", F.lit(1))).cast("int")).drop("_cells")
    both = found.unionByName(own, allowMissingColumns=True).repartition("_host", "_cell").sortWithinPartitions("_host", "_cell", F.col("wrapper").isNull())

    def run(batches):
        host, wrapper = None, []
        for b in batches:
            at = 0
            marks = [*[i for i, w in enumerate(b.column("wrapper").is_valid().to_pylist()) if w], b.num_rows]
            for i in marks:
                if i > at:
                    own = b.slice(at, i - at)
                    yield _texts_of(own, lambda h, host=host, wrapper=wrapper: wrapper if h == host else [])
                if i < b.num_rows:
                    host, wrapper = b.column("_host")[i].as_py(), nested(json.loads(b.column("wrapper")[i].as_py()))
                at = i + 1

    return arrow_map(both.select("_host", "page_id", "url", "html", "wrapper"), run, PAGE)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    found = stored(wrappers(pages), "wrappers")
    rows = with_host(pages.select("page_id", "url", "html"))
    if found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("_host")), F.lit(0)).alias("n")).head()["n"] > HELD_BYTES:
        return _beside(rows, found)
    shared = pages.sparkSession.sparkContext.broadcast({r["_host"]: r["wrapper"] for r in found.collect()})  # HELD_BYTES at most

    def run(batches):
        known: dict[str, list] = {}

        def wrapper_of(host):
            if host not in known:
                if len(known) >= 500:
                    known.clear()
                raw = shared.value.get(host)
                known[host] = nested(json.loads(raw)) if raw else []
            return known[host]

        for b in batches:
            yield _texts_of(b, wrapper_of)

    return arrow_map(rows.select("_host", "page_id", "url", "html"), run, PAGE)
