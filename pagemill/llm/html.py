"""Main text of web pages by wrapper induction: pages of one host are aligned, and slots that vary are content.

A page is a tree of blocks; neighbouring blocks of one label form one repeated slot. Trees of a host are merged into a wrapper
by simple tree matching, which also aligns each page with the finished wrapper. Texts and sizes of every slot are counted over all
distinct pages. Few different texts over many pages make a slot template; where the varying text of the host lies makes the main
region. Tags and names only weigh in that.

Trees are flat lists of slots, and all walks use explicit stacks, so pages may be nested to any depth.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.session import fresh, saved
from pagemill.llm.urls import host_of

#: Shapes of a host that are merged together, round after round until one is left, and pages of a host that a task aligns.
SHAPES_AT_ONCE, PAGES_A_TASK = 32, 256
#: A slot is judged by its texts from so many pages on, and is template if at most this share of them differ.
ENOUGH, TEMPLATE_SHARE = 5, 0.5
#: The share within articles, where near copies of pages repeat a title or paragraph.
ARTICLE_SHARE = 0.2
#: A block is the main region of what is around it if it has this share of the varying text, which hints of tags and names weigh up or down.
REGION_SHARE, MAIN_WEIGHT, HINTED_WEIGHT = 0.8, 10.0, 0.1
#: Rows of hosts that are broadcast; more are joined by a shuffle.
SMALL = 100_000
MAIN = ("article", "main")

MARKUP = re.compile(
    r"<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)"
    r"|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.I | re.S,
)
#: Elements whose content is not markup, or is never text of the page.
RAW = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in "script style template noscript textarea iframe select title".split()}
ATTRIBUTE = re.compile(r"([a-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("head nav header footer aside form button dialog menu".split())
#: Class and id names that hint at boilerplate, and those of what readers write.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
READERS = frozenset("comment comments comment-list disqus replies reply respond".split())
#: Blocks that are parts of a text and no regions.
TEXT_TAGS = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr td th figure figcaption math svg details summary".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: An open element of the first kind ends where one of these begins.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
#: White space other than a single blank.
_BLANK = r"\t\n\r\f\v\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANKS = re.compile(rf"[{_BLANK}][ {_BLANK}]*| [ {_BLANK}]+")


class Node:
    """A block: its label, tag, whether its tag or role marks it as boilerplate, blocks and runs of text in order, and characters of links."""

    __slots__ = ("label", "tag", "drop", "parts", "linked")

    def __init__(self, label: str, tag: str, drop: bool):
        self.label, self.tag, self.drop, self.parts, self.linked = label, tag, drop, [], 0


@lru_cache(4096)
def _dropped(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """A block's label (tag, class and id names, digits alike), and whether it is boilerplate by tag or role."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    names = re.sub(r"\d+", "0", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
    drop = (tag in BOILERPLATE_TAGS and not (tag == "header" and in_article)) or found.get("role", "").lower() in BOILERPLATE_ROLES
    return " ".join([tag, *names]), drop


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return BLANKS.sub(" ", text).strip(" ")


def parse(page: str | None) -> Node:
    """The page's tree of blocks. Broken markup is read as browsers do where that is simple, and never fails."""
    page = page or ""
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]
    text: list[str] = []
    at, links, articles = 0, 0, 0

    def flush() -> None:
        nonlocal text
        if text:
            whole = _plain("".join(text))
            if whole:
                stack[-1][1].parts.append(whole)
            text = []

    def shut(depth: int) -> None:
        nonlocal links, articles
        while len(stack) > depth:
            tag, node = stack[-1]
            if node is not stack[-2][1]:
                flush()
                articles -= tag in ("article", "main")
            else:
                links -= tag == "a"
            stack.pop()

    while (start := page.find("<", at)) >= 0:
        m = MARKUP.match(page, start)
        end = m.end() if m else start + 1
        if m is None or start > at:
            text.append(page[at : start if m else end])
            if links:
                stack[-1][1].linked += start - at
        at = end
        if m is None:
            continue
        close, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    shut(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
        elif tag == "br" or tag == "hr":
            text.append(" ")
        elif tag in VOID:
            continue
        elif tag in RAW:
            at = RAW[tag].search(page, at).end()
        elif tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
        else:
            for depth in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[depth][0], ()):
                    shut(depth)
                    break
                if stack[depth][0] not in INLINE and stack[depth][0] not in CLOSED_BY:
                    break
            flush()
            label, drop = _dropped(tag, attributes, articles > 0)
            node = Node(label, tag, drop)
            stack[-1][1].parts.append(node)
            stack.append((tag, node))
            articles += tag in ("article", "main")
            if attributes.endswith("/") and tag not in CLOSED_BY:
                shut(len(stack) - 1)
    if at < len(page):
        text.append(page[at:])
    flush()
    shut(1)
    return root


class Slots:
    """A tree of slots in lists by number, 0 being the root and parents before their children.

    label ("#" for text), kids, and of pages also the text hash, characters, characters of links, and texts.
    """

    def __init__(self):
        self.label, self.kids, self.hash, self.chars, self.linked, self.texts = [], [], [], [], [], []

    def new(self, label: str, hashed: int = 0, chars: int = 0, linked: int = 0) -> int:
        for column, value in ((self.label, label), (self.kids, []), (self.hash, hashed), (self.chars, chars), (self.linked, linked)):
            column.append(value)
        return len(self.label) - 1

    @staticmethod
    def of(root: Node, texts: bool = False) -> Slots:
        """Of a page: neighbours of one label are one slot, whose blocks follow each other, so order is kept; boilerplate tags are left out."""
        out = Slots()
        out.new("")
        todo = [(0, [root])]
        while todo:
            number, group = todo.pop()
            runs: list[tuple[str, list]] = []
            for part in (part for node in group for part in node.parts):
                if isinstance(part, str) or not part.drop:
                    label = "#" if isinstance(part, str) else part.label
                    if not runs or runs[-1][0] != label:
                        runs.append((label, []))
                    runs[-1][1].append(part)
            for label, parts in runs:
                if label == "#":
                    hashed = 0
                    for x in parts:
                        hashed = zlib.crc32(x.encode("utf-8", "surrogatepass"), hashed)
                    k = out.new("#", hashed, sum(map(len, parts)))
                    if texts:
                        out.texts += [None] * (k + 1 - len(out.texts))
                        out.texts[k] = parts
                else:
                    k = out.new(label, linked=sum(x.linked for x in parts))
                    todo.append((k, parts))
                out.kids[number].append(k)
        return out

    def walk(self, start: int = 0) -> Iterator[tuple[int, int]]:
        """(slot, depth) in page order."""
        todo = [(start, 0)]
        while todo:
            k, depth = todo.pop()
            yield k, depth
            todo += [(x, depth + 1) for x in reversed(self.kids[k])]

    def write(self) -> str:
        order = list(self.walk())
        return json.dumps([[self.label[k] for k, _ in order], [d for _, d in order], [self.hash[k] for k, _ in order], [self.chars[k] for k, _ in order], [self.linked[k] for k, _ in order]], separators=(",", ":"))

    @staticmethod
    def read(written: str) -> Slots:
        out, above = Slots(), []
        for label, depth, hashed, chars, linked in zip(*json.loads(written), strict=True):
            k = out.new(label, hashed, chars, linked)
            del above[depth:]
            if above:
                out.kids[above[-1]].append(k)
            above.append(k)
        return out

    def shapes(self, known: dict) -> list[int]:
        """A number for each slot's labels, its own and all below; equal ones are equal. `known` holds shapes and, by number, their sizes."""
        out, sizes = [0] * len(self.label), known.setdefault("sizes", [])
        for k in range(len(self.label) - 1, -1, -1):
            key = (self.label[k], *(out[x] for x in self.kids[k]))
            if key not in known:
                known[key] = len(sizes)
                sizes.append(1 + sum(sizes[out[x]] for x in self.kids[k]))
            out[k] = known[key]
        return out


#: A wrapper of the root alone.
EMPTY = '[[""],[0],[0],[0],[0]]'


class Matching:
    """Simple tree matching of two trees: the most slots that pair up, labels alike, parents with parents and in order.

    Children of equal shape at either end of two lists pair up at once, which loses nothing; between them a table over both
    lists finds the best pairs, a row at a time. Weights depend on shapes alone and are found once for two shapes.
    """

    def __init__(self, a: Slots, b: Slots):
        known: dict = {}
        self.a, self.b, self.weights = a, b, {}
        self.shape_a, self.shape_b, self.sizes = a.shapes(known), b.shapes(known), known["sizes"]

    def _ends(self, x: int, y: int) -> tuple[list[int], list[int], int, int]:
        """Children of both, and how many pair up from the start and from the end."""
        own, other = self.a.kids[x], self.b.kids[y]
        p = [self.shape_a[i] for i in own]
        q = [self.shape_b[j] for j in other]
        start = 0
        while start < min(len(p), len(q)) and p[start] == q[start]:
            start += 1
        end = 0
        while end < min(len(p), len(q)) - start and p[-1 - end] == q[-1 - end]:
            end += 1
        return own, other, start, end

    def _table(self, own: list[int], other: list[int], trace: bool):
        """The weight of the best pairs of two lists, and these."""
        shapes_a, at_a = np.unique([self.shape_a[i] for i in own], return_inverse=True)
        shapes_b, at_b = np.unique([self.shape_b[j] for j in other], return_inverse=True)
        small = np.array([[self.weights.get((s, t), self.sizes[s] if s == t else 0) for t in shapes_b.tolist()] for s in shapes_a.tolist()], dtype=np.int64)
        best, ups, lefts = np.zeros(len(other) + 1, np.int64), [], []
        for i in range(len(own)):
            now = best.copy()
            weight = small[at_a[i]][at_b]
            now[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(weight > 0, best[:-1] + weight, 0)))
            if trace:
                ups.append(np.packbits(now == best))
                lefts.append(np.packbits(np.append(False, now[1:] == now[:-1])))
            best = now
        pairs, i, j = [], len(own), len(other)
        while trace and i and j:
            if ups[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
                i -= 1
            elif lefts[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((own[i], other[j]))
        return int(best[-1]), pairs[::-1]

    def _missing(self, own: list[int], other: list[int]) -> list[tuple[int, int]]:
        """One pair for each two shapes of one label whose weight is not known."""
        by_label: dict[str, dict[int, int]] = {}
        for j in other:
            by_label.setdefault(self.b.label[j], {})[self.shape_b[j]] = j
        seen = {self.shape_a[i]: i for i in own}
        return [(i, j) for s, i in seen.items() for t, j in by_label.get(self.a.label[i], {}).items() if s != t and (s, t) not in self.weights]

    def _weigh(self, x: int, y: int) -> None:
        """Finds weights of all pairs of children that _table asks for, deepest first."""
        todo = [(x, y, False)]
        while todo:
            i, j, ready = todo.pop()
            own, other, start, end = self._ends(i, j)
            inner, outer = own[start : len(own) - end], other[start : len(other) - end]
            if not ready:
                if (i, j) != (x, y) and (self.shape_a[i], self.shape_b[j]) in self.weights:
                    continue
                todo.append((i, j, True))
                if inner and outer:
                    todo += [(*pair, False) for pair in self._missing(inner, outer)]
            elif (i, j) != (x, y):
                total = 1 + sum(self.sizes[self.shape_a[k]] for k in own[:start] + own[len(own) - end :])
                self.weights[self.shape_a[i], self.shape_b[j]] = total + (self._table(inner, outer, False)[0] if inner and outer else 0)

    def pairs(self, x: int = 0, y: int = 0) -> list[tuple[int, int]]:
        """Children of two slots that pair up."""
        own, other, start, end = self._ends(x, y)
        inner, outer = own[start : len(own) - end], other[start : len(other) - end]
        middle = []
        if inner and outer:
            self._weigh(x, y)
            middle = self._table(inner, outer, True)[1]
        return [*zip(own[:start], other[:start], strict=True), *middle, *zip(own[len(own) - end :], other[len(other) - end :], strict=True)]

    def all(self) -> dict[int, int]:
        """The slot of the first tree for each slot of the second one that has one."""
        found, todo = {0: 0}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            for i, j in self.pairs(x, y):
                found[j] = i
                todo.append((i, j))
        return found


def merge(wrapper: Slots, page: Slots) -> None:
    """Adds a page to a wrapper; slots that it lacks go where the page has them."""
    found = Matching(wrapper, page).all()
    for y, x in list(found.items()):
        kids, taken = [], 0
        old = wrapper.kids[x]
        place = {k: n for n, k in enumerate(old)}
        for j in page.kids[y]:
            if j in found:
                at = place[found[j]]
                kids += old[taken : at + 1]
                taken = at + 1
            else:
                own = wrapper.new(page.label[j])
                kids.append(own)
                todo = [(j, own)]
                while todo:
                    below, to = todo.pop()
                    for k in page.kids[below]:
                        wrapper.kids[to].append(wrapper.new(page.label[k]))
                        todo.append((k, wrapper.kids[to][-1]))
        wrapper.kids[x] = kids + old[taken:]


def induce(pages: list[Slots]) -> Slots:
    """The shape of the pages' wrapper, its slots numbered in page order."""
    wrapper = Slots()
    wrapper.new("")
    for page in pages:
        merge(wrapper, page)
    return Slots.read(wrapper.write())


def aligned(shape: Slots, page: Slots) -> Iterator[tuple[int, int, int, int]]:
    """Number of each slot of a wrapper that the page has with text or links of its own, hash and characters of the text, characters of links."""
    for y, x in Matching(shape, page).all().items():
        if page.label[y] == "#" or page.linked[y]:
            yield x, page.hash[y], page.chars[y], page.linked[y]


def judged(shape: Slots, counts: dict[int, tuple[int, int, int, int]]) -> list[bool]:
    """For each slot whether it is content, by pages, different texts, characters and characters of links of the host's slots.

    From the body on, the block that has nearly all of the varying text is the main region, and blocks beside it go (headings, paragraphs
    and plain text stay); articles and main elements weigh more and blocks of boilerplate names or mostly links less. In what is left
    template goes, what readers write, blocks of boilerplate names without most of the text around them, and outside articles
    blocks of mostly links. An article of nothing but template is kept whole.
    """
    n = len(shape.label)
    tags = [label.split(" ", 1)[0] for label in shape.label]
    names = [frozenset(label.split(" ")[1:]) for label in shape.label]
    partly = [any(not BOILERPLATE_NAMES.isdisjoint(re.split("[^a-z]+", x)) for x in own) for own in names]
    hinted = [not (BOILERPLATE_NAMES | READERS).isdisjoint(own) and tag not in (*MAIN, "html", "body") for own, tag in zip(names, tags, strict=True)]
    share, inside = [TEMPLATE_SHARE] * n, [False] * n
    template, mass, chars, linked = [False] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n):
        pages, texts, size, links = counts.get(k, (0, 0, 0, 0))
        if tags[k] == "#":
            template[k] = pages >= ENOUGH and texts <= share[k] * pages
            mass[k] = 0.0 if template[k] else float(size)
        chars[k], linked[k] = chars[k] + size, linked[k] + links
        inside[k] |= tags[k] in MAIN
        for x in shape.kids[k]:
            inside[x] = inside[k]
            share[x] = ARTICLE_SHARE if tags[k] in MAIN else TEMPLATE_SHARE if partly[k] else share[k]
    above = [0] * n
    for k in range(n):
        for x in shape.kids[k]:
            above[x] = k
    whole = set()
    for k in range(n - 1, 0, -1):
        if tags[k] in MAIN and not mass[k]:
            mass[k] = chars[k]
            whole.add(k)
        mass[above[k]], chars[above[k]], linked[above[k]] = mass[above[k]] + mass[k], chars[above[k]] + chars[k], linked[above[k]] + linked[k]
    has_main = [tag in MAIN and m > 0 for tag, m in zip(tags, mass, strict=True)]
    for k in range(n - 1, 0, -1):
        has_main[above[k]] |= has_main[k]
    mostly_links = [links > 0.5 * size for links, size in zip(linked, chars, strict=True)]

    def weight(k: int) -> float:
        return mass[k] * (MAIN_WEIGHT if has_main[k] else HINTED_WEIGHT if hinted[k] or mostly_links[k] else 1.0)

    keep = [False] * n
    todo = [(0, True)]  # a slot, and whether a main region is looked for in it
    while todo:
        k, search = todo.pop()
        if k in whole:
            for x, _ in shape.walk(k):
                keep[x] = True
            continue
        keep[k] = not template[k]
        kids = shape.kids[k]
        if search and tags[k] not in MAIN:
            todo += [(x, True) for x in kids if tags[x] in ("html", "body")]
            kids = [x for x in kids if tags[x] not in ("html", "body")]
            blocks = [x for x in kids if tags[x] not in TEXT_TAGS]
            best = max(blocks, key=weight, default=None)
            if best is not None and 0 < weight(best) >= REGION_SHARE * sum(map(weight, kids)):
                kids = [x for x in kids if tags[x] in TEXT_TAGS]
                todo.append((best, True))
        for x in kids:
            minor = mass[x] <= 0.5 * mass[k] or mostly_links[x]
            said = not READERS.isdisjoint(names[x]) and (inside[k] or not has_main[x])
            if not said and (has_main[x] or not ((hinted[x] and minor) or (mostly_links[x] and not inside[x] and tags[x] != "#"))):
                todo.append((x, False))
    return keep


def content(page: Slots, shape: Slots, keep: list[bool]) -> list[str]:
    """Texts of a page in the wrapper's slots of content, in page order. Slots that the wrapper does not have go with what is around them."""
    found, out, kept = Matching(shape, page).all(), [], {}
    todo = [(0, 0)]
    while todo:
        y, above = todo.pop()
        kept[y] = keep[found[y]] if y in found else kept[above] and READERS.isdisjoint(page.label[y].split(" ")[1:])
        if page.label[y] == "#" and kept[y]:
            out += page.texts[y]
        todo += [(k, y) for k in reversed(page.kids[y])]
    return out


def main_text(page: str | None, shape: Slots, keep: list[bool]) -> str:
    """The page's blocks of content, joined by blanks. A page that has nothing in its host's slots of content is a wrapper of its own."""
    own = Slots.of(parse(page), texts=True)
    out = content(own, shape, keep)
    if not out and len(own.label) > 1:
        alone = Slots.read(own.write())
        counts = {k: (1, 1, alone.chars[k], alone.linked[k]) for k in range(len(alone.label))}
        out = content(own, alone, judged(alone, counts))
    return " ".join(out)


def extract(pages: DataFrame, *, url: str = "url", page_html: str = "html", sample: int = SHAPES_AT_ONCE, pages_a_task: int = PAGES_A_TASK) -> DataFrame:
    """pages without the html, with text and n_chars; columns of these names are replaced.

    The text is what a page has in the slots of its host's wrapper that are content (see judged). Elements that by HTML are menus, headers
    outside articles, footers, sidebars, forms, scripts and styles are left out by tag or role; class and id names only weigh in
    the wrapper's counts. Character references are decoded, white space within a block becomes one blank, blocks are joined by
    one. Nothing is cut off.

    The shape of a host's wrapper is induced from all distinct shapes of its pages: about `sample` of them are merged in a task, and what comes of
    these is merged in turn until a host has one. All distinct trees are aligned with it, and all their texts in a slot
    decide. A host's pages are dealt to tasks of about pages_a_task, so a large host is no larger task. Null or
    empty html gives an empty text; a null url or one without host belongs to the empty host. Repeated rows are each extracted;
    an empty table gives an empty one.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars", page_html)]
    host, salt, tree, own, deal, size = fresh([*columns, page_html], "host", "salt", "tree", "wrapper", "deal", "pages_of_host")
    rows = pages.select(*columns, F.col(page_html).alias(page_html), host_of(F.col(url)).alias(host))

    def trees(batches):
        for b in batches:
            made = [Slots.of(parse(x)).write() for x in b.column(page_html).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(host), pa.array(made, pa.string())], [host, tree])

    skeletons = saved(rows.select(host, page_html).mapInArrow(trees, f"`{host}` string, `{tree}` string").distinct())
    hosts = saved(skeletons.groupBy(host).agg(F.count("*").alias(size)))
    few = hosts.count() <= SMALL

    def sized(frame: DataFrame) -> DataFrame:
        """Rows with the number of their host's trees."""
        return frame.join(F.broadcast(hosts) if few else hosts, host)

    def dealt(frame: DataFrame, wrappers: DataFrame) -> DataFrame:
        """Rows with their host's wrapper, which has a copy for each of the tasks that a large host takes."""
        salts = F.ceil(F.col(size) / pages_a_task).cast("int")
        copies = sized(wrappers).withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1))).drop(size)
        return sized(frame.withColumn(deal, F.monotonically_increasing_id())).withColumn(salt, F.pmod(F.xxhash64(deal), salts).cast("int")).drop(size, deal).join(copies, [host, salt], "left")

    def shaped(batches):
        for b in batches:
            made = []
            for x in b.column(tree).to_pylist():
                labels, depths, *_ = json.loads(x)
                made.append(json.dumps([labels, depths, *[[0] * len(labels)] * 3], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([b.column(host), pa.array(made, pa.string())], [host, own])

    def wrap(some: pd.DataFrame) -> pd.DataFrame:
        shape = induce([Slots.read(x) for x in sorted(some[own], key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x))])
        return pd.DataFrame({host: some[host].iloc[:1], own: [shape.write()]})

    shapes, turn = saved(skeletons.mapInArrow(shaped, f"`{host}` string, `{own}` string").distinct()), 0
    while True:
        left = saved(shapes.groupBy(host).agg(F.count("*").alias(size)))
        if (left.agg(F.max(size)).first()[0] or 0) <= 1:
            break
        turn += 1
        part = F.pmod(F.xxhash64(F.lit(turn), own), F.ceil(F.col(size) / sample)).alias(salt)
        merged = shapes.join(F.broadcast(left) if few else left, host).select(host, own, part)
        shapes = saved(merged.groupBy(host, salt).applyInPandas(wrap, f"`{host}` string, `{own}` string"))

    def align(batches):
        known: dict[str, Slots] = {}
        for b in batches:
            at, found = [], []
            for k, (page, shape) in enumerate(zip(b.column(tree).to_pylist(), b.column(own).to_pylist(), strict=True)):
                if shape not in known:
                    known.clear()
                    known[shape] = Slots.read(shape or EMPTY)
                for one in aligned(known[shape], Slots.read(page)):
                    at.append(k)
                    found.append(one)
            slot, hashed, chars, linked = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(host).take(pa.array(at, pa.int64())), pa.array(slot, pa.int32()), *(pa.array(x, pa.int64()) for x in (hashed, chars, linked))], [host, "slot", "hash", "chars", "linked"])

    met = dealt(skeletons, shapes).select(host, tree, own).mapInArrow(align, f"`{host}` string, slot int, hash long, chars long, linked long")
    sums = [F.sum(c).alias(c) for c in ("chars", "linked")]
    one_text = met.groupBy(host, "slot", "hash").agg(F.count("*").alias("pages"), *sums)
    one_slot = one_text.groupBy(host, "slot").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts"), *sums)
    counts = one_slot.groupBy(host).agg(F.collect_list(F.struct("slot", "pages", "texts", "chars", "linked")).alias("counts"))  # as many as the wrapper's slots

    def judge(batches):
        for b in batches:
            out = []
            for shape, seen in zip(b.column(own).to_pylist(), b.column("counts").to_pylist(), strict=True):
                keep = judged(Slots.read(shape or EMPTY), {x["slot"]: (x["pages"], x["texts"], x["chars"], x["linked"]) for x in seen or []})
                out.append(json.dumps([shape or EMPTY, [int(x) for x in keep]]))
            yield pa.RecordBatch.from_arrays([b.column(host), pa.array(out, pa.string())], [host, own])

    wrappers = shapes.join(counts, host, "left").select(host, own, "counts").mapInArrow(judge, f"`{host}` string, `{own}` string")

    def run(batches):
        known: dict[str, tuple[Slots, list[bool]]] = {}
        for b in batches:
            out = []
            for page, wrapper in zip(b.column(page_html).to_pylist(), b.column(own).to_pylist(), strict=True):
                if wrapper not in known:
                    known.clear()
                    shape, keep = json.loads(wrapper) if wrapper else (EMPTY, [1])
                    known[wrapper] = Slots.read(shape), [bool(x) for x in keep]
                out.append(main_text(page, *known[wrapper]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*columns, "text", "n_chars"])

    kind = T.StructType([*(pages.schema[c] for c in columns), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return dealt(rows, wrappers).select(*columns, page_html, own).mapInArrow(run, kind)
