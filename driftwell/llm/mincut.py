"""Main text of web pages by minimum cut: max-flow separates content blocks from boilerplate.

A page becomes a row of text blocks, each with the elements that it stands in. A naive Bayes classifier over the shape of
a block (words, links, closing punctuation, tag, words of the trade) and what its elements say of themselves give it a
log-odds score: a positive one is the capacity of an arc from the source (content), a negative one of an arc to the sink.
Neighbours on the page, the stronger the nearer they are in the DOM, and successive children of one element are tied by
smoothness edges. The minimum cut (Dinic's algorithm) is the labelling of least cost; where several are, the one that
keeps most. Edges grow linearly with blocks.

The classifier's shape weights are trained: ``fit`` counts the shapes of blocks over all pages, content against
boilerplate as far as elements say so (``article`` and ``main`` against ``nav``, ``footer``, ``aside``, class and id
words), with a few pseudo-counts that alone decide where a table has no such elements. Counts are summed by Spark; the
model is some twenty numbers.

Text: scripts, styles, titles, form controls, comments and markup go; character references are decoded; white space of
any kind within a block becomes one space, ``br`` included; inline elements don't divide words; blocks are joined in
page order by one space. Nothing is capped. A page is worked on alone in the task that reads it: nothing is shuffled, no
host can be hot, memory is that of a batch (``common.TEXT_ROWS`` rows) plus a few hundred bytes for each block of a page.

Odd rows: null and empty pages, and pages without text outside of scripts and the like, give an empty text. Texts without
any markup are one block, and content. Bytes that aren't UTF-8 become replacement characters. Unclosed elements, tags and
comments end with the page. Null and repeated ids and urls are carried as they are; other columns aren't read. An empty
table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

# ---- a page's blocks

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside isn't text of the page; up to their end tag nothing is markup.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea iframe noscript noembed noframes xmp template svg select object audio video canvas button".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
#: Elements of one block of text; what they stand in is the block's parent.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open one of the same group, up to the element named last.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

CONTENT_TAGS, CONTENT_ROLES = frozenset(["article", "main"]), frozenset(["article", "main"])
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog fieldset legend label".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CONTENT_WORDS = frozenset("article articlebody content main maincontent post entry story body text".split())
BOILERPLATE_WORDS = frozenset(
    """ad ads adsense adv advert adverts advertisement advertising alert aside banner bottombar breadcrumb breadcrumbs comment commentlist
    comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr hidden login masthead menu modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promotion promotions recommended register related replies
    reply respond responses search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription
    toolbar topbar widget widgets""".split()
)
#: Words of a class that speak of another element: ``no-sidebar``, ``with-menu``.
OTHERS = frozenset("has no not with without".split())
#: Words that boilerplate texts have.
TRADE = re.compile(r"©|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:up|in)|log in|advert|sponsored|read more|share this|follow us", re.I)

#: What elements say of themselves: ``article`` and ``main`` by tag or role, content by a class or id, nothing, boilerplate.
ARTICLE, CONTENT, UNSAID, BOILERPLATE = 2, 1, 0, -1


@dataclass(slots=True)
class Element:
    name: str
    node: int
    parent: Element | None
    depth: int
    says: int  # of itself and what it stands in


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters of links
    element: Element

    @property
    def home(self) -> Element:
        return self.element.parent if self.element.name in LEAVES and self.element.parent else self.element


def _says(name: str, attributes: str, parent: Element) -> int:
    if parent.says == BOILERPLATE and parent.name != "form":
        return BOILERPLATE
    if name in CONTENT_TAGS:
        return ARTICLE
    if name in BOILERPLATE_TAGS or name == "form":
        return BOILERPLATE
    if name == "header" and parent.says <= UNSAID:
        return BOILERPLATE
    said = parent.says
    if attributes and name not in ("html", "body"):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return BOILERPLATE
            if key == "role":
                if value.lower() in BOILERPLATE_ROLES:
                    return BOILERPLATE
                said = ARTICLE if value.lower() in CONTENT_ROLES else said
            elif key in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in WORDS.findall(one)}
                    if words & OTHERS:
                        continue
                    if words & BOILERPLATE_WORDS or "header" in words and said <= UNSAID and not words & CONTENT_WORDS:
                        return BOILERPLATE
                    if words & CONTENT_WORDS:
                        said = max(said, CONTENT)
    return said


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    top = Element("", 0, None, 0, UNSAID)
    stack, opened, nodes = [("", top)], Counter(), 1  # names with their elements; a plain span has that around it
    blocks: list[Block] = []
    pieces: list[str] = []
    linked, in_link, i, n = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces and (text := " ".join("".join(pieces).split())):
            blocks.append(Block(text, linked, stack[-1][1]))
        pieces, linked = [], 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            piece = page[i:at]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        if at == n:
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2 if page.startswith(("<!-->", "<!--->"), at) else at + 4)
                i = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                i = n if end < 0 else end + 1
            continue
        tag = TAG.match(page, at) if follows == "/" or follows.isalpha() and follows.isascii() else None
        if tag is None:
            if follows.isalpha() and follows.isascii() or follows == "/" and page[at + 2 : at + 3].isalpha():
                i = n  # a tag that never ends
            else:
                pieces.append("<")
                i = at + 1
            continue
        i = tag.end()
        name, closing = tag[2].lower(), bool(tag[1])
        if name in INLINE:
            if name == "a":
                in_link = not closing
            if name != "span" and name != "label":
                continue
        else:
            if name == "br":
                pieces.append("\n")
                continue
            if name in VOID and name != "hr":
                continue
            flush()
        if closing:
            if opened[name]:
                if name in INLINE:
                    if any(above not in INLINE for above in _above(stack, name)):
                        continue  # it was opened outside of this block
                    if stack[-1][1].name in INLINE:
                        flush()
                while pop() != name:
                    pass
            continue
        if name in RAW:
            end = RAW[name].search(page, i)
            i = n if end is None else (page.find(">", end.end()) + 1 or n)
            continue
        if name == "hr":
            continue
        if name in ENDS:
            group, until = ENDS[name]
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in group or stack[k][0] in until), 0)
            if depth and stack[depth][0] in group:
                while len(stack) > depth:
                    pop()
        elif name not in INLINE and opened["p"]:
            while pop() != "p":
                pass
        parent = stack[-1][1]
        says = _says(name, tag[3], parent)
        opened[name] += 1
        if name in INLINE:
            if says == parent.says:
                stack.append((name, parent))
                continue
            flush()
        stack.append((name, Element(name, nodes, parent, parent.depth + 1, says)))
        nodes += 1
    flush()
    return blocks


def _above(stack: list[tuple[str, Element]], name: str) -> Iterator[str]:
    """Names of what was opened within the last element of a name."""
    for inner, _ in reversed(stack):
        if inner == name:
            return
        yield inner


# ---- the classifier

#: Pseudo-counts (content, boilerplate) of shapes, so that tables without telling elements have weights as well.
PRIOR = {
    "words:1": (1, 4), "words:2": (1, 3), "words:4": (2, 3), "words:8": (3, 2), "words:16": (4, 1), "words:32": (6, 1),
    "links:none": (4, 2), "links:some": (2, 2), "links:half": (1, 3), "links:most": (1, 6),
    "end:stop": (4, 1), "end:other": (2, 4),
    "tag:p": (5, 1), "tag:heading": (3, 2), "tag:li": (1, 2), "tag:cell": (1, 1), "tag:quote": (4, 1), "tag:other": (1, 1),
    "trade:yes": (1, 6), "trade:no": (1, 1),
}
#: Most that one shape, and all of a block's shapes, may weigh.
ONE, ALL = 2.0, 6.0
#: Scores of elements that call themselves content or boilerplate, of blocks outside of those where a page has such, and of all.
SAID = {ARTICLE: 4.0, CONTENT: 4.0, UNSAID: 0.0, BOILERPLATE: -14.0}
OUTSIDE, BASE = {ARTICLE: -8.0, CONTENT: -3.0}, 0.5
#: Smoothness: neighbours of one home, halved for each step apart in the DOM; successive blocks of one home.
NEIGHBOURS, SIBLINGS = 1.5, 1.0
#: Capacities are whole numbers.
SCALE = 1000


def shapes(block: Block) -> list[str]:
    text, n = block.text, block.text.count(" ") + 1
    share = block.linked / max(1, len(text))
    tag = block.element.name
    kind = "p" if tag == "p" else "heading" if tag in HEADINGS else "li" if tag in ("li", "dt", "dd") else "cell" if tag in ("td", "th") else "quote" if tag in ("pre", "blockquote") else "other"
    return [
        f"words:{next(k for k in (32, 16, 8, 4, 2, 1) if n >= k)}",
        f"links:{'none' if not share else 'some' if share < 1 / 3 else 'half' if share < 2 / 3 else 'most'}",
        f"end:{'stop' if text.rstrip(chr(34) + chr(39) + ')»”’')[-1:] in ('.', '!', '?', '…', '。', '！', '？') else 'other'}",
        f"tag:{kind}",
        f"trade:{'yes' if n < 60 and TRADE.search(text) else 'no'}",
    ]


def weights(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log-odds of shapes, each against the base rate, from their counts in content and boilerplate."""
    total = {k: (PRIOR[k][0] + counts.get(k, (0, 0))[0], PRIOR[k][1] + counts.get(k, (0, 0))[1]) for k in PRIOR}
    out = {}
    for k in PRIOR:
        kin = [v for name, v in total.items() if name.split(":")[0] == k.split(":")[0]]
        yes, no = sum(v[0] for v in kin), sum(v[1] for v in kin)
        out[k] = max(-ONE, min(ONE, math.log(total[k][0] / yes) - math.log(total[k][1] / no)))
    return out


def scores(blocks: list[Block], model: dict[str, float]) -> list[float]:
    best = max((b.element.says for b in blocks), default=UNSAID)
    out = []
    for b in blocks:
        shape = max(-ALL, min(ALL, sum(model[s] for s in shapes(b))))
        outside = OUTSIDE.get(best, 0.0) if b.element.says == UNSAID else 0.0
        out.append(BASE + shape + SAID[b.element.says] + outside)
    return out


# ---- the cut


def apart(a: Element, b: Element) -> int:
    """Steps between two elements of a page's tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
        if steps >= 20:
            break  # weights have vanished
    return steps


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, and successive blocks of one home that aren't."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEIGHBOURS * 0.5 ** apart(blocks[i - 1].home, b.home)))
        before = last.get(b.home.node)
        if before is not None:
            out.append((before, i, SIBLINGS))
        last[b.home.node] = i
    return out


def cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost, True for content: a node pays |score| for the wrong side, an edge its weight if cut."""
    n = len(unary)
    source, sink = n, n + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, forth: int, back: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, u in enumerate(unary):
        c = round(u * SCALE)
        if c > 0:
            join(source, i, c, 0)
        elif c < 0:
            join(i, sink, -c, 0)
    for a, b, w in edges:
        if c := round(w * SCALE):
            join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                first = None
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if not room[e] and first is None:
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
            while following[a] < len(arcs[a]):
                e = arcs[a][following[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]
    # what can't reach the sink any more is content: of all minimum cuts the one that keeps most
    lost = [False] * (n + 2)
    lost[sink] = True
    queue = deque([sink])
    while queue:
        a = queue.popleft()
        for e in arcs[a]:
            if room[e ^ 1] and not lost[to[e]]:
                lost[to[e]] = True
                queue.append(to[e])
    return [not x for x in lost[:n]]


def extract(page: str, model: dict[str, float]) -> str:
    blocks = blocks_of(page)
    kept = cut(scores(blocks, model), ties(blocks))
    return " ".join(b.text for b, keep in zip(blocks, kept) if keep)


# ---- on Spark


def _pages(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column(batch.num_columns - 1):
        yield (value.as_py() or b"").decode("utf-8", "replace")


def fit(pages: DataFrame, page: str = "html") -> dict[str, float]:
    """Weights of shapes, counted over all pages."""
    text_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = Counter(), Counter()
        for batch in batches:
            for text in _pages(batch):
                for b in blocks_of(text):
                    if b.element.says != UNSAID:
                        (yes if b.element.says > UNSAID else no).update(shapes(b))
        names = sorted(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[k] for k in names], pa.int64()), pa.array([no[k] for k in names], pa.int64())], ["shape", "yes", "no"])

    counted = pages.select(F.col(f"`{page}`").cast("binary")).mapInArrow(count, "shape string, yes long, no long")
    return weights({r.shape: (r.y, r.n) for r in counted.groupBy("shape").agg(F.sum("yes").alias("y"), F.sum("no").alias("n")).collect()})


def main_text(pages: DataFrame, model: dict[str, float], keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns of ``keep``, and ``text``."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, model) for p in _pages(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    names = [*(f"k{i}" for i in range(len(keep))), "text"]
    asked = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)), F.col(f"`{page}`").cast("binary").alias("page"))
    schema = ", ".join([*(f"{k} {asked.schema[k].dataType.simpleString()}" for k in names[:-1]), "text string"])
    return asked.mapInArrow(run, schema).select(*(F.col(k).alias(c) for c, k in zip(keep, names)), "text")
