"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks in page order, each with the elements it stands in. A linear classifier gives the cost
of calling a block content or boilerplate; these costs are the capacities to the two terminals. Blocks that follow each
other, and blocks of one parent element, are joined by smoothness edges that weaken with their distance in the tree.
The minimum cut, found by blocking flows, separates content from boilerplate: a doubtful block goes with its
surroundings.

The classifier is learnt from pages that mark their own article: their blocks in it are content, the others are not. It
sees what a block is (length, links, sentences, tag) and the names of the elements, classes and ids around it, but not
the mark itself, so it speaks for pages without one. What a page says outright (an article element, a boilerplate
element or name around the block) is added as a fixed capacity.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mapped, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_TEXT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title", "head", "audio", "video", "math"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that a new element of the second kind ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"ul", "ol", "table", "dl", "div", "section", "article", "body", "nav", "blockquote", "main", "aside"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer",
    "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promotion", "related",
    "recommended", "respond", "replies", "share", "sharing", "sidebar", "signup", "login", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "disqus", "overlay",
    "aside", "toc", "alert", "discussion", "commentlist", "teaser", "teasers", "popular", "trending",
}
COMMENT_WORDS = {"comment", "comments", "commentlist", "discussion", "reply", "replies", "ad", "advert", "promo", "related", "sponsored", "teaser"}
#: A class name that begins so says what the element has beside it; one with a word of the second kind may belong to a
#: frame around the whole page, and counts for nothing within an article or a content element that the frame holds.
BESIDE, FRAME = {"has", "with", "without", "no"}, {"left", "right", "open", "enabled", "wrapper", "layout", "page"}
CONTENT_WORDS = {"article", "content", "entry", "post", "story", "body", "text", "main", "prose"}
#: Fixed capacities, positive for content, of what a page says outright. One boilerplate element around a block
#: outweighs all that can speak for it: 16.4 by the article, the largest learnt sum, and its four edges at most.
MARKED = {"article": 5.0, "boiler": -17.0}
#: Weights of the classifier before anything is learnt, to which learning holds on where there is little to learn from.
WEIGHT = {"bias": -0.5, "content": 1.5, "links": -4.0, "length": 0.6, "sentence": 1.0, "paragraph": 1.0, "heading": 0.5, "item": -0.5}
MOST = 9.0
#: What is learnt from: pages and bytes of them at most, names that stand around so many blocks, and so many names at most.
SAMPLE, SAMPLE_BYTES, SEEN, NAMES, HOLD = 2000, 64_000_000, 20, 300, 0.02
ADJACENT, SIBLING = 0.6, 0.6
TINY = 1e-9


class Element:
    """An open element, and what is known of all the elements it stands in."""

    __slots__ = ("article", "boiler", "content", "depth", "forms", "frames", "holder", "link", "muted", "names", "number", "outer", "tag")

    def __init__(self, tag: str, nature: int, number: int, parent: Element | None, names: frozenset[str] = frozenset()):
        self.tag, self.number = tag, number
        self.boiler = (parent.boiler if parent else 0) + (nature == -1 and tag != "form")
        # a frame around an article or a content element says nothing of it
        self.frames = 0 if nature > 0 or not parent else parent.frames + (nature == -2)
        # a form around the article is the page's own, as some page builders write it
        self.forms = 0 if nature == 2 or not parent else parent.forms + (tag == "form")
        self.article = nature == 2 or bool(parent and parent.article)
        self.content = nature == 1 or bool(parent and parent.content)
        self.link = tag == "a" or bool(parent and parent.link)
        self.muted = tag in NO_TEXT or bool(parent and parent.muted)
        inline = tag in INLINE
        self.names = names if not parent else parent.names if inline or names <= parent.names else parent.names | names
        # the nearest element that is no part of a line, and the one around that
        self.holder = parent.holder if parent and inline else self
        self.outer = (parent.outer if inline else parent.holder) if parent else self
        self.depth = parent.depth + (not inline) if parent else 0


class Block:
    __slots__ = ("boiler", "article", "content", "depth", "linked", "names", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, inside: Element):
        self.text, self.linked = text, linked
        self.tag, self.parent, self.depth = inside.holder.tag, inside.outer.number, inside.depth
        self.boiler, self.article, self.content = inside.boiler + inside.forms + inside.frames, inside.article, inside.content
        self.names = inside.names

    def features(self) -> list[float]:
        """In the order of WEIGHT."""
        n = len(self.text)
        return [
            1.0, float(self.content), self.linked / n, min(4.0, n / 50), float(self.text[-1] in ".!?…\"'"), float(self.tag in ("p", "blockquote", "pre")),
            float(self.tag in ("h1", "h2", "h3")), float(self.tag == "li"),
        ]


class Model:
    """Weights of the features and of the names around a block."""

    def __init__(self) -> None:
        self.weights, self.names = list(WEIGHT.values()), {}

    def logit(self, block: Block) -> float:
        """What the block itself says, within MOST, and what its page says of it."""
        own = sum(w * x for w, x in zip(self.weights, block.features(), strict=True)) + sum(map(self.names.get, block.names & self.names.keys()))
        return max(-MOST, min(MOST, own)) + MARKED["article"] * block.article + MARKED["boiler"] * block.boiler

    def fit(self, pages: list[str]) -> Model:
        """Logistic regression on the blocks of pages that mark an article, held to the first weights by a ridge."""
        held = [b for found in map(blocks, pages) if any(b.article for b in found) for b in found]
        seen = Counter(n for b in held for n in b.names)
        names = sorted(n for n, k in seen.most_common(NAMES) if SEEN <= k < len(held))
        if not held:
            return self
        place = {n: len(WEIGHT) + i for i, n in enumerate(names)}
        x = np.zeros((len(held), len(WEIGHT) + len(names)))
        x[:, : len(WEIGHT)] = [b.features() for b in held]
        for row, b in zip(x, held, strict=True):
            row[[place[n] for n in b.names & place.keys()]] = 1
        y = np.array([b.article and not b.boiler for b in held], float)
        first = np.array([*WEIGHT.values(), *([0.0] * len(names))])
        w, ridge = first.copy(), HOLD * len(held) / 10
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - first))
            w += np.clip(step, -1, 1)
            if abs(step).max() < 1e-6:
                break
        self.weights = w[: len(WEIGHT)].tolist()
        self.names = dict(zip(names, w[len(WEIGHT) :].tolist(), strict=True))
        return self


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())


def _named(tag: str, said: dict[str, str]) -> frozenset[str]:
    """The element's tag and the names it has, but for those that mark an article."""
    own = {tag} | {"." + n.lower() for n in (said.get("class", "") + " " + said.get("id", "")).split()}
    return frozenset(own - {"article", "main", "html", "body"})


def _attributes(text: str) -> dict[str, str]:
    said: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        said.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return said


def _nature(tag: str, said: dict[str, str], inside: Element) -> int:
    """-1 boilerplate, -2 perhaps a frame around the page, 1 a likely and 2 a certain content element, 0 neither."""
    if tag in BOILER_TAGS or tag in NO_TEXT:
        return -1
    if tag == "header" and not inside.article:
        return -1
    if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")) or said.get("role", "") in BOILER_ROLES:
        return -1
    words: set[str] = set()
    frame = False
    for name in (said.get("class", "") + " " + said.get("id", "")).split():
        own = _words(name)
        if own and own[0] not in BESIDE:  # `has-sidebar` says what stands beside the element
            words.update(own)
            frame = frame or bool(FRAME & set(own) and BOILER_WORDS & set(own))
    if tag not in ("html", "body", "main") and words & (COMMENT_WORDS if tag == "article" else BOILER_WORDS):
        return -2 if frame and tag != "article" else -1
    if tag in ("article", "main") or said.get("role") in ("article", "main") or said.get("itemprop") == "articleBody":
        return 2
    return int(bool(words & CONTENT_WORDS))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Element("", 0, -1, None)]  # the page itself, which never closes
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = count = at = 0

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1]))
            run.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].muted:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if stack[-1].link:
                linked += len(text)

    def drop(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    def innermost(tags, until) -> int:
        """The place of the innermost open element with one of the tags, -1 if one of the others holds it off or there is none."""
        if any(opened[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if until(stack[i].tag):
                    break
        return -1

    while (m := TOKEN.search(page, at)) is not None:
        said(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            said(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            # an inline end tag ends nothing beyond its block
            i = innermost((tag,), (lambda t: t not in INLINE) if tag in INLINE else (lambda t: False))
            if i >= 0:
                drop(i)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            # a paragraph ends at the next block, an item at the next of its list
            for ended in (("p",), ENDS.get(tag, ())):
                i = innermost(ended, SCOPE.__contains__)
                if i >= 0:
                    drop(i)
            if tag == "body" and opened["head"] > 0:
                drop(next(i for i, e in enumerate(stack) if e.tag == "head"))
        if m[3].endswith("/") and tag not in RAW and tag in ("svg", "math", "object", "canvas"):
            continue
        count += 1
        said_of = _attributes(m[3])
        stack.append(Element(tag, _nature(tag, said_of, stack[-1]), count, stack[-1], _named(tag, said_of)))
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    said(page[at:])
    close()
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of the least minimum cut; gain: its source less its sink capacity.

    A node whose own capacity outweighs all its edges lies on that side whatever the rest does; it is taken out
    and its edges go to its neighbours' capacities. Flow is found among the doubtful rest, by blocking flows on
    shortest paths, so that long pages take little more than one pass.
    """
    n = len(gain)
    left = list(gain)
    arcs: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        arcs[a][b] = arcs[a].get(b, 0.0) + c
        arcs[b][a] = arcs[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    held = [sum(a.values()) for a in arcs]
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is not None or -held[i] + TINY < left[i] <= held[i] + TINY:
            continue
        side[i] = left[i] > 0 and left[i] > held[i] + TINY
        for b, c in arcs[i].items():
            if side[b] is None:
                left[b] += c if side[i] else -c
                held[b] -= c
                todo.append(b)
    rest = [i for i in range(n) if side[i] is None]
    while True:
        level = {i: 0 for i in rest if left[i] > TINY}
        reached, ends = list(level), False
        for a in reached:
            for b, c in arcs[a].items():
                if c > TINY and side[b] is None and b not in level:
                    level[b] = level[a] + 1
                    reached.append(b)
                    ends = ends or left[b] < -TINY
        if not ends:
            for i in rest:
                side[i] = i in level
            return side
        ways = {i: list(arcs[i]) for i in level}  # those not yet found closed, last first
        for start in reached:
            if level[start]:
                break
            path = [start]
            while path and left[start] > TINY:
                a = path[-1]
                if left[a] < -TINY:
                    steps = list(zip(path, path[1:], strict=False))
                    flow = min(left[start], -left[a], *(arcs[x][y] for x, y in steps))
                    left[start] -= flow
                    left[a] += flow
                    for x, y in steps:
                        arcs[x][y] -= flow
                        arcs[y][x] += flow
                    path = [start]
                elif not ways[a]:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()
                elif arcs[a][ways[a][-1]] > TINY and level.get(ways[a][-1]) == level[a] + 1:
                    path.append(ways[a][-1])
                else:
                    ways[a].pop()


def labelled(page: str, model: Model) -> tuple[list[Block], list[float], list[bool]]:
    """The page's blocks, what speaks for each by itself, and whether the cut leaves it with the content."""
    found = blocks(page)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            p = found[i - 1]
            edges.append((i - 1, i, ADJACENT / (1 + abs(p.depth - b.depth) + (p.parent != b.parent))))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    own = [model.logit(b) for b in found]
    return found, own, minimum_cut(own, edges)


def main_text(page: str, model: Model | None = None) -> str:
    found, _, content = labelled(page, model or Model())
    return " ".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def learn(df: DataFrame, html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most `sample` different pages, of sample_bytes in all: those whose hash is lowest.

    Null pages and repeated ones play no part. Without a page that marks its article the model keeps its first weights.
    """
    pages = df.select(F.col(html_col).alias("page")).filter("page is not null").withColumn("h", F.xxhash64("page"))
    sizes = pages.groupBy("h").agg(F.min(F.octet_length("page")).alias("n")).orderBy("h").limit(sample).collect()
    cut, total = None, 0
    for r in sizes:
        total += r.n
        if total > sample_bytes:
            break
        cut = r.h
    if cut is None:
        return Model()
    return Model().fit([r.page for r in pages.filter(F.col("h") <= cut).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()])


def extract(df: DataFrame, html_col: str = "html", carry: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The carried columns (all by default), text and n_chars (its code points).

    A null or empty page, and one without content, gives the empty text. Pages are read whole and by themselves,
    so other nulls and repeated rows don't matter, and an empty table gives an empty result. Carried columns may have
    any names; those named text or n_chars give way to the results.
    """

    model = model or Model()

    def make(pages: list) -> list[list]:
        texts = [main_text(p or "", model) for p in pages]
        return [texts, [len(t) for t in texts]]

    return mapped(df, carry or df.columns, html_col, "text string, n_chars long", make)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a model learnt from pages of the table (see learn and extract for odd rows)."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, carry=["page_id", "url"], model=learn(pages))
