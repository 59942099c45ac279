"""Main-text extraction from HTML by a minimum cut over text blocks."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template title svg select textarea button option iframe object".split())
#: Silent elements that hold whole blocks: one inside them ends none outside.
WHOLE = set("noscript template object iframe".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
AROUND = set("nav footer aside form menu dialog".split())
#: Elements at whose start an open paragraph ends.
FLOW = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class names, ids and roles that mark what stands around an article.
MARKS = set("ad ads advert adverts advertisement sponsor sponsored promo promoted nav navbar navigation menu sidebar footer header masthead cookie cookies consent gdpr notice banner comment comments respond replies disqus share sharing social related popup modal newsletter subscribe breadcrumb breadcrumbs pagination widget complementary contentinfo search dialog".split())
#: A name with one of these words tells what a wrapper has or lacks, not what it is; a header of one of OWN belongs to it.
MODIFIERS, OWN = set("has with no without".split()), set("article post entry story content section main".split())
#: Evidence in log-odds: for what is inside the article, against what is marked as something else; the classifier's bound; smoothness.
INSIDE, SURE, BOUND, SMOOTH = 3.0, 8.0, 3.0, 1.5
#: The classifier is fitted on at most SAMPLE pages (the smallest hashes of html) and EACH blocks of each, evenly spread.
SAMPLE, EACH = 1000, 40
#: Weights where no page has both kinds of blocks: bias, then one for each of `traits`.
PRIOR = np.array([-1.5, 2.5, -4.0, 1.0, 0.7, 1.0, -0.7, -3.0, 0.0, 0.0, 0.0])


class Node:
    """An element on the path of blocks."""

    __slots__ = ("around", "article", "depth", "inner", "last", "marked", "parent", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, marked: bool = False, article: bool = False):
        self.tag, self.parent, self.marked, self.article = tag, parent, marked, article
        self.depth = parent.depth + 1 if parent else 0
        self.size, self.last, self.around = 0, None, None
        self.inner = parent is not None and (parent.inner or parent.article)


def marks(values: list[str]) -> bool:
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(values)).lower().split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        if not parts & MODIFIERS and not (parts & OWN and parts & MARKS == {"header"}) and parts & MARKS:
            return True
    return False


class Blocks(HTMLParser):
    """Text blocks in page order, each with its text, linked characters and innermost element that is not inline.

    Elements without text of their own (scripts, pictures, controls, other void ones but a rule) are passed over and end no block. The cost of a
    tag does not grow with the page: of open inline elements only counts are kept.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, Node]] = []
        self.articles: list[Node] = []
        self.node = Node("", None)
        self.open: dict[str, int] = {}
        self.silent = 0
        self.text, self.linked, self.at = [], 0, None

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.linked, self.at))
            self.at.size += len(text)
        self.text, self.linked, self.at = [], 0, None

    def _close(self, node: Node):
        while self.node is not node.parent:
            self.open[self.node.tag] -= 1
            self.silent -= self.node.tag in SILENT
            self.node = self.node.parent
        self.open["a"] = 0

    def _inside(self, tag: str, stop: set) -> Node | None:
        """The open element of that tag, but for one beyond an element of stop."""
        n = self.node
        while n.parent and n.tag != tag and n.tag not in stop:
            n = n.parent
        return n if n.parent and n.tag == tag else None

    def handle_starttag(self, tag, attrs):
        if tag in INLINE and tag not in SILENT:
            if tag == "br":
                self.text.append(" ")
            elif tag not in VOID and tag == "a":
                self.open["a"] = self.open.get("a", 0) + 1
            return
        if tag in VOID:
            if tag == "hr" and not self.silent:
                self.flush()
            return
        if tag in FLOW and self.open.get("p") and (p := self._inside("p", FLOW - {"p"} | WHOLE)):
            self._close(p)
        if tag == "li" and self.open.get("li") and (li := self._inside("li", {"ul", "ol", "menu"})):
            self._close(li)
        if (tag == "body" or tag in FLOW) and self.open.get("head") and (h := self._inside("head", set())):
            self._close(h)
        if not self.silent and tag not in SILENT:
            self.flush()
        d = {k: v or "" for k, v in attrs}
        hidden = "hidden" in d or "display:none" in d.get("style", "").replace(" ", "").lower()
        marked = tag not in ("html", "body") and marks([d.get(k, "") for k in ("class", "id", "role")])
        self.node = Node(tag, self.node, hidden or marked or tag in AROUND, tag in ("article", "main") or d.get("role", "").lower() in ("main", "article"))
        if tag == "header" and not self.node.inner:
            self.node.marked = True
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT
        if self.node.article:
            self.articles.append(self.node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE and tag not in SILENT:
            if tag == "a" and self.open.get("a"):
                self.open["a"] -= 1
            return
        if self.open.get(tag) and (n := self._inside(tag, set())):
            self._close(n)
        if not self.silent and tag not in SILENT:
            self.flush()

    def handle_data(self, data):
        if self.silent > 0:
            return
        if self.at is None and data.strip():
            self.at = self.node
        self.text.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())


def parse(html: str | None) -> tuple[list[tuple[str, int, Node]], Node | None]:
    """Blocks, and the page's article: the article or main element with the fewest marked elements around it, then with most
    text; without one, the element with most text of its own paragraphs. What lies around it is a wrapper, whatever its marks.
    """
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    own: dict[Node, int] = {}
    for _, _, n in p.blocks:
        if n.tag == "p":
            own[n.parent] = own.get(n.parent, 0) + n.size
    sizes: dict[Node, int] = dict.fromkeys(p.articles, 0)
    for text, _, n in p.blocks:
        while p.articles and n:
            if n.article:
                sizes[n] += len(text)
                break
            n = n.parent

    def burden(n):
        k = int(n.marked)
        while n := n.parent:
            k += n.marked
        return k

    candidates = [n for n in p.articles if sizes[n]] or list(own)
    size = sizes if p.articles and any(sizes.values()) else own
    return p.blocks, min(candidates, key=lambda n: (burden(n), -size[n]), default=None)


def surroundings(blocks, article: Node | None) -> None:
    """Set `around` of the elements of blocks: whether they or what they lie in are marked, but for what lies around the article."""
    n = article.parent if article else None
    if article:
        article.marked = False
    while n:
        n.marked = False
        n = n.parent
    for _, _, n in blocks:
        path = []
        while n and n.around is None:
            path.append(n)
            n = n.parent
        known = bool(n and n.around)
        for n in reversed(path):
            n.around = known = known or n.marked


def traits(blocks) -> np.ndarray:
    """What the classifier sees of each block: its text and place, not the names around it."""
    n = len(blocks)
    size = np.log1p(np.array([len(t) for t, *_ in blocks], dtype=float)) / 5
    out = np.zeros((n, 10))
    for i, (text, linked, node) in enumerate(blocks):
        words = text.count(" ") + 1
        out[i, 1] = min(linked / len(text), 1.0)
        out[i, 2] = min(sum(map(text.count, ".,;:?!")) / words, 1.0)
        out[i, 3] = text[-1] in ".?!\"'”’»"
        out[i, 4] = node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre")
        out[i, 5] = node.tag in ("li", "td", "th")
        out[i, 6] = "©" in text[:40]
    out[:, 0] = size
    out[1:, 7] = size[:-1]
    out[:-1, 8] = size[1:]
    out[:, 9] = np.abs(2 * (np.arange(n) + 0.5) / n - 1)
    return out


def costs(blocks, weights: np.ndarray) -> list[tuple[float, float]]:
    """Capacities towards the two terminals: the classifier's log-odds with the evidence of the elements, for content and against it."""
    odds = np.clip(weights[0] + traits(blocks) @ weights[1:], -BOUND, BOUND)
    for i, (_, _, n) in enumerate(blocks):
        odds[i] += INSIDE * (n.inner or n.article) - SURE * n.around
    return [(max(x, 0.0), max(-x, 0.0)) for x in odds.tolist()]


def nearness(a: Node, b: Node) -> float:
    """Smoothness of two neighbours: the share of their paths in common."""
    deep = max(a.depth, b.depth, 1)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return SMOOTH * a.depth / deep


def minimum_cut(unary: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source (content) side of a minimum cut; shortest augmenting paths.

    Flow straight through a node is sent first, so only nodes that disagree with neighbours are searched. Nodes that a search
    without a sink has reached reach none later either, as no flow leaves them, so no search enters them again.
    """
    n = len(unary)
    supply = [max(a - b, 0.0) for a, b in unary]
    demand = [max(b - a, 0.0) for a, b in unary]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    eps = 1e-9

    dead = [False] * n

    def reach(start):
        seen, todo = {start: -1}, deque([start])
        while todo:
            i = todo.popleft()
            if demand[i] > eps:
                return seen, i
            for j, c in near[i].items():
                if c > eps and j not in seen and not dead[j]:
                    seen[j] = i
                    todo.append(j)
        return seen, None

    for s in range(n):
        while supply[s] > eps and not dead[s]:
            seen, t = reach(s)
            if t is None:
                for i in seen:
                    dead[i] = True
                break
            path = [t]
            while seen[path[-1]] >= 0:
                path.append(seen[path[-1]])
            flow = min(supply[s], demand[t], *(near[b][a] for a, b in zip(path, path[1:]))) if len(path) > 1 else min(supply[s], demand[t])
            supply[s] -= flow
            demand[t] -= flow
            for a, b in zip(path, path[1:]):
                near[b][a] -= flow
                near[a][b] += flow
    side = set()
    todo = [i for i in range(n) if supply[i] > eps]
    while todo:
        i = todo.pop()
        if i not in side:
            side.add(i)
            todo += [j for j, c in near[i].items() if c > eps and j not in side]
    return [i in side for i in range(n)]


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    b, article = parse(html)
    if not b:
        return ""
    surroundings(b, article)
    edges = [(i, i + 1, nearness(b[i][2], b[i + 1][2])) for i in range(len(b) - 1)]
    for i, (_, _, n) in enumerate(b):  # siblings that are not neighbours
        if n.parent and n.parent.last is not None and n.parent.last < i - 1:
            edges.append((n.parent.last, i, SMOOTH / 2))
        if n.parent:
            n.parent.last = i
    keep = minimum_cut(costs(b, weights), edges)
    return "\n".join(x[0] for x, k in zip(b, keep) if k)


def examples(html: str | None) -> tuple[list[list[float]], list[int]]:
    """Traits and labels of some blocks of a page that has an article element: inside it and unmarked, or not."""
    b, article = parse(html)
    if not b or article is None or not article.article:
        return [], []
    surroundings(b, article)
    at = sorted({int(i) for i in np.linspace(0, len(b) - 1, min(EACH, len(b)))})
    return traits(b)[at].tolist(), [int((b[i][2].inner or b[i][2].article) and not b[i][2].around) for i in at]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, learned from pages whose article is an element of its own; PRIOR where they show one kind of blocks only.

    A page is sampled if its hash is under a threshold that some twice the sample pass; traits, not pages, come to the driver.
    """
    ship(pages)
    rows = pages.filter(F.col(html).isNotNull()).select(F.xxhash64(html).alias("h"), F.col(html).alias("x"))
    n = rows.count()
    rows = rows.filter(F.pmod("h", F.lit(1 << 32)) / F.lit(float(1 << 32)) * n <= 2 * sample)

    def look(batches):
        for b in batches:
            got = [examples(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.list_(pa.list_(pa.float64()))), pa.array([y for _, y in got], pa.list_(pa.int64()))], names=["h", "x", "y"])

    got = sorted(rows.mapInArrow(look, "h long, x array<array<double>>, y array<long>").collect(), key=lambda r: (r.h, r.x))[:sample]
    x, y = np.array([v for r in got for v in r.x]), np.array([v for r in got for v in r.y], dtype=float)
    return logistic(x, y) if 0 < y.sum() < len(y) else PRIOR


def extract(pages: DataFrame, html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Add main_text and n_chars to every page, from its whole html.

    Null or empty html, and pages of boilerplate only, give an empty text. Pages are independent once the classifier is fitted; equal
    pages get equal texts, time is near-linear in a page's blocks and memory is that of its blocks. Malformed html is read as it
    comes: an end tag without a start is skipped, an element without an end lasts until what holds it ends. Columns named
    main_text or n_chars are replaced.
    """
    ship(pages)
    lean = pages.drop("main_text", "n_chars")
    w = fit(pages, html) if weights is None else weights

    def run(batches):
        for b in batches:
            texts = [main_text(h, w) for h in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names, "main_text", "n_chars"])

    return lean.mapInArrow(run, StructType([*lean.schema.fields]).add("main_text", "string").add("n_chars", "long"))


def op2(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).selectExpr("page_id", "url", "main_text AS text", "n_chars")
