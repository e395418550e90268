"""Main text of web pages by minimum-cut labelling.

A page's text blocks are the nodes of a graph. A classifier's costs for calling a block content or
boilerplate are the capacities to the two terminals; blocks that follow one another, and blocks
that stand close in the document tree, are joined by smoothness edges. The minimum cut, found by
maximum flow, is the labelling of least total cost.

The classifier is a logistic regression trained here, on about fit_pages pages, from what their
authors mark up: blocks within article or main elements are content, those within navigation,
asides, footers, forms and elements named after adverts, menus, notices or comments are not. Each
such block is learnt twice, with and without its mark, so that length, links, punctuation and
place decide where a page has no marks.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, short_batches

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript svg math iframe object select option textarea button canvas audio video datalist".split())
GOOD = frozenset(["article", "main"])
BAD = frozenset("nav aside footer form menu dialog search".split())
BAD_NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
APART_WORDS = frozenset("has no not with without".split())
GOOD_NAMES = frozenset("article articlebody content entry main maintext post story".split())
GOOD_ROLES, BAD_ROLES = frozenset(["main", "article"]), frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Strength of the smoothness edges: between neighbours, more within one parent; between next neighbours in one parent.
NEXT, SIBLING, APART = 0.4, 0.4, 0.2
FEATURES = 12
#: Used alone where a sample holds no marks to learn from: longer, less linked, punctuated text is content.
PLAIN = np.array([-2.0, 0.6, -4.0, 1.0, 0.8, 0.8, -1.0, 4.0, -6.0, -6.0, 0.0, 0.0])


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]
    linked: int
    good: bool
    bad: bool
    comment: bool


def _names(value: str) -> set[str]:
    """The words of a class or id; within one name, what follows a word like `no` or `with` is about something else."""
    found: set[str] = set()
    for name in value.split():
        for word in _WORD.findall(_CAMEL.sub(" ", name).lower()):
            if word in APART_WORDS:
                break
            found.add(word)
    return found


class _Reader(HTMLParser):
    """Cuts a page into blocks; forgiving of elements that are never closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int, bool]] = []  # element, number, mark (1 good, -1 bad, 0), within comments
        self.hidden, self.links, self.number = 0, 0, 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            mark = next((m for _, _, m, _ in reversed(self.stack) if m), 0)
            comment = any(c for *_, c in self.stack)
            tag = next((t for t, *_ in reversed(self.stack) if t in BLOCKS), "body")
            path = tuple(n for t, n, *_ in self.stack if t in BLOCKS)
            self.blocks.append(Block(text, tag, path, min(self.linked, len(text)), mark > 0, mark < 0, comment))
        self.parts, self.linked = [], 0

    def _mark(self, tag: str, attributes) -> tuple[int, bool]:
        names: set[str] = set()
        role = ""
        for k, v in attributes:
            if k in ("class", "id") and v and tag not in ("html", "body"):
                names.update(_names(v))
            elif k == "role" and v:
                role = v.lower()
        if names & BAD_NAMES or role in BAD_ROLES or tag in BAD:
            return -1, bool(names & COMMENT_NAMES)
        if tag == "header":
            inside = any(t in GOOD for t, *_ in self.stack)
            return (0 if inside else -1), False
        return int(tag in GOOD or role in GOOD_ROLES or bool(names & GOOD_NAMES)), False

    def handle_starttag(self, tag, attributes):
        if tag in HIDDEN:
            if tag not in VOID:
                self.hidden += 1
                self.stack.append((tag, 0, 0, False))
            return
        if tag == "body" and self.hidden:  # a head left open ends here
            self.hidden, self.stack = 0, [x for x in self.stack if x[0] not in HIDDEN]
        if tag in BLOCKS:
            self.flush()
            self._close_implied(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        self.number += 1
        self.links += tag == "a"
        mark, comment = self._mark(tag, attributes)
        self.stack.append((tag, self.number, mark, comment))

    def handle_startendtag(self, tag, attributes):
        if tag in VOID:
            self.handle_starttag(tag, attributes)
        elif tag in BLOCKS:
            self.flush()

    def _close_implied(self, tag):
        open_ = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t == "p" or t in open_:
                self._cut(k)
                if t != "p":
                    return
            elif t in BLOCKS:
                return

    def _cut(self, k):
        for t, *_ in self.stack[k:]:
            self.links -= t == "a"
            self.hidden -= t in HIDDEN
        del self.stack[k:]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t == tag:
                self._cut(k)
                return
            if tag not in BLOCKS and t in BLOCKS and tag not in HIDDEN:
                return  # an inline end tag does not close a block

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, with white space folded."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), FEATURES))
    for k, b in enumerate(found):
        n = len(b.text)
        ends = sum(b.text.count(c) for c in ".,;:!?")
        place = k / max(1, len(found) - 1)
        out[k] = (1, np.log1p(n) - 3, b.linked / n, min(1.0, ends * 20 / n), b.text[-1] in ".!?…\"»”", b.tag == "p", b.tag in ("li", "td", "th", "dt", "dd"), b.good, b.bad, b.comment, b.tag[0] == "h" and b.tag[1:].isdigit(), 4 * (place - 0.5) ** 2)
    return out


def train(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards the plain weights."""
    w = PLAIN.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PLAIN)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(content: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: source side) of least cost. content[k] > 0 is the cost of not calling k content, -content[k] > 0 the reverse.

    Maximum flow by shortest augmenting phases; the source side is what the residual graph reaches.
    """
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a, b, forward, back):
        at[a].append(len(to))
        to.append(b)
        room.append(forward)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, c in enumerate(content.tolist()):
        if c > 0:
            add(source, k, c, 0.0)
        elif c < 0:
            add(k, sink, -c, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level[:n]], bool)
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= least)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(at[u]):
                e = at[u][turn[u]]
                if room[e] > least and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


def main_text(html: str, weights: np.ndarray) -> str:
    """The page's content blocks in order, joined by line ends."""
    found = blocks(html)
    if not found:
        return ""
    costs = np.clip(features(found) @ weights, -12, 12)
    edges = []
    for k in range(1, len(found)):
        same = found[k].path[:-1] == found[k - 1].path[:-1]
        edges.append((k - 1, k, NEXT + SIBLING * same))
        if k > 1 and found[k].path[:-1] == found[k - 2].path[:-1]:
            edges.append((k - 2, k, APART))
    keep = minimum_cut(costs, edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _examples(batches):
    for batch in batches:
        xs, ys = [], []
        for html in batch.column("html").to_pylist():
            found = blocks(html)
            x = features(found)
            for k, b in enumerate(found):
                if b.good or b.bad:
                    plain = x[k].copy()
                    plain[7:10] = 0
                    xs += [x[k].tolist(), plain.tolist()]
                    ys += [float(b.good and not b.comment)] * 2
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["x", "y"])


def fit(pages: DataFrame, fit_pages: int = 500, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Classifier weights learnt from about fit_pages pages, drawn by a hash of the id (the bound on what is read)."""
    short_batches(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    n = rows.count()
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) < fit_pages / max(1, n)
    found = rows.where(drawn).select("html").mapInArrow(lean(_examples), "x array<double>, y double").toPandas()
    if not len(found):
        return PLAIN
    return train(np.stack(found.x), found.y.to_numpy())


def _extract(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h or "", weights) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    A null or empty page has the empty text. Null and repeated ids and urls are kept as they are;
    other columns are not read; an empty table gives an empty result.
    """
    short_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(lean(_extract(weights)), "page_id long, url string, text string, n_chars long")
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
