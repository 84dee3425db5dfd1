"""Main text of web pages by tag-path ratios.

A page is read as blocks of text in page order, each with its root-to-leaf path of block tags. Text length and punctuation are summed per path
and divided by the path's blocks. Both ratios are smoothed along the page between neighbours under the same parent (so that a
heading gains from the paragraphs around it), averaged per path and fused. Linked text takes away from a path. The ratios of the
blocks also choose the main container, that where they sum up high and are dense; a path outside it counts by the squared share of its own
branch. Paths below a share of the page's best score are dropped.

Tags and names that announce something else than the article (menus, footers, adverts, forms, comments, ...) are a prior: they make a
path's score 25 times smaller. Only what a browser doesn't show is left out at once.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, small_batches

#: Share of the best path's score that a path needs; the factor of tags and names that announce something else.
LEAST_SHARE, PRIOR = 0.1, 0.04
#: What linked text takes away from a path inside <article> or <main>, where a list of links may be text; elsewhere it takes all.
LINKED = 0.7
#: Smoothing over blocks at distance 0, 1, 2, ... under the same parent.
KERNEL = tuple(0.7**k for k in range(7))
#: How much a container's mean ratio counts beside their sum.
DENSE = 2

#: Elements by their part in HTML.
RAW = frozenset("script style noscript template iframe svg math object textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt s samp small span strike strong sub sup time tt u var".split())
OTHER = frozenset("nav aside footer form button select dialog menu fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: What closes what, where end tags may be left out.
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ROOTS = frozenset("ul ol dl table select menu".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption caption address".split())
#: Words of class, id or role (parts between hyphens or underscores) that announce something else than the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner sidebar comment comments commentlist disqus reply replies respond discussion "
    "footer masthead nav navbar navigation menu toc breadcrumb breadcrumbs skiplink pager pagination cookie cookies consent gdpr notice alert popup modal overlay dialog "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget contentinfo complementary byline tags cta feedback".split()
)
#: Whole names of that kind.
NAMED_WHOLE = frozenset("header site-header page-header top-header".split())

TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+|[^<>]*)>|(!--)|[!?/][^>]*>)")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


def names_other(attributes: str) -> bool:
    """Whether class, id or role announce something else than the article."""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if name in NAMED_WHOLE or not NAMED.isdisjoint(re.split(r"[^a-z0-9]+", name)):
                return True
    return False


class Page:
    """Blocks of a page (text, path, link characters); for each path its parent, its prior, whether it is inside an article and whether it is shown."""

    def __init__(self, source: str):
        self.paths: dict[tuple, int] = {}
        self.parent, self.prior, self.inside, self.hidden = [-1], [1.0], [False], [False]
        self.blocks: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.depths: dict[str, list[int]] = {}  # where on the stack a tag is open
        self.parts: list[str] = []
        self.links = self.link_chars = 0
        self.read(source)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join(html.unescape("".join(self.parts)).split()):
                self.blocks.append((text, self.stack[-1][1], self.link_chars))
            self.parts, self.link_chars = [], 0

    def add(self, text: str) -> None:
        if text and not self.hidden[self.stack[-1][1]]:
            self.parts.append(text)
            if self.links:
                self.link_chars += len(text)

    def nearest(self, tags) -> int:
        """Where on the stack the innermost of tags is open; 0 if none is."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def pop_to(self, depth: int) -> None:
        self.flush()
        while len(self.stack) > depth:
            self.depths[self.stack.pop()[0]].pop()

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.stack[-1][0] == "p":
            self.pop_to(len(self.stack) - 1)
        if tag in SAME_KIND and (depth := self.nearest(SAME_KIND[tag])) > self.nearest(LIST_ROOTS):
            self.pop_to(depth)
        up = self.stack[-1][1]
        other = tag in OTHER or (tag == "header" and not self.inside[up]) or (bool(attributes) and tag not in (*ARTICLE, "html", "body") and names_other(attributes))
        hidden = self.hidden[up] or tag == "head" or (bool(attributes) and HIDDEN.search(attributes) is not None)
        own = len(self.parent) if tag not in LEAVES else -1  # containers of one name are apart, leaves under a parent are one path
        key = (up, tag, other, hidden, own)
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = len(self.parent)
            self.parent.append(up)
            self.prior.append(self.prior[up] * (PRIOR if other else 1.0))
            self.inside.append(self.inside[up] or tag in ARTICLE)
            self.hidden.append(hidden)
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path))

    def close(self, tag: str) -> None:
        """End the innermost such element; an end tag inside an article reaches nothing around it."""
        depth = self.nearest((tag,))
        if depth and (tag in ("body", "html") or depth >= self.nearest(ARTICLE)):
            self.pop_to(depth)
        elif tag == "p":
            self.flush()

    def read(self, source: str) -> None:
        at, lower = 0, None
        while m := TAG.search(source, at):
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            if m[4]:
                end = source.find("-->", at)
                at = len(source) if end < 0 else end + 3
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in RAW:
                if not m[1]:
                    lower = source.lower() if lower is None or len(lower) != len(source) else lower
                    end = lower.find(f"</{tag}", at) if len(lower) == len(source) else source.find(f"</{tag}", at)
                    at = len(source) if end < 0 else end
            elif tag in INLINE:
                if tag == "a":
                    self.links = 0 if m[1] else 1
            elif tag in VOID:
                self.parts.append(" ")
                if tag == "hr":
                    self.flush()
            elif m[1]:
                self.links = 0
                self.close(tag)
            else:
                self.links = 0
                self.open(tag, m[3])
        self.add(source[at:])
        self.flush()


def smoothed(value: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Means of each block's neighbourhood by KERNEL, among blocks of the same parent."""
    n, total, weight = len(value), np.zeros(len(value)), np.zeros(len(value))
    for shift in range(1 - len(KERNEL), len(KERNEL)):
        if n > abs(shift):
            a, b = slice(max(0, shift), n + min(0, shift)), slice(max(0, -shift), n + min(0, -shift))
            same = (parent[a] == parent[b]) * KERNEL[abs(shift)]
            total[a] += value[b] * same
            weight[a] += same
    return total / weight


def branches(parent: np.ndarray, path: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """For every path 1 inside the main container, else the share of the ratios in the largest branch above it (or itself) that is outside.

    The main container is the path with the largest sum of its blocks' ratios times their mean to the power DENSE: much text, and little beside it.
    Of equal ones the outer one is meant.
    """
    many = len(parent)
    total, blocks = np.bincount(path, ratio, many), np.bincount(path, minlength=many).astype(float)
    for p in range(many - 1, 0, -1):  # a path comes behind its parent
        total[parent[p]] += total[p]
        blocks[parent[p]] += blocks[p]
    inner = np.unique(np.maximum(parent, 0))  # paths of other paths
    main = int(inner[(total * (total / np.maximum(blocks, 1)) ** DENSE)[inner].argmax()])
    above, at = {main}, main
    while at > 0:
        at = int(parent[at])
        above.add(at)
    alone = np.bincount(path, ratio, many)
    share = np.zeros(many)
    for p in range(many):
        up = parent[p]
        if p == main or (p and share[up] == 1 and (up == main or up not in above)):
            share[p] = 1
        elif p in above:
            share[p] = alone[p] / max(total[0], 1e-9)
        else:
            share[p] = max(total[p] / max(total[0], 1e-9), share[up] if up not in above else 0)
    return share


def path_scores(page: Page) -> np.ndarray:
    """Fused, smoothed ratio of every path of the page."""
    path = np.array([p for _, p, _ in page.blocks])
    up = np.array(page.parent)
    parent, many = up[path], len(up)
    length = np.array([len(t) for t, _, _ in page.blocks], float)
    linked = np.array([min(k, len(t)) for t, _, k in page.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t, _, _ in page.blocks], float)
    blocks = np.maximum(np.bincount(path, minlength=many), 1)
    fused = np.ones(many)
    for ratio in (np.bincount(path, length, many) / blocks, np.bincount(path, marks, many) / blocks + 1):
        fused *= np.sqrt(np.bincount(path, smoothed(ratio[path], parent), many) / blocks)
    share = np.bincount(path, linked, many) / np.maximum(np.bincount(path, length, many), 1)
    own = np.sqrt((length - linked) * (marks + 1)) * np.array(page.prior)[path]
    return fused * (1 - np.where(page.inside, LINKED, 1.0) * share) * np.array(page.prior) * branches(up, path, own) ** 2


def main_text(source: str | None) -> str:
    """The article's blocks, joined by blank lines; empty where the page has none."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    score = path_scores(page)
    least = LEAST_SHARE * max(score[p] for _, p, _ in page.blocks)
    return "\n\n".join(t for t, p, _ in page.blocks if score[p] > 0 and score[p] >= least)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded; white space inside a block is one space; blocks are joined in page order by two
    line breaks. A null or empty html, and a page without article text, give the empty text. Unclosed tags, comments
    and scripts end with the page. Repeated rows are read each; null ids and urls stay null; other columns are not read.
    """
    small_batches(pages.sparkSession)

    def run(rows: dict[str, list]) -> dict[str, list]:
        text = [main_text(h) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": list(map(len, text))}

    return arrow_rows(pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
