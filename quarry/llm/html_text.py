"""Main text of HTML pages from flat text blocks.

The page is read once into flat blocks of text, cut at block-level tags, with the words of each block and how many of them stand in links.
A block is described by its word count and link density and those of the blocks before and after it; a decision tree over these
six numbers, grown (Gini, numpy) from the small labelled table `LABELLED`, says which blocks are content. The page's text is its
content blocks, one to a line.

Edge cases: null html gives null text and no blocks; an empty page, or one without text, gives an empty text; unclosed and stray tags,
comments and quotes are read as browsers do, roughly: a head needs no end tag, <svg/> is empty; markup in scripts and attribute values is ignored; very long pages are one
pass; repeated rows are each extracted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_only, text_udf

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text isn't shown, skipped from tag to end tag; one that is never closed is not skipped. Raw text (in _TAG) runs to the end of the page.
HIDDEN = frozenset("noscript template svg math object select".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|(<(script|style|iframe|textarea|title)\b[^>]*>).*?(?:</\2\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?][^>]*>""",
    re.S | re.I,
)
#: The rest of a tag; a `>` in a quoted value of any length doesn't end it.
_REST = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^>"'])*+>""")


def tags(page: str) -> Iterator[tuple[int, int, str, bool]]:
    """(from, to, name, whether it ends) of each piece of markup, hidden elements and raw text as one piece; the name is empty for what is no tag."""
    found: list[tuple[int, int, str, bool]] = []
    till: dict[int, int] = {}  # hidden element -> its end tag
    opened: dict[str, list[int]] = {}
    at, quotes = 0, True
    while m := _TAG.search(page, at):
        at = m.end()
        name, ends = (m[2] or m[4] or "").lower(), bool(m[3])
        if m[4]:
            rest = _REST.match(page, at) if quotes else None
            if rest is None:  # a quote is never closed: from here on quotes mean nothing, so a page is scanned once
                quotes, end = False, page.find(">", at)
                if end < 0:
                    continue
            at = rest.end() if rest else end + 1
        if m[1] and m[1].endswith("/>") and (opened.get("svg") or opened.get("math")):
            at = m.end(1)  # closed in itself, as anything may be there
        if name in HIDDEN:
            if not ends and not (name in ("svg", "math") and page.startswith("/>", at - 2)):
                opened.setdefault(name, []).append(len(found))
            elif ends and opened.get(name):
                till[opened[name].pop()] = len(found)
        found.append((m.start(), at, name, ends))
    k = 0
    while k < len(found):
        begin, _, name, ends = found[k]
        k = till.get(k, k)
        yield begin, found[k][1], name, ends
        k += 1


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each block that has words."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if parts:
            ws = html.unescape("".join(parts)).split()
            if ws:
                out.append((" ".join(ws), len(ws), min(len(ws), len(html.unescape("".join(linked)).split()))))
            parts.clear()
            linked.clear()

    at = 0
    for begin, end, tag, ends in tags(page):
        if begin > at:
            parts.append(page[at:begin])
            if in_link:
                linked.append(page[at:begin])
        at = end
        if not tag or tag in ("script", "style", "noscript", "template", "svg", "math"):
            continue
        if tag == "a":
            in_link = not ends
            if in_link:
                linked.append(" ")
        elif tag == "br":
            parts.append(" ")
            linked.append(" " if in_link else "")
        elif tag not in INLINE:
            flush()
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(page[at:])
    flush()
    return out


def described(found: list[tuple[str, int, int]]) -> np.ndarray:
    """words before, words, words after, link density before, here, after; 0 beyond the ends."""
    n = np.array([0, *[w for _, w, _ in found], 0], float)
    d = np.array([0, *[k / w for _, w, k in found], 0], float)
    return np.stack([n[:-2], n[1:-1], n[2:], d[:-2], d[1:-1], d[2:]], 1) if found else np.zeros((0, 6))


#: words before, here, after; link density before, here, after (in hundredths); content or not. Typical neighbourhoods of
#: navigation, teasers, headlines, paragraphs, captions, comments, advertisements and footers.
LABELLED = [
    (0, 1, 1, 0, 100, 100, 0), (1, 1, 1, 100, 100, 100, 0), (1, 1, 2, 100, 100, 100, 0), (2, 1, 4, 100, 100, 0, 0), (1, 2, 9, 100, 100, 0, 0),
    (3, 2, 3, 100, 100, 100, 0), (0, 6, 5, 0, 100, 100, 0), (5, 8, 6, 100, 100, 100, 0), (12, 10, 11, 100, 90, 100, 0), (14, 16, 15, 80, 85, 90, 0),
    (0, 24, 8, 0, 100, 0, 0), (1, 30, 12, 100, 70, 0, 0), (9, 42, 4, 100, 62, 50, 0), (0, 3, 2, 0, 0, 100, 0), (0, 5, 1, 0, 0, 100, 0),
    (1, 4, 8, 100, 0, 0, 0), (1, 5, 12, 100, 0, 0, 0), (1, 6, 11, 100, 0, 0, 0), (1, 8, 7, 100, 0, 0, 0), (2, 9, 13, 100, 0, 0, 0), (1, 7, 20, 100, 0, 0, 0),
    (1, 3, 5, 100, 0, 0, 0), (1, 10, 16, 100, 0, 0, 0), (2, 12, 8, 100, 0, 0, 0), (1, 11, 24, 100, 0, 0, 0), (2, 8, 40, 100, 0, 0, 0),
    (4, 8, 60, 0, 0, 0, 1), (5, 12, 90, 0, 0, 0, 1), (7, 11, 140, 0, 0, 0, 1), (8, 6, 75, 0, 0, 0, 1), (6, 16, 210, 0, 0, 0, 1), (9, 20, 55, 0, 0, 0, 1),
    (3, 9, 48, 0, 0, 5, 1), (10, 13, 120, 0, 0, 0, 1), (8, 5, 300, 0, 0, 0, 1), (12, 7, 44, 0, 0, 0, 1), (5, 10, 33, 0, 0, 0, 1), (2, 7, 38, 50, 0, 2, 1),
    (8, 60, 40, 0, 0, 0, 1), (12, 90, 70, 0, 2, 0, 1), (11, 140, 12, 0, 0, 0, 1), (75, 40, 90, 0, 0, 0, 1), (16, 210, 18, 0, 0, 0, 1), (20, 55, 60, 0, 6, 0, 1),
    (60, 35, 80, 0, 10, 0, 1), (45, 28, 36, 5, 0, 12, 1), (13, 120, 14, 0, 1, 0, 1), (90, 24, 100, 0, 0, 0, 1), (5, 300, 9, 0, 0, 0, 1), (7, 44, 6, 0, 0, 80, 1),
    (10, 33, 29, 0, 15, 0, 1), (120, 31, 2, 0, 0, 100, 1), (9, 26, 30, 0, 0, 0, 1), (1, 80, 30, 100, 0, 0, 1), (2, 65, 3, 100, 3, 100, 1), (1, 48, 52, 100, 0, 0, 1),
    (0, 70, 0, 0, 0, 0, 1), (0, 36, 44, 0, 0, 0, 1), (0, 150, 0, 0, 4, 0, 1), (50, 10, 60, 0, 0, 0, 1), (64, 6, 72, 0, 0, 0, 1), (110, 14, 95, 0, 0, 0, 1),
    (80, 4, 55, 0, 0, 0, 1), (70, 18, 48, 0, 0, 0, 1), (55, 20, 1, 0, 0, 0, 1), (40, 19, 66, 0, 20, 0, 1), (38, 15, 47, 0, 0, 0, 1), (95, 22, 13, 0, 0, 0, 1),
    (60, 5, 0, 0, 20, 0, 0), (140, 9, 0, 0, 0, 0, 0), (210, 14, 0, 0, 10, 0, 0), (80, 12, 0, 0, 0, 0, 0), (300, 17, 0, 0, 0, 0, 0), (45, 20, 0, 0, 5, 0, 0),
    (33, 11, 0, 0, 0, 0, 0), (90, 8, 4, 0, 0, 100, 0), (75, 6, 1, 0, 0, 100, 0), (120, 10, 3, 0, 40, 100, 0), (55, 13, 6, 0, 60, 80, 0), (66, 3, 2, 0, 100, 100, 0),
    (18, 12, 0, 0, 0, 0, 0), (9, 15, 0, 0, 0, 0, 0), (30, 19, 0, 0, 0, 0, 0), (3, 14, 0, 100, 0, 0, 0), (2, 10, 1, 100, 30, 100, 0), (1, 20, 0, 100, 0, 0, 0),
    (6, 5, 7, 0, 0, 0, 0), (4, 6, 3, 0, 0, 0, 0), (8, 9, 5, 0, 0, 0, 0), (5, 3, 4, 50, 0, 50, 0), (12, 8, 6, 0, 0, 0, 0), (7, 12, 9, 0, 0, 0, 0),
    (22, 33, 5, 0, 0, 0, 1), (45, 31, 1, 0, 0, 0, 1), (9, 31, 34, 0, 0, 0, 1), (17, 16, 22, 0, 0, 0, 1), (14, 22, 20, 0, 0, 0, 1), (61, 29, 15, 0, 0, 0, 1),
    (6, 20, 2, 0, 0, 0, 1), (29, 41, 8, 0, 0, 0, 1), (10, 41, 17, 0, 3, 0, 1), (5, 34, 4, 0, 0, 0, 1), (14, 35, 17, 0, 0, 0, 1), (32, 42, 9, 0, 0, 0, 1),
    (8, 17, 33, 0, 0, 0, 1), (35, 25, 17, 0, 5, 0, 1), (20, 27, 11, 0, 0, 0, 1), (94, 36, 18, 0, 0, 0, 1), (24, 36, 16, 0, 0, 10, 1), (40, 23, 12, 0, 0, 0, 1),
    (50, 21, 0, 0, 0, 0, 1), (12, 38, 0, 0, 0, 0, 1), (28, 9, 31, 0, 0, 0, 1), (31, 7, 24, 0, 0, 0, 1), (22, 12, 19, 0, 0, 0, 1), (44, 3, 27, 0, 0, 0, 1),
    (26, 11, 13, 0, 0, 0, 1), (36, 16, 9, 0, 0, 0, 1), (18, 14, 21, 0, 0, 0, 1), (53, 18, 8, 0, 0, 0, 1), (8, 11, 14, 0, 0, 0, 1), (7, 6, 30, 0, 0, 0, 1),
    (60, 25, 3, 0, 45, 100, 0), (48, 30, 5, 0, 55, 100, 0), (70, 22, 12, 0, 80, 60, 0), (20, 40, 18, 60, 50, 70, 0), (100, 35, 40, 0, 50, 90, 0), (15, 28, 31, 90, 75, 70, 0),
]


@dataclass
class Node:
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None
    content: bool = False


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """Splits at the threshold with the least Gini impurity; the first of equals, so the tree is determined."""
    p = y.mean() if len(y) else 0.0
    node = Node(content=bool(p > 0.5))
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * least:
        return node
    best = (2 * p * (1 - p) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[:-1] + v[1:]) / 2:
            low = x[:, f] <= t
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            g = 2 * a * (1 - a) * n + 2 * b * (1 - b) * (len(y) - n)
            if g < best[0] - 1e-12:
                best = (g, f, float(t))
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grown(x[low], y[low], depth - 1, least), grown(x[~low], y[~low], depth - 1, least))


def trained(table=LABELLED) -> Node:
    t = np.array(table, float)
    x = t[:, :6].copy()
    x[:, 3:] /= 100
    return grown(x, t[:, 6])


def classified(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node: Node, rows: np.ndarray) -> None:
        if node.feature < 0:
            out[rows] = node.content
        elif len(rows):
            low = x[rows, node.feature] <= node.at
            walk(node.left, rows[low])
            walk(node.right, rows[~low])

    walk(tree, np.arange(len(x)))
    return out


def extracted(pages: DataFrame, table=LABELLED) -> DataFrame:
    """page_id, blocks, content_blocks, text."""
    tree = trained(table)

    def f(v: pa.Array) -> pa.Array:
        found = [None if t is None else blocks(t) for t in v.to_pylist()]
        sizes = [len(x or ()) for x in found]
        verdict = classified(tree, np.concatenate([np.zeros((0, 6)), *[described(x) for x in found if x]]))
        rows, at = [], 0
        for x, n in zip(found, sizes):
            keep = verdict[at : at + n]
            at += n
            rows.append(None if x is None else {"blocks": n, "content_blocks": int(keep.sum()), "text": "\n".join(b[0] for b, k in zip(x, keep) if k)})
        return pa.array(rows, pa.struct([("blocks", pa.int32()), ("content_blocks", pa.int32()), ("text", pa.string())]))

    x = text_udf(f, "struct<blocks: int, content_blocks: int, text: string>")
    df = docs_only(pages, "page_id", "html").select("page_id", x("html").alias("x"))
    return df.select("page_id", F.coalesce("x.blocks", F.lit(0)).alias("blocks"), F.coalesce("x.content_blocks", F.lit(0)).alias("content_blocks"), "x.text")
