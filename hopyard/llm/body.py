"""The main body of a page: text-to-tag ratios by line, smoothed, clustered, and summed by region."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopyard.llm import pages, residue

SIGMA = 1.5
#: What sites say around their texts: how such a line begins, and what one about cookies goes on with.
FURNITURE = re.compile(
    r"(?:share|tweet|follow us|advertisement|you may also like|most read|enter your email|rate this page|back to top|tag cloud|related:|popular:|trending|sponsored|nearby:|download the app|get weekly|join [\d,.]+ readers|is this your business|report an error|powered by|site by|©|\(c\) |terms of use|must be of legal age|please drink responsibly|prices and times may change|no part of this|all rights reserved|imprint|impressum|privacy policy)"
    r"|(?:we use|usamos|wir verwenden|nous utilisons|essential|this site (?:uses|stores)|by browsing on|your privacy)\b|(?:accept|got it|ok|reject|decline)$",
    re.I,
)
COOKIES = re.compile(r"\bcookies?\b.*(?:accept|choose|always on|preferences|aceptar|zulassen|refuser)", re.I)
#: Class, id or role words of boxes that aren't the body, and of those that are.
OUTSIDE = re.compile(r"\b(?:menu|nav\w*|side-?bar|footer|bottom|promo|notice|popup|cookie\w*|cc-banner|banner|related|share|social|comments?|newsletter|breadcrumbs?)\b")
PRICE = re.compile(r"[$€£]\s?\d|\d\s?[€£]")
INSIDE = re.compile(r"\b(?:content|main|article|post|entry|body)\b")
CRUMB = re.compile(r"[^<>»›/|]{1,60}(?: (?:>|»|›|/|\|) [^<>»›/|]{1,60})+")
SENTENCE = re.compile(r"[.!?](?:\s|$)")
WORD = re.compile(r"[^\W\d_]{2,}")
#: Factors of a box's weight: for what speaks against it, and a title or message in it; and of the ratio of lines whether
#: or not they reach the threshold.
FAINT, TITLED, BELOW = 0.01, 8.0, 0.05


@lru_cache(maxsize=1 << 12)
def _outside(mark: str) -> bool:
    return bool(mark) and bool(OUTSIDE.search(mark)) and not INSIDE.search(mark)


@lru_cache(maxsize=1 << 16)
def is_furniture(text: str) -> bool:
    return bool(FURNITURE.match(text)) or "cookie" in text.lower() and bool(COOKIES.search(text))


@lru_cache(maxsize=8)
def _kernel(sigma: float) -> np.ndarray:
    r = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return kernel / kernel.sum()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """With a Gaussian of radius 3 sigma; the ends are continued by their values."""
    if not len(x):
        return x
    kernel = _kernel(sigma)
    r = len(kernel) // 2
    return np.convolve(np.concatenate([np.full(r, x[0]), x, np.full(r, x[-1])]), kernel, mode="valid")


def threshold(x: np.ndarray) -> float:
    """Middle of two clusters of the values, by 2-means from the extremes."""
    v = np.sort(x)
    sums, n = np.concatenate([[0.0], np.cumsum(v)]), len(v)
    low, high = float(v[0]), float(v[-1])
    for _ in range(50):
        k = int(np.searchsorted(v, (low + high) / 2, "right"))
        new = (sums[k] / k if k else low, (sums[n] - sums[k]) / (n - k) if k < n else high)
        if new == (low, high):
            break
        low, high = new
    return float(low + high) / 2


def text_to_tag(page: pages.Page) -> np.ndarray:
    """Characters of visible text per tag of each line; a line without a tag counts as one tag."""
    last = max(max(p.line for p in page.pieces), max(page.tags_on, default=1))
    chars = [0] * (last + 1)
    for line, text, _, _ in page.pieces:
        chars[line] += len(text)
    tags = [1] * (last + 1)
    for line, n in page.tags_on.items():
        tags[line] = n
    return np.array(chars[1:], float) / np.array(tags[1:], float)


def main_boxes(page: pages.Page) -> set[int]:
    """The numbers of the boxes that hold the body; empty for a page without text.

    Lines whose smoothed text-to-tag ratio lies above the threshold of two clusters mark the regions of content: a box
    weighs what its lines stand above the threshold, and a little for the ratio of all its lines, which alone tells of
    pages whose body is too short to reach the threshold. What else a box shows (links, what sites say around their
    texts) lowers its weight, a title or a message raises it; a sidebar or menu by its tag or name is body only
    where all boxes are.
    """
    if not page.pieces:
        return set()
    level = smooth(text_to_tag(page))
    excess, level = (level - threshold(level)).tolist(), level.tolist()
    weight: dict[int, tuple[float, float]] = {}
    pieces: dict[int, list[pages.Piece]] = {}
    for p in page.pieces:
        pieces.setdefault(p.box, []).append(p)
        above, all_ = weight.get(p.box, (0.0, 0.0))
        weight[p.box] = above + max(0.0, excess[p.line - 1]), all_ + level[p.line - 1]
    outside: dict[int, bool] = {-1: False}

    def is_outside(b: int) -> bool:
        if b not in outside:
            box = page.boxes[b]
            outside[b] = box.tag in pages.ASIDE or _outside(box.mark) or is_outside(box.parent)
        return outside[b]

    def linked(own: list[pages.Piece]) -> float:
        return sum(len(p.text) for p in own if p.kind & pages.LINK) / max(1, sum(len(p.text) for p in own))

    def furnished(own: list[pages.Piece]) -> bool:
        return sum(is_furniture(p.text) for p in own) * 3 >= len(own)

    def value(b: int) -> tuple:
        own, w = pieces[b], 1.0
        if linked(own) >= 0.7:
            w *= FAINT
        if furnished(own):
            w *= FAINT
        if any(p.kind & pages.TITLE or residue.is_error(p.text) for p in own):
            w *= TITLED
        return not is_outside(b), (weight[b][0] + BELOW * weight[b][1]) * w, -b

    best = max(weight, key=value)
    found = {best}

    def priced(own: list[pages.Piece]) -> bool:
        return 2 * sum(bool(PRICE.search(p.text)) for p in own) >= len(own)

    # Boxes within it: a list of items belongs to it; a single teaser set between its paragraphs doesn't.
    for b in sorted(pieces):
        own, box = pieces[b], page.boxes[b]
        if box.parent in found and b != best and not box.mark and not is_outside(b) and len(own) > 1 and not furnished(own) and (linked(own) < 0.7 or priced(own)):
            found.add(b)
    return found


def _is_crumb(own: list[pages.Piece], text: str) -> bool:
    """A way of links: a link, then a sign that leads on."""
    return bool(own[0].kind & pages.LINK) and len(own) > 1 and bool(CRUMB.fullmatch(text))


def _is_link(own: list[pages.Piece], text: str) -> bool:
    """A line that is nothing but a link, as in menus of a site; an item with its price or a sentence may be linked too."""
    return all(p.kind & pages.LINK or p.text in "|·•-–/" for p in own) and not PRICE.search(text) and not SENTENCE.search(text)


def lines_of(page: pages.Page, boxes: set[int]) -> dict[int, list[pages.Piece]]:
    """The pieces in some boxes, by line."""
    own: dict[int, list[pages.Piece]] = {}
    for p in page.pieces:
        if p.box in boxes:
            own.setdefault(p.line, []).append(p)
    return own


def body_lines(html: str) -> list[int]:
    """The numbers of the lines that carry the body's text."""
    page = pages.read(html)
    own = lines_of(page, main_boxes(page))
    texts = {n: ps[0].text if len(ps) == 1 else " ".join(p.text for p in ps) for n, ps in own.items()}
    kept = [n for n, t in texts.items() if not (is_furniture(t) or _is_crumb(own[n], t) or _is_link(own[n], t) or residue.is_filler(t))]
    bad = {n for n in kept if residue.is_error(texts[n])}
    if bad and residue.is_notice([texts[n] for n in kept if n not in bad], [texts[n] for n in bad]):
        return []
    # A field with nothing around it is no text.
    bare = {n for n in kept if residue.is_placeholder(texts[n]) and len(WORD.findall(residue.PLACEHOLDER.sub(" ", texts[n]))) < 3}
    kept = [n for n in kept if n not in bare]
    if all(all(p.kind & pages.HEADING for p in own[n]) for n in kept):
        return []
    return sorted(kept)


def main_lines(df: DataFrame, page: str, html: str) -> DataFrame:
    """(page, line_no): the lines of each page, counted from 1, that carry its main body. One pass over the pages, no
    shuffle. Null, blank and broken html has the lines that can be read, or none; further columns play no part."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines = [(key, n) for key, text in zip(part["page"], part["html"]) for n in body_lines(text)]
            yield pd.DataFrame(lines, columns=["page", "line_no"])

    kind = dict(df.dtypes)[page]
    src = df.where(F.trim(F.coalesce(html, F.lit(""))) != "").select(F.col(page).alias("page"), F.col(html).alias("html"))
    return src.mapInPandas(run, f"page {kind}, line_no int").withColumnRenamed("page", page)
