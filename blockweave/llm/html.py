"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by where it stands: a logistic model, fitted to labelled pages, adds up
weights of the containers around it (their tags, and the words of their class, id, role and label; those further out count for less),
of its block's tag and of being in a link. A tag scores by its name and the kind of its place, as log-odds of lying within the main text of the labelled pages, and
never above a small negative. One linear scan finds the contiguous region with the highest sum; of equal ones it is the one that
ends first, and of these the one that starts last. Its blocks are the main text, without those of places that score below zero whatever
is in them (an advert or a form amid an article). No name decides by itself: the weights of all containers add up.
"""

from __future__ import annotations

import html as entities
import json
import math
import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import small_batches, table

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|select|button)\b(?>[^>]*)>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*))>"
    r"|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "p": BLOCK - {"body", "html"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(
        ("dt", "dd")
    ), "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}
#: Blocks whose name says nothing about their content, and tags of runs within a block, which say nothing at all.
_PLAIN = BLOCK - frozenset("article aside dialog fieldset footer form head header main menu nav section".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Labelled pages, one a line: pieces of HTML, each with whether it is main text.
PAGES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled_pages.jsonl")
#: What a container adds counts by this factor less for each container further out.
FADE = 0.5
#: Within a container that scores so much, what is left out weighs by this factor less, and does not part what stands around it.
MAIN, HOLE = 1.0, 0.05
#: Losing a word of an article costs so many times what keeping another word does.
KEEPING = 2.0
#: Labelled pages that must have a name before it has a weight.
LEAST_PAGES = 3
#: Bounds of a word's score; outside words weigh less than inside ones, so that an advert does not part an article.
WORST, BEST = -0.5, 1.0


@lru_cache(maxsize=1 << 14)
def container(tag: str, attributes: str) -> frozenset:
    """What a tag says about its content: its name, and of each class, id, role and label the last word and those before it."""
    if tag in _INLINE:
        return frozenset()
    out = set() if tag in _PLAIN else {f"tag:{tag}"}
    if tag not in ("html", "body") and attributes:
        if _HIDDEN.search(attributes):
            out.add("hidden")
        for a, b, c in _ATTRIBUTE.findall(attributes):
            for name in (a or b or c).split():
                ws = [w.lower() for w in _NAME.findall(name)]
                out.update(f"before:{w}" for w in ws[:-1])
                out.update(f"name:{w}" for w in ws[-1:])
    return frozenset(out)


class Place:
    """A container that says something, and the one around it; with a score where weights are known."""

    __slots__ = ("around", "main", "own", "score")

    def __init__(self, around: Place | None = None, own: frozenset = frozenset(), score: float = 0.0):
        self.around, self.own, self.score = around, own, score
        self.main = score >= MAIN or (around is not None and around.main)


def _unended(mark: re.Match) -> bool:
    """Whether a comment or raw text lacks its end, so that the rest of the page is part of it."""
    text = mark[0]
    if text.startswith("<!--"):
        return not text.endswith("-->")
    if text.startswith("<![CDATA["):
        return not text.endswith("]]>")
    return mark[1] is not None and not re.search(rf"</{mark[1]}\s*>$", text, re.I)


def scan(page: str, weights: Weights | None = None):
    """Yields (text, None) for text and (None, tag) for tags, each with the place, the block's tag and the link flag."""
    nothing = Place()
    stack: list[tuple[str, Place]] = []
    link, at = 0, 0

    def state():
        block = next((t for t, _ in reversed(stack) if t in BLOCK), "")
        return (stack[-1][1] if stack else nothing), block, link > 0

    now = state()
    limit = page.rfind(">") + 1  # no tag ends beyond it, so none is looked for there
    whole = True
    for m in _MARK.finditer(page, 0, limit):
        whole = m.end() < limit or not _unended(m)
        if m.start() > at:
            yield page[at : m.start()], None, now
        at = m.end()
        if m[1]:
            yield None, m[1].lower(), now
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if stack and stack[-1][0] == tag or any(t == tag for t, _ in stack):
                if tag in BLOCK or tag == "a" or stack[-1][0] == tag:
                    while stack:
                        t, _ = stack.pop()
                        link -= t == "a"
                        if t == tag:
                            break
                else:  # an inline end tag out of order closes only its own
                    k = max(i for i, (t, _) in enumerate(stack) if t == tag)
                    if not any(t in BLOCK for t, _ in stack[k + 1 :]):
                        del stack[k]
            yield None, "/" + tag, now  # an end tag belongs to the place that it ends
            now = state()
            continue
        if tag in BLOCK:
            while stack:  # what this tag closes by itself
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
                if k is None or stack[k][0] not in _CLOSES or tag not in _CLOSES[stack[k][0]]:
                    break
                link -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]
        if tag == "a":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in BLOCK:
                    break
                if stack[i][0] == "a":
                    del stack[i]
                    link -= 1
        if tag not in VOID and not m[4].endswith("/"):
            place, own = (stack[-1][1] if stack else nothing), container(tag, m[4])
            if own:
                place = Place(place, own, weights.deeper(own, place.score) if weights else 0.0)
            stack.append((tag, place))
            link += tag == "a"
        now = state()
        yield None, tag, now
    if at < len(page) and whole:
        comment = page.find("<!--", at)
        yield page[at : comment if comment >= 0 else len(page)], None, now


# ---- weights from labelled pages -----------------------------------------------


def labelled_pages(path: str = PAGES) -> list[list[tuple[str, bool]]]:
    with open(path, encoding="utf-8") as f:
        return [[(piece, bool(main)) for piece, main in json.loads(line)] for line in f if line.strip()]


class Weights:
    """place: of what a container says; block: of (block tag, in a link); tags: of (tag, whether its place scores above 0)."""

    def __init__(self, place: dict, block: dict, tags: dict, base: float):
        self.place, self.block, self.tags, self.base = place, block, tags, base

    def deeper(self, own: frozenset, around: float) -> float:
        """The score of a place within one that scores ``around``; a container of which nothing is known changes nothing."""
        known = [self.place[x] for x in own if x in self.place]
        return math.fsum(known) + FADE * around if known else around

    def inside(self, place: Place) -> bool:
        return self.base + place.score > 0

    def word(self, place: Place, block: str, link: bool) -> float:
        of_block = self.block.get((block, link), self.block.get(("", link), 0.0))
        score = max(WORST, min(BEST, (self.base + place.score + of_block) / 2))
        return score * HOLE if place.main and score < 0 and not self.inside(place) else score

    def tag(self, tag: str, place: Place) -> float:
        inside = self.inside(place)
        score = self.tags.get((tag, inside), -0.05 if inside else -0.2)
        return score * HOLE if place.main and not inside else score


def _logistic(x: np.ndarray, offset: np.ndarray, weight: np.ndarray, target: np.ndarray, l2: float, steps: int = 12) -> np.ndarray:
    """A logistic model's coefficients by Newton's method from zero, each step bounded."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + l2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, gradient), -4, 4)
    return w


def learn(pages=None, l2: float = 3e-5) -> Weights:
    """Logistic models of words, of containers and then of blocks; log-odds of tags by kind of place."""
    words: list[tuple[Place, str, bool, bool, float]] = []
    tags, in_pages = [], Counter()
    pages = pages or labelled_pages()
    for page in pages:
        bounds, text = [], ""
        for piece, main in page:
            bounds.append((len(text), main))
            text += piece
        at, names = 0, set()
        for t, tag, (place, block, link) in scan(text):
            names |= place.own
            at = text.find(t, at) if t is not None else at
            main = next(m for start, m in reversed(bounds) if start <= at)
            if t is None:
                tags.append((tag, place, main))
                at += 1
                continue
            if n := len(t.split()):
                words.append((place, block, link, main, math.sqrt(n)))
            at += len(t)
        in_pages.update(names)
    names = sorted(x for x, n in in_pages.items() if n >= min(LEAST_PAGES, len(pages)))
    column = {x: k for k, x in enumerate(names)}
    known: dict[int, np.ndarray] = {}

    def said(place: Place | None) -> np.ndarray:
        if place is None:
            return np.zeros(len(names) + 1)
        if id(place) not in known:
            around, own = said(place.around), [column[x] for x in place.own if x in column]
            if own:
                around = around * FADE
                around[own] += 1
            around[-1] = 1
            known[id(place)] = around
        return known[id(place)]

    weight = np.array([n for *_, n in words])
    target = np.array([float(main) for *_, main, _ in words])
    for main, cost in ((0.0, 1.0), (1.0, KEEPING)):  # both kinds weigh the same but for KEEPING
        weight[target == main] *= cost / max(1e-9, weight[target == main].sum())
    weight /= weight.sum()
    # Containers first, alone: that a menu's words are in links is no reason to hold less against the menu.
    x = np.stack([said(place) for place, *_ in words])
    place = _logistic(x, np.zeros(len(words)), weight, target, l2)
    blocks = sorted({(block, link) for _, block, link, _, _ in words} | {("", False), ("", True)})
    column = {b: k for k, b in enumerate(blocks)}
    y = np.zeros((len(words), len(blocks)))
    for row, (_, block, link, _, _) in enumerate(words):
        y[row, [column[(block, link)], column[("", link)]]] = 1  # one shared by the blocks, so that an unseen one has a weight
    w = _logistic(y, x @ place, weight, target, l2)
    of = {b: float(w[column[("", b[1])]] + (w[column[b]] if b[0] else 0.0)) for b in blocks}
    out = Weights({n: float(v) for n, v in zip(names, place, strict=False)}, of, {}, float(place[-1]))
    inside, outside = Counter(), Counter()
    for tag, of_tag, main in tags:
        (inside if main else outside)[tag, bool(said(of_tag) @ place > 0)] += 1
    for key in {*inside, *outside}:
        out.tags[key] = max(-2.0, min(-0.05, math.log((inside[key] + 0.5) / (outside[key] + 0.5))))
    return out


def best_region(before: list[float], scores: list[float]) -> tuple[int, int]:
    """[start, end) of the blocks with the highest sum of scores and of the tags between them; (0, 0) if none is above 0.

    before[k] is the score of the tags ahead of block k. Of equal regions the one that ends first, of these the one that starts last.
    """
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for k, (tags, score) in enumerate(zip(before, scores, strict=True)):
        if total + tags <= 0:
            total, start = 0.0, k
        else:
            total += tags
        total += score
        if total > best:
            best, best_range = total, (start, k + 1)
    return best_range


def score_blocks(page: str, weights: Weights) -> tuple[list[float], list[float], list[str], list[bool]]:
    """Of each block: the score of the tags ahead of it and of its words, its text, and whether its place scores above 0."""
    before: list[float] = []
    scores: list[float] = []
    texts: list[str] = []
    kept: list[bool] = []
    text: list[str] = []
    tags = words = 0.0
    here = False

    def close():
        nonlocal tags, words, text
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                before.append(tags)
                scores.append(words)
                texts.append(joined)
                kept.append(here)
                tags = words = 0.0
            text = []

    for t, tag, (place, block, link) in scan(page, weights):
        if tag is None:
            if weights.inside(place) != here:
                close()
                here = not here
            text.append(entities.unescape(t))
            words += len(t.split()) * weights.word(place, block, link)
            continue
        name = tag.removeprefix("/")
        if name == "br":
            text.append(" ")
        elif name in BLOCK:
            close()
        tags += weights.tag(tag, place)
    close()
    return before, scores, texts, kept


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks in order, joined by a line feed; empty if nothing scores above 0."""
    if not page:
        return ""
    before, scores, texts, kept = score_blocks(page, weights)
    start, end = best_region(before, scores)
    return "\n".join(t for t, k in zip(texts[start:end], kept[start:end], strict=True) if k)


def main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), pages=None) -> DataFrame:
    """The columns of ``keep``, then text and n_chars: a row for each row of df.

    A null or empty page, and one without content, has the text "" of 0 code points. Of regions with equal scores the one that
    ends first is taken, of these the one that starts last. Nulls in kept columns and repeated rows pass through. Columns that are not named are not read; an empty table gives no rows. ``pages`` are labelled
    pages to learn from in place of the built-in ones.
    """
    small_batches(df)
    weights = learn(pages)
    schema = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                texts = [extract(h, weights) for h in part.html]
                yield pd.DataFrame(
                    {f"k{i}": part[f"k{i}"].to_numpy() for i in range(len(keep))} | {"text": texts, "n_chars": [len(t) for t in texts]}
                )

    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("html")).mapInPandas(run, schema)
    return out.toDF(*keep, "text", "n_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
