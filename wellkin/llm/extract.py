"""Main text of web pages by minimum-cut labelling.

A page is read into blocks, runs of text between block-level tags, each with the containers it
stands in.  A logistic classifier gives every block the cost of calling it content or
boilerplate; the costs are capacities to the two terminals.  Neighbours on the page and
neighbours inside one container are tied by edges, so a block that looks unlike its
surroundings follows them.  The minimum cut, found by augmenting paths, separates content.

The classifier is trained on a bounded sample of pages, on the blocks whose containers name
their role (nav, footer, article, class names); what it learns about link share, length,
punctuation and tags serves the others.  Defined results: null, empty and text-free pages have
an empty text; a page cut off in the middle of a tag is read up to there; repeated rows get
equal results.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellkin.llm import corpus

#: Pages to learn from, bytes of the longest of them, steps, step size, penalty.
SAMPLE, SAMPLE_BYTES, STEPS, RATE, PENALTY = 1_000, 1 << 16, 200, 0.2, 1e-3
#: Ties of neighbours on the page: in one container, in different ones; of container siblings.
TIE, LOOSE_TIE, SIBLING_TIE = 0.6, 0.05, 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?=[a-zA-Z])[^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Tags inside a block; all others end it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q"
    " s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
#: Tags that a block stands in for the rest of their extent.
CONTAINERS = frozenset(
    "html body div article section main nav header footer aside form ul ol dl table thead tbody tr td"
    " th figure fieldset details dialog menu blockquote button".split()
)
_BAD_TAGS = frozenset("nav footer aside form menu button dialog head".split())
_BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side"
    r"|footer|foot|header|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup"
    r"|login|share|social|related|recommend\w*|widget|toolbar|comments?|replies|reply|respond|disqus"
    r"|feedback|rating|search|pagination|pager|tags|meta|legal|copyright)(?:$|[\s_-])",
    re.I,
)
_GOOD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I
)
FEATURES = (
    "bad_tag", "bad_name", "header_outside", "in_article", "good_name", "links", "all_links", "item",
    "heading", "paragraph", "one_word", "few_words", "many_words", "sentence_end", "legal", "bias",
)
_ROLE_BITS = 0b11111
_LEGAL = re.compile(r"©|\(c\)|all rights reserved|copyright|privacy policy|terms of (?:use|service)|cookies?\b", re.I)

#: (text, feature bits, container number) of a block.
Block = tuple[str, int, int]


def _role(path: list[tuple[str, str, int]]) -> int:
    """Role bits of a container path; an inner role takes the place of an outer one."""
    bits = 0
    for tag, named, _ in path:
        bad = (tag in _BAD_TAGS) | (bool(named) and bool(_BAD_NAMES.search(named))) << 1
        good = (tag in ("article", "main")) << 3
        if named and not bad and _GOOD_NAMES.search(named):
            good |= 16
        if bad:
            bits = bits & ~24 | bad
        elif good:
            bits = bits & ~7 | good
        elif tag == "header" and not bits & 24:
            bits |= 4
    return bits


def blocks(page: str) -> list[Block]:
    """Blocks of a page in page order, white space and character references resolved."""
    out: list[Block] = []
    path: list[tuple[str, str, int]] = []
    parts: list[str] = []
    state = {"role": 0, "container": 0, "made": 0, "tag": ""}
    linked, in_link = 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        chars, linked = linked, 0
        if not text:
            return
        n, tag = text.count(" ") + 1, state["tag"]
        bits = (
            state["role"]
            | (chars * 3 > len(text)) << 5
            | (chars * 10 > len(text) * 9) << 6
            | (tag in ("li", "dt", "dd", "td", "th")) << 7
            | (tag in ("h1", "h2", "h3", "h4", "h5", "h6")) << 8
            | (tag == "p") << 9
            | (n == 1) << 10
            | (n < 6) << 11
            | (n > 20) << 12
            | (text[-1] in ".!?:;\"'»)") << 13
            | bool(_LEGAL.search(text)) << 14
            | 1 << 15
        )
        out.append((text, int(bits), state["container"]))

    for token in _TOKEN.finditer(page):
        name = token[3]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            elif token[1]:
                parts.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if token[2] else 1
            elif name in ("br", "img"):
                parts.append(" ")
            continue
        close()
        in_link = 0
        state["tag"] = "" if token[2] else name
        if name in CONTAINERS:
            if not token[2]:
                state["made"] += 1
                named = " ".join(filter(None, (x for m in _NAMED.findall(token[4]) for x in m)))
                path.append((name, "" if name in ("html", "body") else named, state["made"]))
            elif any(tag == name for tag, _, _ in path):
                while path.pop()[0] != name:
                    pass
            state["role"] = _role(path)
            state["container"] = path[-1][2] if path else 0
    close()
    return out


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side: score is the gain of being there, edges are ties."""
    n = len(score)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def tie(a: int, b: int, there: float, back: float) -> None:
        room[a][b] = room[a].get(b, 0.0) + there
        room[b][a] = room[b].get(a, 0.0) + back

    for i, s in enumerate(score):
        if s > 0:
            tie(source, i, s, 0.0)
        else:
            tie(i, sink, -s, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, free in room[a].items():
                if free > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [i in came for i in range(n)]
        flow, b = float("inf"), sink
        while b != source:
            flow = min(flow, room[came[b]][b])
            b = came[b]
        b = sink
        while b != source:
            a = came[b]
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow
            b = a


def label(found: list[Block], cost: dict[int, float] | np.ndarray) -> list[bool]:
    """Which blocks are content.

    Neighbours of one container whose costs lean the same way get one node: the ties inside
    such a run are at least as strong as those that leave it, so no minimum cut divides it.
    """
    score, where, node = [], [], []
    for _, bits, container in found:
        s = float(cost[bits])
        if where and where[-1] == container and (s > 0) == (score[-1] > 0):
            score[-1] += s
        else:
            score.append(s)
            where.append(container)
        node.append(len(score) - 1)
    if all(s > 0 for s in score) or not any(s > 0 for s in score):
        return [score[k] > 0 for k in node]
    edges, last = [], {}
    for k, container in enumerate(where):
        if k:
            edges.append((k - 1, k, TIE if where[k - 1] == container else LOOSE_TIE))
        if container in last and last[container] < k - 1:
            edges.append((last[container], k, SIBLING_TIE))
        last[container] = k
    side = min_cut(score, edges)
    return [side[k] for k in node]


def _bits(masks: np.ndarray) -> np.ndarray:
    return (np.asarray(masks)[..., None] >> np.arange(len(FEATURES)) & 1).astype(float)


def fit(pages: list[str]) -> np.ndarray:
    """Weights of the features, from the blocks whose containers name their role."""
    masks, labels = [], []
    for page in pages:
        for _, bits, _ in blocks(page):
            if bits & 0b111:
                masks.append(bits)
                labels.append(0.0)
            elif bits & 0b11000:
                masks.append(bits)
                labels.append(1.0)
    start = np.array([-2.0, -2.0, -1.5, 1.5, 1.0, -0.5, -1, -0.2, 0.2, 0.3, -0.2, -0.2, 0.5, 0.4, -1, 0])
    if len(set(labels)) < 2:
        return start
    kinds, index = np.unique(masks, return_inverse=True)
    seen = np.bincount(index).astype(float)
    good = np.bincount(index, labels)
    x, total = _bits(kinds), seen.sum()
    # The roles alone decide the labels; pulling towards `start` keeps every weight finite.
    w, first, second = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(x * w).sum(axis=1)))
        g = (x * (p * seen - good)[:, None]).sum(axis=0) / total + PENALTY * (w - start)
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


class Costs(dict):
    """Log odds of content by feature bits."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, bits: int) -> float:
        self[bits] = value = float((_bits(bits) * self.weights).sum())
        return value


def main_text(page: str | None, costs: Costs) -> str:
    found = blocks(page or "")
    keep = label(found, costs)
    return "\n\n".join(text for (text, _, _), good in zip(found, keep, strict=True) if good)


def learn(pages: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """Fit on at most `size` pages of moderate length, lowest hashes first."""
    sample = (
        corpus.low_hashes(pages.select("html"), F.xxhash64("html"), size)
        .filter(F.octet_length("html") <= SAMPLE_BYTES)
        .orderBy("k", "html")
        .limit(size)
    )
    return corpus.fit_in_task(sample, lambda rows: fit(list(rows["html"])))


def extract(pages: DataFrame) -> DataFrame:
    """All columns of `pages` but html, and text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages))

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        costs = Costs(shared.value)
        return page.map(lambda p: main_text(p, costs))

    found = pages.withColumn("_text", text("html")).drop("html", "text", "n_chars")
    n_chars = F.char_length("_text").cast("long").alias("n_chars")
    return found.select("*", F.col("_text").alias("text"), n_chars).drop("_text")


def op8_extract(spark, sf_dir: str) -> DataFrame:
    return extract(corpus.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
