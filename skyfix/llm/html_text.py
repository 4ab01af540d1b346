"""Main-text extraction by minimum cut.

A page becomes text blocks. A classifier gives each block a cost of being content and of being boilerplate, the capacities to
the two terminals: a discriminant over signs of its text (words, link share, marks, place in the page, element), fitted to blocks
whose own page marks them by article, main, nav, footer and the like, and fixed weights for the containers around it. Where
the names of containers would take most of what the classifier finds to be text, it overrules them; see believed.
Neighbouring blocks and blocks of one container are tied by smoothness edges. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import Discriminant, class_sums
from .shared import text_function, tidy

#: HTML's fixed names: text inside these never shows, and these start and end blocks.
HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe", "select", "textarea", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag of the first kind closes an open element of the second, up to the nearest of the third.
CLOSES = {
    "p": ({"p"}, None), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Containers that say what a block is, by element and by the words of the names in class, id and role; a word weighs WORD_COST.
AWAY_TAGS = {"nav": 6.0, "header": 3.5, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0}
WORD_COST = 6.0
AWAY_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice",
    "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "side", "widget", "related", "share", "social", "comment", "comments", "reply", "respond", "disqus",
    "footer", "header", "masthead", "copyright", "legal", "pagination", "pager", "toolbar", "skip", "toc", "rail", "gdpr", "disclaimer",
}
HOME_TAGS = {"article": 1.5, "main": 1.2}
HOME_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
#: A name that begins with one of these tells of a state or of other parts of the page, not of what is inside.
#: Elements that hold text rather than parts of a page: only a name of nothing but listed words tells of them.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
STATES = {"has", "no", "not", "with", "without", "is", "are", "hide", "show", "hides", "shows", "non", "js", "supports", "wp"}
#: Containers' words are believed where they take at most so much of a page's text, or leave so much of it in a container of content.
MOST_TAKEN, LEAST_LEFT = 0.5, 0.05
#: Strength of the ties between neighbours, in one container and across; the text's say at most, and its scale.
NEAR, ACROSS, TEXT_LIMIT, TEXT_SCALE = 1.5, 0.15, 2.0, 0.4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


class _Element:
    """An open element: what is said of it and of those around it. `away` has elements as <name> and words."""

    __slots__ = ("name", "parent", "away", "home", "hidden", "block", "label")

    def __init__(self, name: str, parent, attributes: str):
        self.name, self.parent = name, parent
        self.home = HOME_TAGS.get(name, 0.0)
        self.hidden = name in HIDDEN
        inside = parent is not None and parent.home >= HOME_TAGS["main"]
        away: set[str] = set()
        if name in AWAY_TAGS and not (name == "header" and inside):  # not the article's own header
            away.add(f"<{name}>")
        if attributes and not attributes.isspace():
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id", "role"):
                    self._named(name, value.split(), inside, away)
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    self.hidden = True
        around = frozenset() if parent is None else parent.away
        if name in HOME_TAGS:  # a form around it is the page's
            around -= {"<form>"}
            around = frozenset() if around == {"<header>"} else around
        self.away = around | away if away else around
        self.block = self if parent is None or name in BLOCK else parent.block
        #: Whether an element for boilerplate, and one for content, is around it.
        self.label = (name in AWAY_TAGS, name in HOME_TAGS)
        if parent is not None:
            self.home = max(self.home, parent.home)
            self.hidden = self.hidden or parent.hidden
            self.label = (self.label[0] or parent.label[0], self.label[1] or parent.label[1])

    def _named(self, tag: str, names: list[str], inside: bool, away: set[str]) -> None:
        for words in map(_PARTS.findall, names):
            if not words or words[0] in STATES:
                continue
            home = not HOME_WORDS.isdisjoint(words)
            told = AWAY_WORDS.intersection(words)
            if (home or inside) and told == {"header"}:
                told = set()
            if tag in TEXTS and not AWAY_WORDS.union(HOME_WORDS).issuperset(words):
                told = set()
            if told and tag not in ("body", "html", "article", "main"):
                away |= told
            elif home:
                self.home = max(self.home, 1.0)


def blocks(page: str) -> list[tuple[str, float, _Element]]:
    """(text, share of its characters in links, container) of each block with text, in page order."""
    top = here = _Element("html", None, "")
    out: list = []
    parts: list[str] = []
    linked = links = 0
    opened: Counter = Counter()  # elements from here up, by name: what is not open is not looked for

    def leave(box):
        nonlocal here
        while here is not box:
            opened[here.name] -= 1
            here = here.parent

    def close():
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip(" ")
        if text:
            out.append((text, min(1.0, linked / len(text)), here.block))
        parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            token = m[0]
            if (token[0] != "<" or token == "<") and not here.hidden:
                text = entities.unescape(token) if "&" in token else token
                parts.append(text)
                linked += len(text) if links else 0
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name in BLOCK:
                close()
            if opened[name]:
                box = here
                while box.name != name:
                    box = box.parent
                if name == "a":
                    links = max(0, links - 1)
                leave(box.parent)
            continue
        if name in BLOCK:
            close()
            inside, stop = CLOSES.get(name, (None, None))
            if inside is None and here.name == "p":
                inside, stop = {"p"}, None
            kinds = inside or {"p"}
            if any(opened[k] for k in kinds) and (inside is not None or here.block.name == "p"):
                box = here
                while box is not top and box.name not in kinds and not (stop and box.name in stop) and (stop or box.name not in BLOCK):
                    box = box.parent
                if box is not top and box.name in kinds:
                    leave(box.parent)
        if name in VOID or (m[0].endswith("/>") and name not in RAW):
            continue
        if name == "html":
            continue
        here = _Element(name, here, m[3] or m[6] or "")
        opened[name] += 1
        links += name == "a"
        if name in RAW:
            stop_at = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inner = page[at : stop_at.start() if stop_at else end]
            if not here.hidden:
                parts.append(entities.unescape(inner))
            at = stop_at.end() if stop_at else end
            if name in BLOCK:
                close()
            leave(here.parent)
    close()
    return out


_KINDS = [{"p", "blockquote", "pre", "figcaption"}, {"li", "dd", "dt", "td", "th"}, {"h1", "h2", "h3", "h4", "h5", "h6"}]


def signs(found: list[tuple[str, float, _Element]]) -> np.ndarray:
    """(blocks, d): signs of the blocks of a page that need no name of a container."""
    out = np.empty((len(found), 9))
    for i, (text, linked, box) in enumerate(found):
        words = text.count(" ") + 1
        marks = sum(map(text.count, ",.;"))
        out[i] = (
            np.log1p(words), linked, text[-1] in ".!?\"'", marks / words, len(text) / words < 3, i / len(found),
            *(box.name in kind for kind in _KINDS),
        )
    return out


def label_of(box: _Element) -> int | None:
    """What a page itself says of a block: 1 inside article or main, 0 inside nav, footer and the like, else nothing."""
    away, home = box.label
    return int(home) if away != home else None


def text_scores(found: list[tuple[str, float, _Element]], model: Discriminant | None) -> np.ndarray:
    """What its text says for each block being content, below 0 if against it."""
    if model is not None and {0, 1} <= set(model.classes):
        x = signs(found)
        return np.clip(TEXT_SCALE * (model.log_joint(x, 1) - model.log_joint(x, 0)), -TEXT_LIMIT, TEXT_LIMIT)
    # nothing was learnt: long blocks without links are content
    return np.array([min(min(t.count(" ") + 1, 30) * 0.07 - 0.4 - 2.5 * linked, TEXT_LIMIT) for t, linked, _ in found])


def believed(found: list[tuple[str, float, _Element]], told: np.ndarray) -> list[float]:
    """What the containers say against each block.

    A name may tell of the whole page rather than of a part (`post comments-open`, `layout-rail`, a form around everything). So
    words lose their say one by one, the one on most text first, while those left take more than MOST_TAKEN of what the
    classifier finds to be text, two blocks or more, and less than LEAST_LEFT of it stays in a container of content. Elements
    made for boilerplate keep theirs, but for forms, which some sites put around the page. A block counts by the logarithm of
    its words.
    """
    own = [set(box.away) for _, _, box in found]
    weight = [np.log1p(t.count(" ") + 1) if s > 0 else 0.0 for (t, _, _), s in zip(found, told.tolist(), strict=True)]
    total = sum(weight)
    texts = [i for i, w in enumerate(weight) if w]
    while True:
        taken = [i for i in texts if own[i]]
        left = sum(weight[i] for i in texts if not own[i] and found[i][2].home)
        if len(taken) < 2 or sum(weight[i] for i in taken) <= MOST_TAKEN * total or left >= LEAST_LEFT * total:
            break
        on: Counter = Counter()
        for i in taken:
            for word in own[i]:
                if word[0] != "<" or word == "<form>":
                    on[word] += weight[i]
        if not on:
            break
        word = min(on, key=lambda w: (-on[w], w))
        for away in own:
            away.discard(word)
    return [max((AWAY_TAGS[w[1:-1]] if w[0] == "<" else WORD_COST for w in away), default=0.0) for away in own]


def costs(found: list[tuple[str, float, _Element]], model: Discriminant | None) -> tuple[list[tuple[float, float]], list[float]]:
    """(capacity of being content, of being boilerplate) of each block, and what its containers say against it."""
    told = text_scores(found, model)
    away = believed(found, told)
    out = []
    for (text, _, box), t, against in zip(found, told.tolist(), away, strict=True):
        score = t + box.home - against
        if text.startswith("©") or "all rights reserved" in text.lower():
            score -= 2.0
        out.append((max(score, 0.0) + 0.01, max(-score, 0.0)))
    return out, away


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether the minimum cut leaves it with the source. Blocking flows over levels: each round fills all
    shortest paths at once, so rounds are as few as path lengths differ."""
    n = len(source)
    excess = [s - min(s, t) for s, t in zip(source, sink, strict=True)]
    room = [t - min(s, t) for s, t in zip(source, sink, strict=True)]
    ends: list[int] = []
    free: list[float] = []
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append(len(ends))
        near[b].append(len(ends) + 1)
        ends += [b, a]
        free += [c, c]
    while True:
        level = [-1] * n
        layer = [i for i in range(n) if excess[i] > 1e-9]
        starts = layer
        for i in layer:
            level[i] = 0
        depth, met = 0, False
        while layer and not met:
            depth += 1
            after = []
            for x in layer:
                for e in near[x]:
                    y = ends[e]
                    if level[y] < 0 and free[e] > 1e-9:
                        level[y] = depth
                        after.append(y)
                        met = met or room[y] > 1e-9
            layer = after
        if not met:
            return [x >= 0 for x in level]
        _fill(starts, level, near, ends, free, excess, room)


def _fill(starts, level, near, ends, free, excess, room) -> None:
    """Push flow along all paths that go down one level each step, until none is left."""
    at = [0] * len(near)
    for start in starts:
        path: list[int] = []
        x = start
        while excess[start] > 1e-9:
            if room[x] > 1e-9:
                flow = min([excess[start], room[x], *(free[e] for e in path)])
                excess[start] -= flow
                room[x] -= flow
                for e in path:
                    free[e] -= flow
                    free[e ^ 1] += flow
                keep = next((k for k, e in enumerate(path) if free[e] <= 1e-9), len(path))
                path = path[:keep]
                x = ends[path[-1]] if path else start
                continue
            while at[x] < len(near[x]):
                e = near[x][at[x]]
                if free[e] > 1e-9 and level[ends[e]] == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(near[x]):
                path.append(near[x][at[x]])
                x = ends[path[-1]]
            elif path:
                x = ends[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def ties(found: list[tuple[str, float, _Element]], away: list[float]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between each block and the one before it in its container; weak ones where the containers
    say different things of the two."""
    edges = []
    last: dict[int, int] = {}
    for i, (_, _, box) in enumerate(found):
        before = last.get(id(box.parent))
        for other in {i - 1, before} - {-1, None}:
            there = found[other][2]
            edges.append((other, i, NEAR if there.parent is box.parent and away[other] == away[i] else ACROSS))
        last[id(box.parent)] = i
    return edges


def main_text(page: str | None, model: Discriminant | None = None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    pairs, away = costs(found, model)
    keep = minimum_cut([p[0] for p in pairs], [p[1] for p in pairs], ties(found, away))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


#: Pages that the classifier of blocks is fitted on at most, about: beyond it a sample by the hash of the html.
SAMPLE = 10_000


def fit_blocks(pages: DataFrame, html_col: str = "html", most: int = SAMPLE) -> Discriminant:
    """The classifier of blocks, from the blocks of pages that say themselves what they are; see label_of."""
    rows = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * most / n))

    def measure(batch: pa.RecordBatch):
        for page in batch.column("html").to_pylist():
            found = blocks(page)
            own = [label_of(box) for _, _, box in found]
            some = [i for i, k in enumerate(own) if k is not None]
            if some:
                yield np.array([own[i] for i in some]), signs(found)[some]

    with tidy(pages.sparkSession):
        return Discriminant(class_sums(rows, measure), shrink=0.9, ridge=1e-2)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = SAMPLE) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages.

    Blocks are in page order, white space in a block is one space, character references are decoded, blocks are joined by
    one newline. Null, empty and markup-only pages give an empty text. Tables, lists and long pages are read whole. The
    classifier of blocks is fitted on about `most` pages at most (a sample by the hash of the html); where no page marks its
    parts, long blocks without links are content. Repeated rows are extracted each; null ids and urls are returned as they
    are, of any type; other columns are ignored, whatever their names; an empty table gives none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit_blocks(pages, html_col, most))

    def run(pages: pa.Array) -> list:
        text = [main_text(page, shared.value) for page in pages.to_pylist()]
        return [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]

    found = text_function(run, "text string, n_chars bigint")(F.col(html_col).cast("string"))
    return pages.select(F.col(id_col), F.col(url_col), found.alias("found")).select(id_col, url_col, "found.*")
