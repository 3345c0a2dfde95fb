"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks in page order. A classifier gives each block the log-odds of being content, which become
its capacity from the source or to the sink. Blocks that follow one another, and blocks with the same parent, are joined by
edges whose capacity rises with their closeness in the document tree, which is the price of labelling them differently.
The minimum cut is the cheapest labelling; blocks on the source's side are the text. So a block that says little of itself,
such as a short line, a heading or a list item, goes with those around it.

The classifier is logistic. What the markup says outright (an article or main element, a menu, class names) has fixed
weights; those of the text itself (length, links, sentence ends, kind of element) and the scale of the edges are fitted on
pages that have both an article or main element and others such as nav, aside or footer, whose blocks label each other's
kind; these elements are hidden from the fit. It starts from fixed weights as its prior and stays near them where pages are few.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing as T
from ._workers import map_batches

# Element names of the HTML standard by their part in a page, and common words in class and id names.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "select", "object", "canvas", "audio", "video")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
AWAY = ("nav", "footer", "aside", "menu", "dialog", "button", "fieldset", "label", "search")
MAIN = ("article", "main")
AWAY_WORDS = ("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "skip")
TALK_WORDS = ("comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion")
TEXT_WORDS = ("article", "content", "main", "post", "entry", "story", "body", "text", "prose")

_TAG = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_RAW, _VOID, _INLINE, _AWAY, _MAIN = map(frozenset, (RAW, VOID, INLINE, AWAY, MAIN))
_AWAY_WORDS, _TALK_WORDS, _TEXT_WORDS = map(frozenset, (AWAY_WORDS, TALK_WORDS, TEXT_WORDS))
_AWAY_IN_MAIN = _AWAY_WORDS - {"header", "masthead"}
#: Elements that an opening block ends, and those that end their own kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
_SCOPES = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "body", "nav"))


GENERIC_WORDS = ("area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "component", "container", "desktop", "fixed", "form", "frame", "global", "group", "heading", "holder", "icon", "icons", "inner", "item", "items", "label", "layer", "left", "link", "links", "list", "message", "mobile", "module", "outer", "page", "panel", "placeholder", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "space", "sticky", "title", "tools", "top", "unit", "widget", "wrap", "wrapper", "zone")
DENIALS = ("free", "has", "is", "less", "no", "non", "not", "with", "without")
_GENERIC, _DENIALS = frozenset(GENERIC_WORDS), frozenset(DENIALS)


#: The strength of a name that only begins with one of the words; it counts for nothing on what holds half of a page's text.
HINT = 0.8


def strength(token: str, words: frozenset[str]) -> float:
    """How surely a class or id name says one of the words: 1 if it says nothing else, less as a part of a longer name."""
    parts = [w.lower() for w in _WORD.findall(token)]
    hits = [w in words for w in parts]
    if not any(hits) or parts[0] in _DENIALS or parts[-1] in _DENIALS:
        return 0.0
    if all(h or w in _GENERIC or w in _AWAY_WORDS for h, w in zip(hits, parts, strict=True)):
        return 1.0
    return 0.85 if hits[-1] else HINT


class Node:
    """An open block element, and what its ancestors and itself say."""

    __slots__ = ("above", "away", "depth", "form", "frame", "hint", "hint_above", "in_main", "off", "parent", "tag", "talk", "textual")

    def __init__(self, tag: str, parent: Node | None, names: list[str], role: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        #: Open elements since the nearest scope that an opening block may end, by tag.
        self.frame: dict[str, int] = parent.frame if parent and tag not in _SCOPES else {}
        was_main = bool(parent and parent.in_main)
        main = tag in _MAIN or role == "main"
        self.in_main = was_main or main
        names = [] if tag in ("html", "body") else names
        told = max((strength(x, _AWAY_IN_MAIN if self.in_main or strength(x, _TEXT_WORDS) else _AWAY_WORDS) for x in names), default=0.0) if tag not in _MAIN and tag != "header" else 0.0
        self.hint_above = parent.hint if parent and not (main and not was_main) else None
        self.hint = self if told == HINT else self.hint_above
        off = max(parent.off if parent else 0.0, told if told > HINT else 0.0)
        # What is said above the outermost article or main counts less than what is said inside it.
        self.above, self.off = (off, 0.0) if main and not was_main else (parent.above if parent else 0.0, off)
        self.talk = max(parent.talk if parent else 0.0, max((strength(x, _TALK_WORDS) for x in names), default=0.0))
        self.textual = max(parent.textual if parent else 0.0, max((strength(x, _TEXT_WORDS) for x in names), default=0.0))
        own = tag in _AWAY or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") or (tag == "header" and not self.in_main)
        self.away = bool(parent and parent.away) or own
        # A form around the whole page is no form in it.
        self.form = self if tag == "form" or role == "form" else None if main and not was_main else parent.form if parent else None


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; tolerant of unclosed, misnested and cut-off markup."""
    top = Node("", None, [], "")
    node, hidden = top, 0
    out: list[Block] = []
    pieces: list[str] = []
    opened: Counter[str] = Counter()
    linked = links = 0
    last = page.rfind(">") + 1
    # What follows the last ">" can only be text and a tag that was cut off.
    tail = re.search(r"<[a-zA-Z/!?]", page[last:])
    end = last + tail.start() if tail else len(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text and not hidden:
            out.append(Block(text, min(linked, len(text)), node))
        pieces.clear()
        linked = 0

    def close(n: Node):
        nonlocal node, hidden
        flush()
        while True:
            gone = node
            node = node.parent
            opened[gone.tag] -= 1
            if gone.tag in _ENDED and gone.frame is node.frame:
                node.frame[gone.tag] -= 1
            if hidden and node.depth < hidden:
                hidden = 0
            if gone is n:
                return

    def add(raw: str):
        nonlocal linked
        text = _html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links > 0:
            linked += len(text.strip())

    at = 0
    while at < end:
        m = _TAG.search(page, at, end)
        if m is None:
            add(page[at:end])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at - 2)
            at = end if stop < 0 else stop + 3
            continue
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                pieces.append(" ")
            elif tag not in _INLINE:
                if opened[tag]:
                    n = node
                    while n.tag != tag:
                        n = n.parent
                    close(n)
                else:
                    flush()
                links = 0
            continue
        if tag in _RAW:
            if not rest.endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                if stop is None:
                    at = end
                else:
                    close_at = page.find(">", stop.end())
                    at = end if close_at < 0 else close_at + 1
            pieces.append(" " if tag in ("textarea", "select", "title") else "")
            continue
        if tag == "a":
            links += 1
            continue
        if tag in _INLINE:
            if tag in ("br", "img"):
                pieces.append(" ")
            continue
        if tag in _VOID:
            flush()
            continue
        ends = ("p", *_CLOSES.get(tag, ()))
        while any(node.frame.get(x) for x in ends):
            n = node
            while n.tag not in ends:
                n = n.parent
            close(n)
        flush()
        links = 0
        names, role, unseen = [], "", False
        if rest and not rest.isspace():
            for a in _ATTRIBUTE.finditer(rest):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names += _html.unescape(value).split()
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    unseen = True
        node = Node(tag, node, names, role)
        opened[tag] += 1
        if tag in _ENDED and tag not in _SCOPES:
            node.frame[tag] = node.frame.get(tag, 0) + 1
        if unseen and not hidden:
            hidden = node.depth
    flush()
    return out


#: What a block's text says; the order of the weights.
FEATURES = ("always", "length", "sentence", "paragraph", "heading", "item", "linked", "mostly linked")
# The prior of the fitted weights and of the edges' scale, and the weights of what the markup says.
PRIOR = (-0.5, 2.0, 0.5, 0.5, 0.3, -0.3, -1.0, -3.0)
SMOOTH = 1.5
IN_MAIN, ELSEWHERE, AWAY_ELEMENT, OFF, ABOVE, TALK, TEXTUAL, BESIDE = 5.0, -6.0, -14.0, -14.0, -4.0, -14.0, 1.5, -2.0
#: The text's evidence stays within this, so that it can't outweigh the markup.
MOST = 4.0


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] = PRIOR
    smooth: float = SMOOTH


def text_features(b: Block) -> tuple[float, ...]:
    size, tag = len(b.text), b.node.tag
    share = b.linked / size
    return (1.0, min(1.0, size / 160), float(b.text[-1] in ".!?:;…。！？\"'”»"), float(tag in ("p", "blockquote", "pre")), float(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"), float(tag in ("li", "td", "th", "dt", "dd")), share, float(share > 0.5))


def _clipped(e: float) -> float:
    return max(-MOST, min(MOST, float(e)))


def text_evidence(b: Block, model: Model) -> float:
    return _clipped(sum(w * x for w, x in zip(model.weights, text_features(b), strict=True)))


def _bare(found: list[Block]) -> np.ndarray:
    """Features of blocks whose element says nothing."""
    out = np.array([text_features(b) for b in found])
    out[:, [FEATURES.index(k) for k in ("paragraph", "heading", "item")]] = 0
    return out


def _forms(found: list[Block]) -> set[int]:
    """Forms that hold most of a page's text: a page in a form, not a form in a page."""
    held: Counter[int] = Counter()
    for b in found:
        if b.node.form is not None:
            held[id(b.node.form)] += len(b.text)
    most = 0.7 * sum(len(b.text) for b in found)
    return {f for f, n in held.items() if n >= most}


def _hinted(found: list[Block]) -> set[int]:
    """Elements with a hint on themselves or above, that hold less than half of the page's text."""
    held: Counter[int] = Counter()
    seen: dict[int, Node] = {}
    for b in found:
        n = b.node.hint
        if n is not None:
            held[id(n)] += len(b.text)
        while n is not None and id(n) not in seen:
            seen[id(n)] = n
            n = n.hint_above
    half = 0.5 * sum(len(b.text) for b in found)
    deep = sorted(seen.values(), key=lambda n: -n.depth)
    for n in deep:
        if n.hint_above is not None:
            held[id(n.hint_above)] += held[id(n)]
    out: set[int] = set()
    for n in reversed(deep):
        if held[id(n)] < half or n.hint_above is not None and id(n.hint_above) in out:
            out.add(id(n))
    return out


def costs(found: list[Block], model: Model) -> list[float]:
    """Each block's log-odds of being content; they are the units of the cut's capacities."""
    whole, hinted = _forms(found), _hinted(found)
    away = [n.away or n.form is not None and id(n.form) not in whole for n in (b.node for b in found)]
    clean = [b.node.in_main and not a and b.node.above < 1 and b.node.talk < 1 and b.node.off < 1 for b, a in zip(found, away, strict=True)]
    any_main, any_textual = any(clean), any(b.node.textual >= 1 and not a for b, a in zip(found, away, strict=True))
    out = []
    for b, a in zip(found, away, strict=True):
        n = b.node
        off = max(n.off, HINT if id(n.hint) in hinted else 0.0)
        e = text_evidence(b, model) + OFF * off + ABOVE * n.above + TALK * n.talk + AWAY_ELEMENT * a
        if n.in_main:
            e += IN_MAIN + (ELSEWHERE if any_main and n.above >= 1 else 0.0)
        elif any_main:
            e += ELSEWHERE
        elif n.textual:
            e += TEXTUAL * n.textual
        elif any_textual:
            e += BESIDE
        out.append(e)
    return out


def closeness(a: Block, b: Block) -> float:
    """The smoothness edge between two blocks: 1 for one parent, less for each step between them."""
    x, y, steps = a.node, b.node, 0
    x, y = (x.parent or x), (y.parent or y)
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 1.0 / (1 + steps)


def minimum_cut(evidence: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: sum of |evidence| against the label, and of edges between different labels. Dinic's algorithm.

    A block on neither side of the cut's residual graph (a tie) is boilerplate.
    """
    n = len(evidence)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, forth: int, back: int) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(forth)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    unit = 1000
    for i, e in enumerate(evidence):
        if e > 0:
            edge(source, i, round(e * unit), 0)
        elif e < 0:
            edge(i, sink, round(-e * unit), 0)
    for a, b, w in edges:
        edge(a, b, round(w * unit), round(w * unit))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for k in graph[u]:
                if room[k] > 0 and level[to[k]] < 0:
                    level[to[k]] = level[u] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[k] for k in path)
                first = None
                for i, k in enumerate(path):
                    room[k] -= flow
                    room[k ^ 1] += flow
                    if first is None and room[k] == 0:
                        first = i
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while place[u] < len(graph[u]):
                k = graph[u][place[u]]
                if room[k] > 0 and level[to[k]] == level[u] + 1:
                    break
                place[u] += 1
            if place[u] < len(graph[u]):
                path.append(graph[u][place[u]])
                u = to[path[-1]]
            elif path:
                k = path.pop()
                u = to[k ^ 1]
                place[u] += 1
            else:
                break


def edges(found: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Adjacency by closeness, and half as much between blocks of one parent with others in between."""
    out = [(i, i + 1, smooth * closeness(found[i], found[i + 1])) for i in range(len(found) - 1)]
    before: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = id(b.node.parent or b.node)
        if parent in before and before[parent] < i - 1:
            out.append((before[parent], i, smooth / 2))
        before[parent] = i
    return out


def labels(found: list[Block], model: Model) -> list[bool]:
    return minimum_cut(costs(found, model), edges(found, model.smooth)) if found else []


def main_text(page: str | None, model: Model | None = None) -> str:
    """The article's blocks in page order, one a line; empty if there are none."""
    found = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, labels(found, model or Model()), strict=True) if content)


def _known(b: Block) -> bool | None:
    """Whether a block is content, where elements say so beyond doubt."""
    n = b.node
    if n.away or n.form is not None:
        return None if n.in_main else False
    return True if n.in_main and not (n.off or n.above or n.talk) else None


def fit_pages(pages: list[str | None]) -> Model:
    """Weights of the text's features (logistic, by Newton's method, with PRIOR as the prior) and the edges' scale, from pages whose elements tell the blocks apart."""
    told = []
    for page in pages:
        found = blocks(page or "")
        known = [_known(b) for b in found]
        if True in known and False in known:
            told.append((found, known))
    if not told:
        return Model()
    x = np.array([text_features(b) for found, known in told for b, k in zip(found, known, strict=True) if k is not None])
    y = np.array([k for _, known in told for k in known if k is not None], float)
    # Each block again without its element's kind, so that text counts on pages that are made of nameless elements.
    bare = np.concatenate([_bare([b for b, k in zip(found, known, strict=True) if k is not None]) for found, known in told])
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    # Both kinds weigh the same, however much menu a page has.
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    prior, ridge = np.array(PRIOR), 5.0
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * (w - prior))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model = Model(tuple(round(float(v), 6) for v in w))
    # The scale that labels most of these blocks right by their bare text and the tree; of equal ones the nearest to SMOOTH.
    best = []
    for smooth in sorted((0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda v: abs(v - SMOOTH)):
        right = 0
        for found, known in told:
            cut = minimum_cut([_clipped(w @ r) for r in _bare(found)], edges(found, smooth))
            right += sum(k == c for k, c in zip(known, cut, strict=True) if k is not None)
        best.append((right, smooth))
    return Model(model.weights, max(best, key=lambda r: r[0])[1])


def fit(pages: DataFrame, *, html_col: str = "html", fit_rows: int = 400, fit_bytes: int = 200_000) -> Model:
    """A model from at most fit_rows whole pages of at most fit_bytes each, those of the smallest hash; the bound of the fit alone."""
    html = F.col(html_col).cast("string")
    rows = pages.select(html.alias("html")).where(F.octet_length("html") <= fit_bytes).select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(fit_rows)
    return fit_pages([r.html for r in rows.toLocalIterator()])


def extract(pages: DataFrame, model: Model | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text; null ids and urls stay null; repeated rows
    give repeated rows; an empty table gives no rows; other columns are not read. No shuffle. model: that of fit(); by
    default the prior.
    """
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    model = model or Model()

    def extracted(batches):
        for batch in batches:
            for at, part in T.in_parts(batch.column(2).to_pylist()):
                texts = [main_text(x, model) for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(narrow, extracted, "page_id long, url string, text string, n_chars long")
