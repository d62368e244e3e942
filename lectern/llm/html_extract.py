"""Main-text extraction from web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier over tags, names, link share and wording gives each block a cost for
either label; these costs, squeezed below what the ties around a block can add up to, are its capacities to the two terminals.
Neighbours in page order and in the same DOM container are tied by smoothness edges, weakly where a named part of the page
begins or ends. The minimum cut is the cheapest labelling; max-flow finds it.

The classifier is trained on pages that mark their main part by an article or main element: its blocks, without named
parts inside, against all others. For half of these pages the mark is hidden from it, so that it learns the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.texts import arrow, schema_of, steps

# HTML element kinds, and words in class, id and role that name a part's purpose.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template svg math iframe object select button canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
_ENDS_P = _BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_BAD_TAG = frozenset("nav footer aside form menu dialog fieldset".split())
_BAD_ROLE = re.compile(r"\b(navigation|banner|contentinfo|complementary|search|form|dialog|alertdialog|alert|menu|menubar|toolbar|tablist)\b")
_BAD_NAME = re.compile(
    r"(?<![a-z])(ads?|adv|advert\w*|adsense|adbox|adslot|ad[_-]\w+|banner|promo\w*|sponsor\w*|cookies?\w*|consent\w*|gdpr|notices?|notification\w*|alert\w*|popup\w*|modal\w*|overlay\w*"
    r"|side-?_?bar\w*|menu\w*|nav|navbar\w*|navigation|breadcrumb\w*|footer\w*|masthead\w*|topbar|comments?|commentlist|comment-\w+|repl(?:y|ies)|discuss\w*|disqus\w*|responses?"
    r"|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|sign-?up|log-?in|search\w*|widgets?|toolbar\w*|pagination|pager|copyright|legal|disclaimer|skip-?\w*|outbrain|taboola|rail|feedback)(?![a-z])"
)
_HEADER_NAME = re.compile(r"(?<![a-z])(header|site-?header|page-?header|head)(?![a-z])")
_GOOD_NAME = re.compile(r"(?<![a-z])(article\w*|content|main\w*|post|post-?(?:body|content|text)|entry\w*|story\w*|body-?text|article-?body|prose|text)(?![a-z])")
#: Of these names a page may mean its article: they count against a part only while other main text is left.
_DOUBTFUL = re.compile(r"(?<![a-z])(notices?|alert\w*|banner|promo\w*|sponsor\w*|overlay\w*|modal\w*|responses?|discuss\w*|related\w*|recommend\w*|search\w*|widgets?|copyright|legal|disclaimer|rail|feedback|header|head)(?![a-z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。:;][\"'”’)\]]*$")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|copyright", re.I)

#: Words of a name that tell a state of the page or the part, or what it holds, not what it is.
_STATE = re.compile(r"(?<![\w-])(?:has|with|no|without|is)-[\w-]+|(?<![\w-])[\w-]+-(?:open|closed|enabled|disabled)(?![\w-])")

#: What one unit of evidence weighs before training; positive speaks for main text.
WEIGHTS = {
    "any": 0.7, "inside": 2.5, "outside": -2.5, "good_name": 1.5, "bad_part": -8.0, "hidden": -10.0, "paragraph": 1.0, "heading": 0.5, "item": -0.2,
    "long": 1.5, "sentence": 0.5, "short": -0.6, "links": -4.0, "rights": -3.0,
}
PRIOR = np.array(list(WEIGHTS.values()))
#: Ties between a block and the next one in page order, and the next one of its container; their share across a named part's border.
NEXT, SIBLING, ACROSS = 0.4, 0.6, 0.2
#: The largest terminal capacity, below the ties of a block with two neighbours; and the score at which it is nearly reached.
CAPACITY, SCALE = 1.6, 4.0


class Part:
    """An open element: what it and those around it say about the text inside."""

    __slots__ = ("tag", "bad", "doubtful", "inside", "good", "hidden", "link", "number", "region", "block", "container")

    def __init__(self, tag: str, number: int, attrs: dict[str, str], above: Part | None):
        self.tag, self.number, self.region = tag, number, above.region if above else number
        self.inside = tag in ("article", "main") or "main" in attrs.get("role", "").split() or (above is not None and above.inside)
        self.hidden = above is not None and above.hidden
        self.bad = above is not None and above.bad
        self.doubtful = above is not None and above.doubtful
        self.good = above is not None and above.good
        self.link = tag == "a" or (above is not None and above.link)
        # The nearest element that makes blocks, and the number of the one around that
        self.block, self.container = (self, above.number if above else 0) if tag in _BLOCK or above is None else (above.block, above.container)
        named = doubted = False
        if tag in _BAD_TAG or (tag == "header" and not self.inside):
            named = True
        if attrs:
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
                self.hidden = True
            if tag not in ("html", "body", "main"):
                names = _STATE.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
                match = _BAD_NAME.search(names) or (not self.inside and _HEADER_NAME.search(names))
                subject = tag == "article" and not (above is not None and above.inside)  # an outer article's name tells what it is about
                if subject and not any(_BAD_NAME.fullmatch(x) for x in names.split()):
                    match = None
                if _BAD_ROLE.search(attrs.get("role", "").lower()):
                    named = True
                elif match:
                    doubted = not named and (subject or _BAD_NAME.search(_DOUBTFUL.sub(" ", names)) is None)
                    named = True
                elif _GOOD_NAME.search(names):
                    self.good = True
        if named:
            self.region = number
            self.doubtful = doubted and (self.doubtful or not self.bad)
            self.bad = True
        elif tag in ("article", "main"):
            self.region = number


class Block:
    """A run of text without a block boundary."""

    __slots__ = ("text", "tag", "part", "container", "linked")

    def __init__(self, text: str, tag: str, part: Part, container: int, linked: int):
        self.text, self.tag, self.part, self.container, self.linked = text, tag, part, container, linked


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip(" /") else {}


class _Tags:
    """Where tags end. Every search that fails is not tried again, so a page is passed over once or twice, whatever it holds."""

    def __init__(self, page: str):
        self.page, self.last, self.quoting = page, page.rfind(">"), True
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, -1 if there is none; one inside a quoted value does not end it."""
        if at > self.last:
            return -1
        here = at
        while self.quoting:
            stop = _STOP.search(self.page, here)
            if stop is None:
                self.quoting = False  # quotes are out of step from here on
                break
            if stop[1] is None:
                return stop.start()
            close = self.page.find(stop[1], stop.end())
            if close < 0:
                self.quoting = False
                break
            here = close + 1
        return self.page.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Where an element's text that is not read ends, -1 if its end tag is missing."""
        if tag in self.unclosed:
            return -1
        close = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(self.page, at)
        end = -1 if close is None else self.page.find(">", close.end())
        if end < 0:
            self.unclosed.add(tag)
        return end


class _Stack:
    """Open elements, with the places of each tag, so that the nearest of some tags is found without a walk."""

    def __init__(self) -> None:
        self.parts = [Part("#root", 0, {}, None)]
        self.places: dict[str, list[int]] = {}

    def push(self, part: Part) -> None:
        self.places.setdefault(part.tag, []).append(len(self.parts))
        self.parts.append(part)

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """Close the nearest element of these tags and what is open inside, unless one of until stands between."""
        at = self.nearest(tags)
        if at > self.nearest(until):
            while len(self.parts) > at:
                self.places[self.parts.pop().tag].pop()


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; comments, scripts, styles and controls are passed over. Time is linear in the page."""
    stack, tags = _Stack(), _Tags(page)
    out: list[Block] = []
    held: list[str] = []
    linked, number, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                top = stack.parts[-1]
                out.append(Block(text, top.block.tag, top.block, top.container, min(linked, len(text))))
            held.clear()
            linked = 0

    while at < size:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else size]
        if text:
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if stack.parts[-1].link:
                linked += len(text.strip())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(page, lt)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            held.append("<")
            at = lt + 1
            continue
        at, tag, inner = end + 1, m[2].lower(), page[m.end() : end]
        if tag in _BLOCK:
            flush()
        elif tag in ("br", "td", "th", "img"):
            held.append(" ")
        if m[1]:
            stack.close((tag,))
            continue
        if tag in _RAW:
            if not inner.endswith("/"):
                end = tags.raw_end(tag, at)
                at = end + 1 if end >= 0 else size if tag in ("script", "style") else at
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            stack.close(("p",), ("div", "section", "article", "td", "th", "li", "blockquote", "body", "main", "table"))
        if tag in _SAME:
            stack.close((tag,) if tag not in ("td", "th", "dt", "dd") else ("td", "th") if tag in ("td", "th") else ("dt", "dd"), _SAME[tag])
        number += 1
        stack.push(Part(tag, number, _attrs(inner), stack.parts[-1]))
    flush()
    return out


def features(block: Block, framed: bool) -> list[float]:
    """The evidence of a block, in the order of WEIGHTS; framed: the page marks its main part."""
    p, words = block.part, block.text.count(" ") + 1
    ends = _SENTENCE.search(block.text) is not None
    return [
        1.0, float(framed and p.inside), float(framed and not p.inside), float(p.good), float(p.bad), float(p.hidden), float(block.tag in ("p", "pre", "blockquote")),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(block.tag in ("li", "dd", "dt", "tr")), float(words >= 15), float(ends), float(words < 5 and not ends),
        block.linked / len(block.text), float(words < 40 and _RIGHTS.search(block.text) is not None),
    ]


def is_framed(blocks: list[Block]) -> bool:
    return any(b.part.inside and not b.part.bad for b in blocks)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source where positive scores are capacities from it and negative ones to the sink.

    A node whose terminal capacity is no less than all its edges together keeps its label in some minimum cut;
    such nodes are joined with their terminal before the flow runs over the rest.
    """
    n, around = len(scores), [0.0] * len(scores)
    for a, b, c in edges:
        around[a] += c
        around[b] += c
    settled = [s > 0 if abs(s) >= r else None for s, r in zip(scores, around)]
    free = [i for i in range(n) if settled[i] is None]
    if not free:
        return [bool(x) for x in settled]
    place = {v: k for k, v in enumerate(free)}
    source, sink = len(free), len(free) + 1
    graph: list[dict[int, float]] = [{} for _ in range(sink + 1)]

    def add(a: int, b: int, c: float, back: float) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + c
        graph[b][a] = graph[b].get(a, 0.0) + back

    for v, k in place.items():
        add(source, k, max(scores[v], 0.0), 0.0)
        add(k, sink, max(-scores[v], 0.0), 0.0)
    for a, b, c in edges:
        if a in place and b in place:
            add(place[a], place[b], c, c)
        elif a in place or b in place:
            k, other = (place[a], b) if a in place else (place[b], a)
            add(source, k, c, 0.0) if settled[other] else add(k, sink, c, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        todo = {u: list(graph[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                pushed = min(graph[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    graph[a][b] -= pushed
                    graph[b][a] += pushed
                path = [source]
                continue
            while todo[u] and not (graph[u][todo[u][-1]] > 1e-9 and level.get(todo[u][-1], -1) == level[u] + 1):
                todo[u].pop()
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()
    out = [bool(x) for x in settled]
    for v, k in place.items():
        out[v] = k in level
    return out


def capacities(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[float]:
    """What each block's label costs: positive from the source, for main text; negative to the sink."""
    if not blocks:
        return []
    framed = is_framed(blocks)
    table = np.array([features(b, framed) for b in blocks])
    scores = table @ weights
    doubtful = np.array([b.part.bad and b.part.doubtful and not b.part.hidden for b in blocks])
    length = np.array([len(b.text) - b.linked for b in blocks])
    if length[(scores > 0) & ~doubtful].sum() < 0.2 * length[doubtful].sum():  # the name would cost the page most of its text
        scores = scores - np.where(doubtful, weights[list(WEIGHTS).index("bad_part")], 0.0)
    return [CAPACITY * math.tanh(x / SCALE) for x in scores.tolist()]


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours in page order and in a container."""
    edges, last = [], {}
    share = lambda i, j: 1.0 if blocks[i].part.region == blocks[j].part.region else ACROSS
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT * share(i - 1, i)))
        if b.container in last:
            edges.append((last[b.container], i, SIBLING * share(last[b.container], i)))
        last[b.container] = i
    return edges


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    """The blocks labelled main text, in page order, joined by line ends."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, kept in zip(blocks, minimum_cut(capacities(blocks, weights), ties(blocks))) if kept)


def fit_weights(table: np.ndarray, labels: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights of rows of features for labels 0 and 1, drawn to the weights before training; both labels weigh the same."""
    w, weight = PRIOR.copy(), np.zeros(len(labels))
    for y in (0, 1):
        weight[labels == y] = 0.5 * len(labels) / max(1, (labels == y).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(table @ w, -30, 30)))
        gradient = table.T @ (weight * (p - labels)) + strength * (w - PRIOR)
        step = np.linalg.solve((table * (weight * p * (1 - p))[:, None]).T @ table + strength * np.eye(len(w)), gradient)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _examples(schema: pa.Schema):
    """Features and label of the blocks of pages that mark their main part; the mark is hidden where asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "html"):
                rows, labels = [], []
                for page, hide in zip(step.column("html").to_pylist(), step.column("hide").to_pylist()):
                    blocks = blocks_of(page or "")
                    if is_framed(blocks):
                        rows += [np.array(features(b, not hide)).tobytes() for b in blocks]
                        labels += [int(b.part.inside and not b.part.bad and not b.part.hidden) for b in blocks]
                yield arrow(schema, features=rows, label=labels)

    return run


def train_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 2000) -> np.ndarray:
    """Weights fitted on about sample pages, those whose id hashes lowest; the weights before training where no page marks its main part.

    Only the blocks' features reach the driver. Null ids and pages teach nothing; repeated rows teach as often as they occur.
    """
    spark = pages.sparkSession
    known = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    share = sample / max(1, known.select("id").count())
    hashed = F.xxhash64("id")
    drawn = known.where(F.pmod(hashed, F.lit(1 << 20)) < share * (1 << 20)).select("html", (F.shiftright(hashed, 30) % 2 == 0).alias("hide"))
    ddl = "features binary, label int"
    rows = sorted(drawn.mapInArrow(_examples(schema_of(spark, ddl)), ddl).collect(), key=tuple)
    if not rows:
        return PRIOR
    return fit_weights(np.array([np.frombuffer(r["features"]) for r in rows]), np.array([r["label"] for r in rows]))


def _extract(weights: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "html"):
                found = [main_text(x, weights.value) if x else "" for x in step.column("html").to_pylist()]
                yield arrow(schema, page_id=step.column("page_id"), url=step.column("url"), text=found, n_chars=list(map(len, found)))

    return run


def extract_pages(pages: DataFrame, weights: np.ndarray = PRIOR, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (empty if there is none), n_chars (its code points).

    Null and empty pages give empty texts; very long ones are read whole, in time in proportion to their length before the cut; where both labels
    cost the same a block is left out; repeated rows are extracted each; an empty table gives no rows; other columns
    of pages, whatever their names, are not read.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = own.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return own.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(weights), to_arrow_schema(out)), out)
