"""Main text of web pages by minimum-cut labelling.

A page's text is split into blocks at block-level tags.  A classifier gives each block the
cost of calling it content and of calling it boilerplate; these are the capacities of its
edges to the two terminals.  Blocks that follow each other and blocks with the same parent
are joined by smoothness edges, stronger the closer they are in the DOM.  The minimum cut of
that graph is the labelling with the least total cost.

The classifier adds two parts: a logistic model of the block's shape (length, links,
punctuation, ...), trained here on a bounded sample of blocks whose element names tell what
they are, and what the nearest telling element or class name around the block says.  What a
name is worth is learned too: the log odds that it agrees with shape on the sample, bounded
so that shape and neighbours together can outweigh it.  So is smoothness: the log odds that
blocks so far apart, or of one parent, are named alike.  Only hidden elements are beyond doubt.
"""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.words import slices

#: Pages the classifier is trained on, those with the least hashes of their id.
SAMPLE_PAGES = 400

# Element names and class words.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = set("script style textarea iframe noframes noembed xmp".split())
#: Elements whose text isn't shown; their tags are read, so that one without an end tag ends with its parent.
UNSEEN_TAGS = set("noscript template svg canvas audio video".split())
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = set("nav header footer aside form menu dialog button select fieldset head".split())
CONTENT_WORDS = set("article articlebody content entry main maincontent post story text body".split())
BOILER_WORDS = set(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus dialog feedback footer form gdpr"
    " header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion reader reply"
    " respond related search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_OPENS = re.compile(r"<[!?]")
_NAMES = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: How strong the evidence of an element's name, of a class name, and of a hidden element is.
TELLING_TAG, TELLING_WORD, HIDDEN = 6.0, 3.0, 12.0
#: The most that a telling element, a class name and, where a name speaks, shape may weigh, in log odds.
MOST_TAG, MOST_WORD, MOST_SHAPE = 2.5, 2.0, 1.0
#: The most smoothness between blocks that follow each other, and between blocks with one parent.
ADJACENT, SIBLING = 0.6, 0.5
#: Names are held to agree so often before the sample is looked at.
PRIOR = 20
#: Blocks this far apart, or further, are one kind of neighbours.
FAR = 8


def _evidence(tag: str, attributes: str, inside_content: bool) -> float:
    """What an element says of the text in it: above 0 content, below 0 boilerplate, 0 nothing."""
    if tag in UNSEEN_TAGS or tag in BOILER_TAGS and not (tag == "header" and inside_content):
        return -TELLING_TAG
    words: set[str] = set()
    if attributes:
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return -HIDDEN
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in _WORDS.findall(value))
    words.discard(tag)
    content, boiler = bool(words & CONTENT_WORDS), bool(words & BOILER_WORDS or words & {"complementary", "contentinfo"})
    named = TELLING_WORD * (content - boiler)  # words that disagree cancel
    return TELLING_TAG + min(named, 0.0) if tag in CONTENT_TAGS else named


def _inherited(tag: str, own: float, above: float) -> float:
    """The evidence of an element in one with evidence ``above``: what is nearest counts.

    Nothing in a boilerplate element turns into content again; where only a class name says
    boilerplate, an article or main without such a name does, and other content names take off half.
    """
    if own == 0 or above <= -TELLING_TAG:
        return above
    if own < 0:
        return min(own, above) if above < 0 else own
    if above >= 0:
        return max(own, above)
    if tag in CONTENT_TAGS:
        return own + above if own >= TELLING_TAG else above
    return max(above, -0.5 * TELLING_WORD)


class Block:
    """A run of text: its element, the element's parent, and how many elements lie between it and the block before."""

    __slots__ = ("text", "tag", "parent", "apart", "evidence", "links")

    def __init__(self, text, tag, parent, apart, evidence, links):
        self.text, self.tag, self.parent, self.apart, self.evidence, self.links = text, tag, parent, apart, evidence, links


class _Open:
    """An element that hasn't ended yet: ``block`` and ``wall`` are the places of the nearest block element, and of the nearest block or unseen one."""

    __slots__ = ("tag", "number", "evidence", "inside", "unseen", "block", "wall", "depth")

    def __init__(self, tag, number, evidence, inside, unseen, block, wall, depth):
        self.tag, self.number, self.evidence, self.inside, self.unseen, self.block, self.wall, self.depth = tag, number, evidence, inside, unseen, block, wall, depth


def _tags(page: str):
    """(start, stop, closing, name, attributes) of each tag, without a name for a comment or the like; nothing behind the last > is searched again and again.

    What is sent back is where to go on.
    """
    at, last = 0, page.rfind(">")
    while at <= last:
        m = _TOKEN.search(page, at, last + 1)
        if m is None:
            break
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        at = m.end()
        if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, at):
            at = len(page)  # a comment without an end
        jump = yield m.start(), at, closing, name, attributes
        if jump is not None:
            at = jump
    # No tag can end any more; what a comment opens goes to the end.
    m = _OPENS.search(page, max(at, last + 1))
    if m:
        yield m.start(), len(page), "", None, ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, with where they stand; linear in the page."""
    out: list[Block] = []
    stack = [_Open("", 0, 0.0, False, False, 0, 0, 0)]
    places: dict[str, list[int]] = {}  # of open elements, by name
    count, links, pieces, link_chars = 0, 0, [], 0
    lowest, depth_before = 0, 0  # the least depth since the last block, and that block's depth

    def flush() -> None:
        nonlocal pieces, link_chars, lowest, depth_before
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = stack[stack[-1].block]
                parent = stack[stack[own.block - 1].block] if own.block else own
                low = min(lowest, own.depth)
                out.append(Block(text, own.tag, parent.number, own.depth + depth_before - 2 * low, stack[-1].evidence, min(1.0, link_chars / len(text))))
                lowest = depth_before = own.depth
        pieces, link_chars = [], 0

    def text(raw: str) -> None:
        nonlocal link_chars
        if raw and not stack[-1].unseen:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if links:
                link_chars += len(raw.strip())

    def end(k: int) -> None:
        """Elements from place k on end."""
        nonlocal lowest
        while len(stack) > k:
            places[stack.pop().tag].pop()
        lowest = min(lowest, stack[-1].depth)

    at, size, lower, found = 0, len(page), None, _tags(page)
    tag_at = next(found, None)
    while tag_at is not None:
        start, stop, closing, tag, attributes = tag_at
        text(page[at:start])
        at, jump = stop, None
        if tag:
            tag = tag.lower()
            if not closing and tag in RAW_TAGS:
                if not attributes.endswith("/"):
                    lower = page.lower() if lower is None else lower
                    if len(lower) != size:  # lower-casing changed lengths: search without it
                        close = re.compile(f"</{tag}", re.I).search(page, at)
                        close = close.start() if close else -1
                    else:
                        close = lower.find(f"</{tag}", at)
                    at = jump = size if close < 0 else (page.find(">", close) + 1 or size)
            else:
                unseen = stack[-1].unseen
                if tag in BLOCK_TAGS and not unseen:
                    flush()
                elif tag == "br":
                    pieces.append(" ")
                if closing:
                    if tag == "a":
                        links = max(0, links - 1)
                    k = places[tag][-1] if places.get(tag) else 0
                    # An inline end tag doesn't close blocks.
                    if k and (tag in BLOCK_TAGS or tag in UNSEEN_TAGS or k > stack[-1].block):
                        if unseen and tag in BLOCK_TAGS and not stack[k].unseen:
                            while stack[-1].unseen:  # never ended
                                end(len(stack) - 1)
                            flush()
                        end(k)
                else:
                    if tag == "a":
                        links += 1
                    if tag not in VOID_TAGS and not attributes.endswith("/"):
                        if ends := IMPLIED_END.get(tag):
                            if stack[stack[-1].wall].tag in ends:
                                end(stack[-1].wall)
                        elif tag in BLOCK_TAGS and stack[-1].tag == "p":
                            end(len(stack) - 1)
                        above = stack[-1]
                        own = _evidence(tag, attributes, above.inside) if tag != "body" and tag != "html" else 0.0
                        count += 1
                        if tag in BLOCK_TAGS or own:
                            place, is_block = len(stack), tag in BLOCK_TAGS
                            places.setdefault(tag, []).append(place)
                            stack.append(
                                _Open(
                                    tag, count, _inherited(tag, own, above.evidence), above.inside or tag in CONTENT_TAGS, above.unseen or tag in UNSEEN_TAGS,
                                    place if is_block else above.block, place if is_block or tag in UNSEEN_TAGS else above.wall, above.depth + is_block,
                                )
                            )
        try:
            tag_at = found.send(jump)
        except StopIteration:
            tag_at = None
    text(page[at:])
    while stack[-1].unseen:
        end(len(stack) - 1)
    flush()
    return out


N_FEATURES = 8
#: Weights of shape where the sample has no telling content, or no telling boilerplate, to learn from.
PLAIN_SHAPE = np.array([-2.0, 0.5, -3.0, 1.0, 1.5, -0.5, 1.5, 1.0])


def features(blocks: list[Block]) -> np.ndarray:
    """The shape of each block, without what its elements say."""
    rows = np.zeros((len(blocks), N_FEATURES))
    for k, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        rows[k] = (
            1.0,
            np.log1p(n) / 5,
            b.links,
            b.text[-1] in ".!?:;\"'",
            min(1.0, words / 40),
            n / words > 14,
            b.tag in ("p", "blockquote", "pre"),
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
        )
    return rows


class Model(NamedTuple):
    """Weights of shape, what names are worth, and smoothness by distance and of blocks with one parent."""

    shape: np.ndarray
    tag: float = MOST_TAG
    word: float = MOST_WORD
    near: tuple[float, ...] = tuple(ADJACENT / (1 + d) for d in range(FAR + 1))
    sibling: float = SIBLING


def neighbours(blocks: list[Block]):
    """(first, second, distance) of blocks that follow each other, (first, second, None) of blocks with one parent."""
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            yield k - 1, k, min(b.apart, FAR)
        if (j := last.get(b.parent)) is not None:
            yield j, k, None
        last[b.parent] = k


def _share(same: float, other: float) -> float:
    """How far counts bear out that two things agree: 1 at the prior or better, 0 at even odds."""
    return float(np.clip(np.log((same + PRIOR + 1) / (other + 1)) / np.log(PRIOR + 1), 0, 1))


def train(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE_PAGES) -> Model:
    """The model from ``sample`` pages: shape from blocks in telling elements, names and smoothness from how they agree."""
    hashed = pages.select(F.xxhash64(F.col(id_col).cast("string"), F.col(html_col)).alias("h"), F.col(html_col).alias("html"))
    least = [r.h for r in hashed.select("h").orderBy("h").limit(sample).collect()]  # ``sample`` numbers
    if not least:
        return Model(PLAIN_SHAPE)

    def run(batches):
        for batch in batches:
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page or "")
                named = [b for b in blocks if b.evidence]
                pairs = np.zeros((FAR + 2, 2), np.int64)
                for a, b, d in neighbours(blocks):
                    if blocks[a].evidence and blocks[b].evidence:
                        pairs[FAR + 1 if d is None else d, int((blocks[a].evidence > 0) == (blocks[b].evidence > 0))] += 1
                rows = [features(named).ravel(), np.array([b.evidence for b in named]), pairs.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([r.tolist()], pa.list_(pa.float64())) for r in rows], ["x", "e", "pairs"])

    some = hashed.filter(F.col("h") <= least[-1]).limit(sample).select("html")
    got = some.mapInArrow(run, "x array<double>, e array<double>, pairs array<double>").toArrow()
    x = np.concatenate([np.array(v, float) for v in got.column("x").to_pylist()]).reshape(-1, N_FEATURES)
    e = np.concatenate([np.array(v, float) for v in got.column("e").to_pylist()])
    return fit(x, e, np.sum([np.array(v).reshape(-1, 2) for v in got.column("pairs").to_pylist()], axis=0))


def fit(x: np.ndarray, evidence: np.ndarray, pairs: np.ndarray) -> Model:
    """The model of named blocks' features and evidence; pairs: by distance, and last of one parent, how many differ and agree."""
    telling = np.abs(evidence) >= TELLING_TAG
    rows, y = x[telling], evidence[telling] > 0
    learnable = bool(y.any() and not y.all())
    weights = np.zeros(N_FEATURES) if learnable else PLAIN_SHAPE
    for _ in range(30 if learnable else 0):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, rows.T @ (y - p) - weights)
        weights = weights + step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    shape = x @ weights
    agrees = (evidence > 0) == (shape > 0)
    worth = []
    for kind, most in ((telling, MOST_TAG), (~telling, MOST_WORD)):
        sure = kind & (np.abs(shape) > 1)
        worth.append(most * _share(np.sum(agrees[sure]), np.sum(~agrees[sure])))
    shares = [_share(same, other) for other, same in pairs]
    return Model(weights, *worth, tuple(ADJACENT / (1 + d) * shares[d] for d in range(FAR + 1)), SIBLING * shares[FAR + 1])


def edges_of(blocks: list[Block], model: Model) -> list[tuple[int, int, float]]:
    """Smoothness edges: blocks that follow each other, weaker the more elements lie between, and blocks of one parent."""
    return [(a, b, model.sibling if d is None else model.near[d]) for a, b, d in neighbours(blocks)]


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum(max(gain, 0) of False) + sum(max(-gain, 0) of True) + weights of edges cut.

    A node whose gain outweighs all of its edges has its label for sure; it is fixed and its
    edges go over to its neighbours' gains.  What is left is solved by augmenting paths.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if w > 0 and a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if label[k] is None and abs(gain[k]) >= sum(near[k].values()):
            label[k] = gain[k] > 0
            for j, w in near[k].items():
                gain[j] += w if label[k] else -w
                del near[j][k]
                waiting.append(j)
            near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        place = {k: i for i, k in enumerate(left)}
        own = [gain[k] for k in left]
        for k, content in zip(left, _source_side(own, [(place[k], place[j], w) for k in left for j, w in near[k].items() if k < j])):
            label[k] = content
    return [bool(x) for x in label]


def _source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow: shortest augmenting paths, all of one length at a time."""
    n = len(gain)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]  # numbers of arcs; arc e ^ 1 goes back
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, g in enumerate(gain):
        if g > 0:
            arc(source, k, g, 0.0)
        elif g < 0:
            arc(k, sink, -g, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            if level[sink] >= 0 and level[a] >= level[sink]:
                break
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                most = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= most
                    room[e ^ 1] += most
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            arcs, k = out[a], following[a]
            while k < len(arcs) and not (room[arcs[k]] > 1e-12 and level[to[arcs[k]]] == level[a] + 1):
                k += 1
            following[a] = k
            if k < len(arcs):
                path.append(arcs[k])
                a = to[arcs[k]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break


def gains(blocks: list[Block], model: Model) -> np.ndarray:
    """What calling each block content is worth over calling it boilerplate."""
    shape = np.clip(features(blocks) @ model.shape, -2.5, 2.5)
    evidence = np.array([b.evidence for b in blocks])
    # A page without telling elements is judged by shape; one with them also says what lies outside.
    outside = -1.0 if (evidence > 0).any() else 0.5
    by_tag = np.abs(evidence) >= TELLING_TAG
    named = evidence / np.where(by_tag, TELLING_TAG, TELLING_WORD) * np.where(by_tag, model.tag, model.word) + MOST_SHAPE / 2.5 * shape
    return np.where(evidence <= -HIDDEN, -1e6, np.where(evidence == 0, shape + outside, named))


def main_text(page: str, model: Model) -> str:
    """The content blocks of a page, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    labels = minimum_cut(gains(blocks, model).tolist(), edges_of(blocks, model))
    return "\n\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html is empty and has an empty text; so has a page without content.  Rows that
    share an id are extracted each.  An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    model = train(rows, "page_id", "html", sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                text = [main_text(page, model) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
