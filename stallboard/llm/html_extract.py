"""Operator 1: main text of web pages by a tree-structured graphical model over the DOM.

Every element of a page is a node with a label, content or not. A node's own potential comes
from its tag, its class and id words, its text length, link density and the like; each
parent-child pair has a potential by the child's kind. Sum-product message passing, upward from
the leaves and then downward from the root, gives every node's exact content marginal; text of
nodes with a marginal above one half is kept. Elements that never hold an article's text (scripts,
styles, menus, page footers, side bars, forms) are observed as not content.

The weights maximise the likelihood of labelled pages: layouts drawn by ``labelled_layouts`` and
at most ``TRAIN_PAGES`` rows of the table (those with the smallest hashes) whose publisher marked
exactly one article. The gradient needs only the marginals of the same message passing.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline; nothing is capped.

Nulls and empties: a null or empty page has empty text. Pages may be cut off or badly nested
anywhere. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, hash_bound

TRAIN_PAGES = 100
TRAIN_PAGE_CHARS = 200_000
LAYOUTS = 500
STEPS = 150

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title svg iframe canvas object nav footer aside form button select textarea "
                  "label dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br img".split())
CONTAINERS = frozenset("body html main article section div header td table tbody tr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                     "section table ul figure".split())
CLOSES_SELF = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
               "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure",
        "figcaption", "header", "body", "html", "a", "span", "b", "address"]
# Words in class, id and role attributes that name a part of a page.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "edge": "header footer banner masthead contentinfo copyright legal colophon bottom",
    "side": "sidebar side aside widget widgets rail complementary related recommended recommendations more popular trending",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner-ad dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall dialog",
    "reader": "comment comments reply replies disqus respond discussion feedback commentlist",
    "share": "share sharing social follow tags tagcloud meta byline search login",
    "text": "article content post entry main story text body page prose",
}
TOKEN = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
N_FEATURES = len(TAGS) + len(WORDS) + 10
#: Kinds of pairs: the child is inline, block, container, or named or observed as something beside the
#: text; each below the page's body and below any other element.
KINDS = 8


@dataclass
class Page:
    """Elements of a page in document order, and its text events."""
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    words: list[frozenset[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    #: (node, text), or (-1, "") where a block ends
    events: list[tuple[int, str]] = field(default_factory=list)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self._push("html", [])

    def _push(self, tag: str, attrs: list) -> None:
        page = self.page
        found, label, hidden = set(), -1, False
        for name, value in attrs:
            if name in ("class", "id", "role"):
                found.update(TOKEN[w] for w in re.split(r"[\s_\-]+", (value or "").lower()) if w in TOKEN)
            elif name == "data-y":
                label = int(value == "1")
            elif name == "hidden" or name == "style" and "display:none" in (value or "").replace(" ", ""):
                hidden = True
        page.tag.append(tag)
        page.parent.append(self.stack[-1] if self.stack else -1)
        page.words.append(frozenset(found))
        page.label.append(label if label >= 0 or not self.stack else page.label[self.stack[-1]])
        page.hidden.append(hidden)
        self.stack.append(len(page.tag) - 1)
        self.open[tag] += 1

    def _pop(self) -> None:
        tag = self.page.tag[self.stack.pop()]
        self.open[tag] -= 1
        if tag not in INLINE:
            self.page.events.append((-1, ""))

    def _close_until(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        if self.open[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                own = self.page.tag[self.stack[k]]
                if own == tag:
                    while len(self.stack) > k:
                        self._pop()
                    return
                if own in stop:
                    return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close_until("p", frozenset(["td", "table"]))
        elif tag in CLOSES_SELF:
            self._close_until(tag, CLOSES_SELF[tag])
        if tag not in INLINE:
            self.page.events.append((-1, ""))
        elif tag == "br":
            self.page.events.append((self.stack[-1], " "))
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag != "html":
            self._close_until(tag)

    def handle_data(self, data: str) -> None:
        self.page.events.append((self.stack[-1], data))


def parse(html: str | None) -> Page:
    tree = _Tree()
    tree.feed((html or "").replace("\x00", ""))
    tree.close()
    return tree.page


@dataclass
class Forest:
    """Nodes of many pages, parents before children, with what the model sees of each."""
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    observed: np.ndarray
    label: np.ndarray
    first: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tag) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    own, linked, marks, paragraphs = (np.zeros(n) for _ in range(4))
    parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + f, -1) for p, f in zip(pages, first)] or [np.empty(0, int)]).astype(np.int64)
    f = np.zeros((n, N_FEATURES), np.float32)
    kind, observed, depth, inside, in_link = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    at = len(TAGS) + len(WORDS)
    text_group = list(WORDS).index("text")
    number = {t: k for k, t in enumerate(TAGS)}
    i = 0
    for page, begin in zip(pages, first):
        for tag, words, hidden in zip(page.tag, page.words, page.hidden):
            up = parent[i]
            if tag in number:
                f[i, number[tag]] = 1
            for w in words:
                f[i, len(TAGS) + w] = 1
            observed[i] = hidden or tag in NEVER
            aside = observed[i] or any(w != text_group for w in words)
            kind[i] = 3 if aside else 0 if tag in INLINE else 2 if tag in CONTAINERS else 1
            if up >= 0:
                depth[i] = depth[up] + 1
                kind[i] += 4 * (page.tag[up - begin] in ("body", "html"))
                inside[i] = inside[up] or f[up, 0] > 0 or f[up, 1] > 0
                in_link[i] = in_link[up]
            in_link[i] |= tag == "a"
            if tag == "p" and up >= 0:
                paragraphs[up] += 1
            i += 1
    for page, begin in zip(pages, first):
        for node, text in page.events:
            if node >= 0 and text and not text.isspace():
                size = len(text)
                own[begin + node] += size
                marks[begin + node] += text.count(".") + text.count(",")
                if in_link[begin + node]:
                    linked[begin + node] += size
    # nodes by depth, sorted once: badly nested pages have as many levels as nodes
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    sums = np.stack((own, linked, marks), axis=1)
    for level in levels[:0:-1]:
        shown = level[~observed[level]]
        np.add.at(sums, parent[shown], sums[shown])
    total, links, stops = sums.T
    page_total = np.repeat(total[first[:-1]], sizes)
    f[:, at] = np.log1p(total) / 8
    f[:, at + 1] = links / np.maximum(total, 1)
    f[:, at + 2] = total / np.maximum(page_total, 1)
    f[:, at + 3] = np.log1p(paragraphs) / 3
    f[:, at + 4] = np.minimum(stops / np.maximum(total, 1) * 20, 2)
    f[:, at + 5] = inside
    f[:, at + 6] = total < 25
    f[:, at + 7] = total > 200
    f[:, at + 8] = np.minimum(depth, 10) / 10
    f[:, at + 9] = 1
    label = np.array([x for p in pages for x in p.label], np.int64)
    return Forest(parent, depth, kind, f, observed, label, first, levels)


@dataclass
class Model:
    """Weights of the content label per feature, and (kind, parent label, child label) pair potentials."""
    unary: np.ndarray
    pair: np.ndarray


def marginals(model: Model, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Content marginal of every node, and the (node, parent label, label) pair marginals."""
    n = len(trees.parent)
    local = np.zeros((n, 2))
    local[:, 1] = trees.features @ model.unary
    local[trees.observed, 1] = -40.0
    pair = model.pair[trees.kind]  # (n, parent label, own label)
    inward, up = local, np.zeros((n, 2))
    for own in trees.levels[:0:-1]:  # upward: what a node's subtree tells its parent
        told = _log_sum(pair[own] + inward[own][:, None, :], 2)
        up[own] = told - told.max(axis=1, keepdims=True)
        np.add.at(inward, trees.parent[own], up[own])
    belief, joint = inward.copy(), np.zeros((n, 2, 2))
    for own in trees.levels[1:]:  # downward: what the rest of the tree tells a node
        rest = belief[trees.parent[own]] - up[own]
        both = rest[:, :, None] + pair[own] + inward[own][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        grown = np.exp(both)
        joint[own] = grown / grown.sum(axis=(1, 2), keepdims=True)
        # belief of the node: its own subtree plus the message from above
        belief[own] = _log_sum(both, 1)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log(exp + exp) over an axis of two."""
    a, b = np.take(x, 0, axis), np.take(x, 1, axis)
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def train(pages: list[Page], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum likelihood by gradient steps (Adam); gradients are observed less expected counts."""
    trees = forest(pages)
    model = Model(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    y = trees.label.clip(0)
    has_parent = trees.parent >= 0
    up = y[trees.parent[has_parent]]
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (trees.kind[has_parent], up, y[has_parent]), 1)
    free = ~trees.observed
    m, v = [0.0, 0.0], [0.0, 0.0]
    scale = 1 / max(len(pages), 1)
    for step in range(1, steps + 1):
        p, joint = marginals(model, trees)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, trees.kind[has_parent], joint[has_parent])
        grads = [trees.features[free].T @ (y - p)[free] * scale - decay * model.unary,
                 (seen - expected) * scale - decay * model.pair]
        for k, (name, g) in enumerate(zip(("unary", "pair"), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            move = rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            setattr(model, name, getattr(model, name) + move)
    return model


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("aeiou") + rng.choice("bcdlmnrst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?"])


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng, 1, 18) for _ in range(rng.randint(1, 6)))
    if rng.random() < 0.3:
        text = f"{text} <{(t := rng.choice(['b', 'i', 'em', 'span', 'code']))}>{_sentence(rng, 1, 4)}</{t}> {_sentence(rng, 2, 9)}"
    if rng.random() < 0.2:
        text += f' <a href="/x">{_sentence(rng, 1, 3)}</a> {_sentence(rng, 2, 9)}'
    return text


def _links(rng: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_sentence(rng, 1, 3)}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"


def _boilerplate(rng: random.Random, inside: bool) -> str:
    def ps(n: int) -> str:
        return "".join(f"<p>{_prose(rng)}</p>" for _ in range(rng.randint(1, n)))

    def name(group: str) -> str:
        return rng.choice(["class", "id"]) + f'="{rng.choice(WORDS[group].split())}"'

    kinds = ["advert", "reader", "share", "side", "notice", "links", "form", "aside"] if inside else ["menu", "advert", "notice", "side", "reader", "edge", "share", "header", "form", "links"]
    kind = rng.choice(kinds)
    tag = rng.choice(["div", "section", "div"])
    body = {"menu": lambda: _links(rng), "advert": lambda: rng.choice([_sentence(rng, 2, 12), ps(1)]), "notice": lambda: rng.choice([_sentence(rng, 4, 20), ps(2)]),
            "side": lambda: f"<h3>{_sentence(rng, 1, 4)}</h3>" + rng.choice([_links(rng), ps(3)]), "edge": lambda: rng.choice([_links(rng), _sentence(rng, 4, 12)]),
            "reader": lambda: f"<h3>{_sentence(rng, 1, 3)}</h3>" + "".join(rng.choice(['<div class="comment">%s</div>', "<li>%s</li>", "%s"]) % ps(2) for _ in range(rng.randint(1, 5))),
            "share": lambda: rng.choice([_links(rng), _sentence(rng, 1, 5)])}
    if kind == "header":
        return f'<header data-y="0"><p>{_sentence(rng, 1, 4)}</p>{rng.choice(["", _links(rng)])}</header>'
    if kind == "form":
        return f'<form data-y="0"><p>{_sentence(rng, 2, 8)}</p><input name="q"></form>'
    if kind == "aside":
        return f'<aside data-y="0">{ps(2)}</aside>'
    if kind == "links":
        return f'<div data-y="0"><p><a href="/a">{_sentence(rng, 2, 7)}</a></p>{_links(rng)}</div>'
    return f'<{tag} {name(kind)} data-y="0">{body[kind]()}</{tag}>'


def labelled_layouts(count: int = LAYOUTS, seed: int = 11) -> list[str]:
    """Drawn pages of many layouts; ``data-y`` labels an element and, unless overridden, all below it."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        title = f"<h1>{_sentence(rng, 1, 9)}</h1>"
        parts = rng.choice([[title], [title], [title], [f"<header>{title}</header>"], []])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            parts.append(rng.choices([
                f"<p>{_prose(rng)}</p>", f"<p>{_prose(rng)}", f"<p><b>{_prose(rng)}<br>", f"<h2>{_sentence(rng, 1, 7)}</h2>",
                "<ul>" + "".join(f"<li>{_sentence(rng, 3, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>",
                f"<blockquote>{_prose(rng)}</blockquote>", f"<pre>{_sentence(rng, 3, 12)}</pre>",
                f"<table><tr><td>{_sentence(rng, 1, 4)}</td><td>{_sentence(rng, 1, 4)}</td></tr></table>",
                f'<figure><img src="x"><figcaption>{_sentence(rng, 3, 9)}</figcaption></figure>'],
                [14, 4, 3, 3, 2, 2, 1, 1, 1])[0])
        bare = rng.random() < 0.12  # no container: the parts stand in the body
        if bare:
            parts = [re.sub(r"^<(\w+)", r'<\1 data-y="1"', part) for part in parts]
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3])):
            parts.insert(rng.randint(0, len(parts)), _boilerplate(rng, True))
        word = rng.choice(WORDS["text"].split())
        begin, end = rng.choice([
            ('<article data-y="1">', "</article>")] * 4 + [('<main data-y="1">', "</main>"), ('<main><article data-y="1">', "</article></main>"),
            (f'<div class="{word}" data-y="1">', "</div>"), (f'<div id="{word}" data-y="1">', "</div>"), ('<div data-y="1">', "</div>"),
            (f'<div><section class="{word}" data-y="1">', "</section></div>"), (f'<div class="wrap"><div class="{word}-{word}" data-y="1">', "</div></div>")])
        if bare:
            begin, end = "", ""
        before = "".join(_boilerplate(rng, False) for _ in range(rng.randint(0, 4)))
        after = "".join(_boilerplate(rng, False) for _ in range(rng.randint(0, 4)))
        out.append(f"<html><head><title>{_sentence(rng, 2, 5)}</title></head><body data-y=\"0\">{before}{begin}{''.join(parts)}{end}{after}</body></html>")
    return out


def _article_labels(page: Page) -> bool:
    """Labels a page by its publisher's markup; False unless it has exactly one article element."""
    articles = [k for k, t in enumerate(page.tag) if t == "article"]
    if len(articles) != 1:
        return False
    for k, up in enumerate(page.parent):
        inherited = up >= 0 and page.label[up] == 1
        page.label[k] = int((inherited or k == articles[0]) and page.tag[k] not in NEVER)
    return True


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Model:
    """Model from the drawn layouts and a bounded sample of the table's marked pages."""
    html = F.col("html").cast("string")
    bound = hash_bound(pages.select("page_id").count(), train_pages)
    sample = (pages.select(F.xxhash64(html).alias("k"), html.alias("h"))
              .where((F.col("k") <= F.lit(bound)) & F.col("h").contains("<article") & (F.length("h") <= TRAIN_PAGE_CHARS))
              .orderBy("k").limit(train_pages).collect())
    own = [page for r in sample if _article_labels(page := parse(r.h))]
    return train([parse(h) for h in labelled_layouts()] + own)


def extract(pages: list[Page], model: Model) -> list[str]:
    """Main text of each parsed page."""
    if not pages:
        return []
    trees = forest(pages)
    keep = (marginals(model, trees)[0] > 0.5) & ~trees.observed
    out = []
    for page, begin in zip(pages, trees.first):
        blocks, current = [], []
        for node, text in [*page.events, (-1, "")]:
            if node < 0:
                if current and (block := " ".join("".join(current).split())):
                    blocks.append(block)
                current = []
            elif keep[begin + node]:
                current.append(text)
        out.append("\n".join(blocks))
    return out


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "html", 4 << 20):
            texts = extract([parse(h) for h in batch.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
