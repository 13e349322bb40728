"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 2).

A page is read into leaf blocks: runs of text between block-level tags, with
the tags and the class and id words of their ancestors. A chain of two labels
(text, rest) runs over the blocks; its features are ancestor tags, ancestor
words and properties of the text. The chain is trained on labelled pages and
decoded by Viterbi; the blocks labelled as text, joined, are the result.

Labelled pages: a bounded sample of pages (``TRAIN_PAGES``) whose blocks are
labelled by their ``article`` element. Since one site's markup would teach the
chain that single tag, each sampled page is also rendered anew in layouts with
other containers, and with notices, forms, sidebars and reader comments that
borrow text of other sampled pages.

Cases: null or empty html gives an empty text, and so does a page without
visible text; unclosed tags, cut-off pages and cut-off references are read as
far as they go, and only scripts, styles, titles and text areas may swallow the
rest of a page; deep nesting costs no more than its tags; without any labelled page every visible block is kept;
repeated rows give equal results; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import smallest_hashes

#: Most pages that the chain is trained on, the ones with the smallest hashes of their ids.
TRAIN_PAGES = 200
#: Longer pages are not taken for training, so the sample is bounded in bytes and blocks too.
TRAIN_CHARS = 20_000
TRAIN_BLOCKS = 40
STEPS = 100
LAYOUTS = 4
MARK = "\ue000"
UNIT = 2.0**-32

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark object q s samp small span strike strong sub"
    " sup time tt u var wbr math mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mstyle semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Read as they stand up to their end tag, or to the end of the page.
RAW = frozenset("script style textarea title".split())
#: What is in them stands in for something else; read over up to their end tag if there is one.
INSTEAD = frozenset("noscript template iframe".split())
#: Those that do not even part the text around them.
UNSEEN = frozenset("script style template noscript".split())
#: Their own text is no text of the page; they end with an element around them or before a block.
CONTROLS = frozenset("svg select datalist optgroup option".split())
#: Start tags that close an open element of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol p pre section table ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORDS = re.compile(r"[a-zA-Z]+")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    own: str  # the innermost element that is not inline
    tags: frozenset[str]  # of all open elements; empty where ``base`` is counted instead
    words: frozenset[str]
    linked: int
    base: int = 0  # the weights of tags and words


class Open:
    """The open elements, with counts of their tags and words, and the sum of the weights of those that occur."""

    def __init__(self, weights: dict[str, int] | None) -> None:
        self.stack: list[tuple[str, frozenset[str]] | None] = []  # None: an inline element closed out of turn
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of the elements that are not inline
        self.words: dict[str, int] = {}
        self.controls = 0
        self.weights, self.base = weights, 0

    def push(self, name: str, words: frozenset[str]) -> None:
        places = self.places.setdefault(name, [])
        if self.weights is not None:
            if not places:
                self.base += self.weights.get(f"tag:{name}", 0)
            self.base += sum(self.weights.get(f"word:{w}", 0) for w in words if not self.words.get(w))
        places.append(len(self.stack))
        for w in words:
            self.words[w] = self.words.get(w, 0) + 1
        self.controls += name in CONTROLS
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, words))

    def _forget(self, entry: tuple[str, frozenset[str]]) -> None:
        name, words = entry
        self.places[name].pop()
        self.controls -= name in CONTROLS
        if self.weights is not None and not self.places[name]:
            self.base -= self.weights.get(f"tag:{name}", 0)
        for w in words:
            self.words[w] -= 1
            if not self.words[w]:
                del self.words[w]
                if self.weights is not None:
                    self.base -= self.weights.get(f"word:{w}", 0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            entry = self.stack.pop()
            if entry is not None:
                self._forget(entry)
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def end(self, name: str) -> None:
        """An end tag; one of an inline element reaches no further than the block around it."""
        places = self.places.get(name)
        if not places:
            return
        if name not in INLINE:
            self.cut(places[-1])
        elif not self.blocks or places[-1] > self.blocks[-1]:
            entry, self.stack[places[-1]] = self.stack[places[-1]], None
            self._forget(entry)
            while self.stack and self.stack[-1] is None:
                self.stack.pop()

    def own(self, nth: int = 1) -> str:
        return self.stack[self.blocks[-nth]][0] if len(self.blocks) >= nth else ""

    def close_before(self, name: str) -> None:
        """What the start tag ``name`` closes."""
        if name in ENDS_P:
            if self.controls:
                self.cut(min(self.places[c][0] for c in CONTROLS if self.places.get(c)))
            if self.own() == "p":
                self.cut(self.blocks[-1])
        elif name in CLOSES:
            nth = 2 if self.own() == "p" else 1
            if self.own(nth) in CLOSES[name]:
                self.cut(self.blocks[-nth])
                if self.own() in CLOSES[name]:
                    self.cut(self.blocks[-1])


def blocks_of(page: str | None, weights: dict[str, int] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order; texts of scripts, styles, titles and the like are left out.

    With the ``weights`` of tags and words, blocks carry their sum in place of the tags and words themselves,
    so the work grows with the page and not with its depth.
    """
    page = page or ""
    opened = Open(weights)
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    none: frozenset[str] = frozenset()
    endless: set[str] = set()
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                if weights is None:
                    tags = frozenset(t for t, places in opened.places.items() if places)
                    out.append(Block(text, opened.own(), tags, frozenset(opened.words), linked))
                else:
                    out.append(Block(text, opened.own(), none, none, linked, opened.base))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if opened.controls:
            return
        held.append(text)
        if opened.places.get("a"):
            linked += len(text.strip())

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        whole = attributes.endswith("/")
        if name in RAW or (name in INSTEAD and name not in endless):
            stop = None
            if not closing and not whole:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                if stop is not None:
                    at = page.find(">", stop.end()) + 1 or end
                elif name in RAW:
                    at = end
                else:
                    endless.add(name)
            if name not in UNSEEN:
                flush()
            continue
        if name not in INLINE:
            flush()
        if closing:
            opened.end(name)
            continue
        if name in VOID:
            continue
        opened.close_before(name)
        if not attributes.rstrip().endswith("/"):
            words = none
            if attributes:
                found = {w.lower() for v in NAMES.findall(attributes) for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v))}
                if HIDDEN.search(attributes):
                    found.add("~hidden")
                words = frozenset(found)
            opened.push(name, words)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the active features of each block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        ends = b.text[-1]
        f = ["bias", f"own:{b.own}"]
        f += [f"tag:{t}" for t in b.tags]
        f += [f"word:{w}" for w in b.words]
        f.append(f"size:{min(8, size.bit_length())}")
        f.append(f"words:{min(6, words.bit_length())}")
        f.append(f"linked:{min(4, 4 * b.linked // max(1, size))}")
        f.append("ends:stop" if ends in ".!?…\"”»" else "ends:other")
        f.append("comma" if "," in b.text else "no comma")
        if "©" in b.text or "·" in b.text or "|" in b.text:
            f.append("sign")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


class Chain:
    """Two labels: 1 for text, 0 for the rest. Weights give the score of 1 against 0."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.trained = False

    def emissions(self, names: list[list[str]]) -> np.ndarray:
        w = self.weights
        return np.array([sum([w.get(f, 0.0) for f in fs]) for fs in names])

    def whole_weights(self) -> dict[str, int]:
        """The weights of tags and words in units of ``UNIT``, so that sums of them are exact in any order."""
        return {f: round(w / UNIT) for f, w in self.weights.items() if f.startswith(("tag:", "word:"))}

    def decode(self, names: list[list[str]], base: list[float] | None = None) -> list[int]:
        """Viterbi; ``base`` is added to the score of each block."""
        if not names:
            return []
        if not self.trained:
            return [1] * len(names)
        (m00, m01), (m10, m11) = self.moves.tolist()
        e = self.emissions(names).tolist()
        if base is not None:
            e = [x + y for x, y in zip(e, base)]
        zero, one = self.start[0], self.start[1] + e[0]
        back: list[tuple[int, int]] = []
        for x in e[1:]:
            a, b, c, d = zero + m00, one + m10, zero + m01, one + m11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + x
        label = int(one > zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-3) -> "Chain":
        """Maximum likelihood with forward and backward sums over all pages at once, by Adam."""
        pages = [p for p in pages if p[0]]
        if not pages:
            return self
        known = {f: k for k, f in enumerate(sorted({f for names, _ in pages for fs in names for f in fs}))}
        n, longest = len(pages), max(len(p[1]) for p in pages)
        block = np.cumsum([0, *[len(p[1]) for p in pages]])
        feature = np.array([known[f] for names, _ in pages for fs in names for f in fs])
        owner = np.repeat(np.arange(block[-1]), [len(fs) for names, _ in pages for fs in names])
        size = np.diff(block)
        inside = np.arange(longest) < size[:, None]
        y = np.zeros((n, longest), dtype=int)
        y[inside] = [v for _, labels in pages for v in labels]
        both = inside[:, 1:]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        seen_start = np.bincount(y[:, 0], minlength=2).astype(float)
        x = np.zeros(len(known) + 6)
        first, second = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            w, moves, start = x[:-6], x[-6:-2].reshape(2, 2), x[-2:]
            e = np.zeros((n, longest, 2))
            e[..., 1][inside] = np.bincount(owner, w[feature], int(block[-1]))
            ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            ahead[:, 0] = start + e[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + e[:, t]
                ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(inside[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            p = np.exp(ahead + behind - total[:, None, None])
            pair = np.exp(
                ahead[:, :-1, :, None] + moves + (e + behind)[:, 1:, None, :] - total[:, None, None, None]
            )
            gradient = np.zeros_like(x)
            gradient[:-6] = np.bincount(feature, (y - p[..., 1])[inside][owner], len(known))
            gradient[-6:-2] = (seen - pair[both].sum(axis=0)).ravel()
            gradient[-2:] = seen_start - p[:, 0].sum(axis=0)
            gradient = gradient / n - ridge * x
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            x = x + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = {f: float(x[k]) for f, k in known.items()}
        self.moves, self.start, self.trained = x[-6:-2].reshape(2, 2), x[-2:], True
        return self


def extract(page: str | None, chain: Chain, weights: dict[str, int] | None = None) -> str:
    """The main text; ``weights`` are the chain's whole weights, made once for many pages."""
    blocks = blocks_of(page, chain.whole_weights() if weights is None else weights)
    labels = chain.decode(features(blocks), [b.base * UNIT for b in blocks])
    return " ".join(b.text for b, y in zip(blocks, labels) if y)


# Layouts that labelled pages are rendered in: containers of the text, and of what stands around and inside it.
TEXT_BOXES = (
    '<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>',
    '<section class="post-body">{}</section>', '<div class="entry">{}</div>', '<main><article class="story">{}</article></main>',
    '<div class="article-text">{}</div>', '<div role="main">{}</div>',
)
BEFORE = (
    '<nav>{}</nav>', '<header>{}</header>', '<div class="menu">{}</div>', '<div id="header">{}</div>',
    '<div class="cookie-notice">{}</div>', '<div class="banner">{}</div>', '<div class="ad">{}</div>', '<aside>{}</aside>',
    '<div class="breadcrumb">{}</div>', '<form action="/search">{}</form>', '<div class="top-bar">{}</div>', '<div class="notice">{}</div>',
)
AFTER = (
    '<footer>{}</footer>', '<div id="footer">{}</div>', '<aside class="sidebar">{}</aside>', '<div class="related">{}</div>',
    '<section class="comments"><div class="comment">{}</div></section>', '<div id="comments">{}</div>', '<div class="ads">{}</div>',
    '<form class="newsletter">{}</form>', '<div class="share">{}</div>', '<div class="widget">{}</div>', '<div class="copyright">{}</div>',
    '<ul class="reader-comments"><li>{}</li></ul>', '<div class="disclaimer">{}</div>', '<div class="modal popup">{}</div>',
    '<div class="promo">{}</div>', '<div class="sponsored advert advertisement">{}</div>',
)
WITHIN = (
    '<div class="ad">{}</div>', '<aside>{}</aside>', '<div class="share">{}</div>', '<form>{}</form>', '<div class="comment">{}</div>',
    '<footer>{}</footer>', '<section class="comments">{}</section>', '<nav class="toc">{}</nav>', '<div class="promo">{}</div>',
    '<div class="notice">{}</div>', '<section id="comments">{}</section>', '<header>{}</header>', '<div class="related">{}</div>',
)


def render(text: list[Block], others: list[str], dice: random.Random) -> str:
    """A page with the same text in another layout; ``others`` are texts of other pages.

    Blocks of the text begin with ``MARK``, so that they can be told from what is put around them.
    """

    def filler() -> str:
        kind = dice.random()
        if kind < 0.25:
            return "<ul>" + "".join(f'<li><a href="/">{entities.escape(w)}</a></li>' for w in dice.choice(others).split()[:6]) + "</ul>"
        if kind < 0.6:
            return entities.escape(dice.choice(others))
        return "".join(f"<p>{entities.escape(dice.choice(others))}</p>" for _ in range(dice.randint(1, 3)))

    parts = []
    for k, b in enumerate(text):
        own = b.own if b.own in ("h1", "h2", "h3", "blockquote", "pre") else "p"
        parts.append(f"<{own}>{MARK}{entities.escape(b.text)}</{own}>")
        if k and dice.random() < 0.12:
            parts.append(dice.choice(WITHIN).format(filler()))
    if dice.random() < 0.4:
        parts.append(dice.choice(WITHIN).format(filler()))
    head = "".join(f.format(filler()) for f in dice.sample(BEFORE, dice.randint(1, 4)))
    tail = "".join(f.format(filler()) for f in dice.sample(AFTER, dice.randint(1, 5)))
    return f"<body>{head}{dice.choice(TEXT_BOXES).format(''.join(parts))}{tail}</body>"


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page and whether an ``article`` holds them."""
    blocks = blocks_of(page)
    return blocks, [int("article" in b.tags) for b in blocks]


def training_set(pages: list[str], layouts: int = LAYOUTS, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Feature names and labels of the pages as they are and in other layouts."""
    read = [(b, y) for b, y in map(labelled, pages) if 0 < sum(y) < len(y) <= TRAIN_BLOCKS]
    if not read:
        return []
    others = [b.text for bs, _ in read for b in bs]
    dice = random.Random(seed)
    out = [(features(b), y) for b, y in read]
    for bs, ys in read:
        text = [b for b, y in zip(bs, ys) if y]
        for _ in range(layouts):
            shown = text[: dice.randint(1, len(text))] if dice.random() < 0.5 else text
            made = blocks_of(render(shown, others, dice))
            labels = [int(b.text.startswith(MARK)) for b in made]
            for b in made:
                b.text = b.text.removeprefix(MARK).strip() or "-"
            out.append((features(made), labels))
    return out


def train(pages: DataFrame, id: str = "page_id", html: str = "html", most: int = TRAIN_PAGES) -> Chain:
    """Train on a bounded sample; at most ``most`` pages of ``TRAIN_CHARS`` come to the driver."""
    fit_for_it = pages.select(F.col(id).alias("_id"), F.col(html).alias("html")).where(
        (F.length("html") <= TRAIN_CHARS) & F.col("html").contains("<article")
    )
    sample = smallest_hashes(fit_for_it, "_id", most).select("html").collect()
    return Chain().fit(training_set(sorted(r["html"] for r in sample)))


def main_text(pages: DataFrame, chain: Chain, id: str = "page_id", html: str = "html") -> DataFrame:
    """``id`` and ``main_text`` of every row."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType([StructField(id, pages.schema[id].dataType), StructField("main_text", StringType())])

    def run(batches):
        weights = chain.whole_weights()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [extract(h, chain, weights) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id, "main_text"])

    return pages.select(id, html).mapInArrow(run, out)
