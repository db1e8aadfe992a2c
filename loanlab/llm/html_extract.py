"""Main text of web pages: a linear-chain conditional random field over the leaf blocks.

A page is read into its leaf blocks, in order. A block's features are the tags and name words
(class, id, role) of all its ancestors, its own tag, and what its text looks like: length,
share of link text, sentence ends, signs. The chain has two labels, main and other, with
weights for their sequence, and is decoded by Viterbi.

Training pages are labelled by construction. From a bounded sample of the given pages
(``FIT_PAGES``, chosen by a hash of the html) the blocks are taken apart: those inside
``article`` or ``main`` and outside the elements that HTML itself sets apart from an article
are main. Each sampled page is learned from as it stands and in ``LAYOUTS`` further layouts:
its main blocks in other containers, among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments with the usual names. Fit is by Adam on the likelihood,
with forward-backward, on the driver; extraction covers whole pages on the executors.

Defined results: null or empty html, and pages without main blocks, give an empty text;
scripts, styles, comments and tags never are text; character references are decoded, white
space in a block becomes one space, blocks are joined by one line end; repeated rows come out
as they came in; without pages to learn from every page is laid out from fixed words; an
empty table gives no rows; other columns are ignored unless kept, and a kept column with the
name of a result column gives way to it.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import Shared, col, kept, map_texts, ship, text_of
from loanlab.llm.html_blocks import Contexts, blocks

ship(__name__)

FIT_PAGES = 60        # pages that are learned from
FIT_CHARS = 2_000_000  # characters that are learned from, over all pages
LAYOUTS = 24          # further layouts of each
EPOCHS, RATE, DECAY = 20, 0.05, 1e-5

# fixed values: containers of main text, and of what is set apart, in the naming of common page templates
MAIN = ["article", "main", "div class=content", "div id=content", "div class=post-content", "div class=entry-content",
        "section class=article-body", "div class='story text'", "div role=main", "div id=main", "div class=post",
        "section class=post-body", "div class=page-content", "div itemprop=articleBody class=article"]
APART = ["nav", "header", "footer", "aside", "form", "ul class=menu", "div class=navbar", "div id=header",
         "div class=site-header", "div id=footer", "div class=footer", "div class=sidebar", "div id=sidebar",
         "div class=widget", "div class=ad", "div class=ads", "div class=advert", "div class=advertisement",
         "div class=sponsored", "div class='banner promo'", "div class=cookie-notice", "div class=notice",
         "div class=alert", "div id=cookie-banner", "div class=consent", "div class=popup", "div class=newsletter",
         "div class=subscribe", "section class=comments", "section id=comments", "div class=comment",
         "ol class=comment-list", "div class=reader-comments", "div id=disqus", "div class=related",
         "div class=related-posts", "div class=breadcrumbs", "div class=share", "div class=social",
         "div class=pagination", "div class=toolbar", "div class=login", "div class=search", "div class=disclaimer",
         "div class=copyright", "div role=navigation", "div role=banner", "div role=contentinfo",
         "div role=complementary", "section class=responses", "div class=toc", "div class=tags", "menu", "fieldset"]
SET_APART = frozenset("<nav <header <footer <aside <form <menu <fieldset <head <title <button <select <textarea".split())
PLAIN = "It began in the north of the country and went on for years . Few people knew of it then .".split()

_END = re.compile(r"[.!?…:»”\"]\s*$")


def text_marks(tag: str, text: str, linked: int) -> tuple:
    """Features of a block itself."""
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 10 else 2 if words < 30 else 3
    links = 0 if not linked else 1 if 2 * linked < len(text) else 2
    return (f"tag={tag}", f"size={size}", f"links={links}", f"ends={bool(_END.search(text))}", f"sign={'©' in text}")


class Chain:
    """Weights of the field. A label's score is taken as main against other."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.start = 0.0
        self.step = np.zeros((2, 2))  # from, to

    def fit(self, pages: list[list[tuple[tuple, int]]], seed: int = 3) -> "Chain":
        """``pages``: for every block its features and label."""
        names = sorted({f for page in pages for marks, _ in page for f in marks})
        number = {n: i for i, n in enumerate(names)}
        data = []
        for page in pages:
            if page:
                rows = np.concatenate([np.full(len(m), t) for t, (m, _) in enumerate(page)])
                columns = np.concatenate([[number[f] for f in m] for m, _ in page]).astype(int)
                data.append((rows, columns, np.array([y for _, y in page])))
        theta = np.zeros(len(names) + 5)
        first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(data)):
                grad = self._gradient(theta, len(names), *data[i]) + DECAY * theta
                step += 1
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                theta -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        self.weights = {n: float(w) for n, w in zip(names, theta)}
        self.step, self.start = theta[-5:-1].reshape(2, 2), float(theta[-1])
        return self

    @staticmethod
    def _gradient(theta, n, rows, columns, y) -> np.ndarray:
        """Expected minus found, by forward-backward in log space."""
        size = len(y)
        emit = np.zeros((size, 2))
        np.add.at(emit[:, 1], rows, theta[columns])
        emit[0, 1] += theta[-1]
        move = theta[-5:-1].reshape(2, 2)
        ahead, back = np.zeros((size, 2)), np.zeros((size, 2))
        ahead[0] = emit[0]
        for t in range(1, size):
            ahead[t] = emit[t] + np.logaddexp(ahead[t - 1, 0] + move[0], ahead[t - 1, 1] + move[1])
        for t in range(size - 2, -1, -1):
            later = emit[t + 1] + back[t + 1]
            back[t] = np.logaddexp(move[:, 0] + later[0], move[:, 1] + later[1])
        total = np.logaddexp(*ahead[-1])
        p = np.exp(ahead + back - total)
        grad = np.zeros_like(theta)
        np.add.at(grad[:n], columns, (p[:, 1] - y)[rows])
        if size > 1:
            pair = np.exp(ahead[:-1, :, None] + move + (emit[1:] + back[1:])[:, None, :] - total).sum(axis=0)
            np.subtract.at(pair, (y[:-1], y[1:]), 1)
            grad[-5:-1] = pair.ravel()
        grad[-1] = p[0, 1] - y[0]
        return grad / size

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the best labels for the blocks' scores."""
        if not scores:
            return []
        (oo, om), (mo, mm) = self.step.tolist()
        other, main, came = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            from_main = (main + mo > other + oo, main + mm > other + om)
            other, main = (max(main + mo, other + oo), s + max(main + mm, other + om))
            came.append(from_main)
        label, out = main > other, []
        for pair in reversed(came):
            out.append(label)
            label = pair[label]
        out.append(label)
        return out[::-1]


class Extractor:
    """A fitted chain, with the scores of ancestor sets remembered."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.contexts = Contexts(frozenset(w for w in chain.weights if w[0] in "<."))
        self.scores: list[float] = []
        self.own: dict[tuple, float] = {}

    def extract(self, page: str) -> str:
        found, weights = blocks(page, self.contexts), self.chain.weights
        while len(self.scores) < len(self.contexts.sets):
            self.scores.append(sum(weights[m] for m in self.contexts.sets[len(self.scores)]))
        scores = []
        for context, tag, text, linked in found:
            marks = text_marks(tag, text, linked)
            if marks not in self.own:
                self.own[marks] = sum(weights.get(m, 0.0) for m in marks)
            scores.append(self.scores[context] + self.own[marks])
        return "\n".join([b[2] for b, main in zip(found, self.chain.decode(scores)) if main])


# ---------------------------------------------------------------- training pages

def labelled(page: str) -> list[tuple[tuple, int, str]]:
    """Blocks of a page with features and label, by the elements that HTML sets apart."""
    contexts = Contexts()
    out = []
    for context, tag, text, linked in blocks(page, contexts):
        marks = contexts.sets[context]
        main = not marks.isdisjoint(("<article", "<main")) and marks.isdisjoint(SET_APART)
        names = {f".{w}" for a in APART for w in re.findall(r"[a-z]+", a.partition(" ")[2].partition("=")[2])}
        main = main and marks.isdisjoint(names - {".article", ".content", ".main", ".site", ".list", ".posts"})
        out.append(((*sorted(marks), *text_marks(tag, text, linked)), int(main), text))
    return out


def _wrap(container: str, inner: str) -> str:
    return f"<{container}>{inner}</{container.split()[0]}>"


def _aside(rng, words: list[str]) -> str:
    """Something set apart, short or long, with or without links."""
    container = APART[rng.integers(len(APART))]
    say = lambda n: html.escape(" ".join(words[i] for i in rng.integers(len(words), size=n)))
    kind = rng.integers(5)
    if kind == 0:
        inner = "".join(f'<li><a href="/">{say(rng.integers(1, 4))}</a></li>' for _ in range(rng.integers(2, 7)))
    elif kind == 1:
        inner = say(rng.integers(2, 12)) + "."
    elif kind == 2:
        inner = f"<p>&copy; {say(rng.integers(2, 8))}</p>"
    elif kind == 3:
        heading = f"h{rng.integers(1, 5)}"
        inner = f"<{heading}>{say(rng.integers(1, 5))}</{heading}>" + "".join(f"<p>{say(rng.integers(5, 40))}.</p>" for _ in range(rng.integers(0, 4)))
    else:
        inner = f"<div>{say(rng.integers(3, 30))}. <a href='/'>{say(2)}</a></div>"
    return _wrap(container, inner)


def laid_out(texts: list[str], rng) -> list[tuple[tuple, int]]:
    """A page with the given main texts in some layout, read again, with labels."""
    words = " ".join(texts).split() or PLAIN
    container = MAIN[rng.integers(len(MAIN))]
    inner, mark = [], "\ue000"  # main blocks carry a private sign, taken off after reading
    for i, text in enumerate(texts):
        body = mark + html.escape(text)
        if rng.random() < 0.2:  # some words of it are a link
            first, _, rest = body.partition(" ")
            link, _, rest = rest.partition(" ")
            body = f'{first} <a href="/">{link}</a> {rest}'
        tag = "h1" if i == 0 else ("p", "p", "p", "p", "h2", "blockquote", "li", "div")[rng.integers(8)]
        inner.append(f"<{tag}>{body}</{tag}>")
        if rng.random() < 0.3:
            inner.append(_aside(rng, words))
    if rng.random() < 0.4:
        inner.append(_aside(rng, words))
    main = _wrap(container, "".join(inner))
    if rng.random() < 0.4:
        main = _wrap(("div class=wrapper", "div id=page", "div class=container", "section")[rng.integers(4)], main)
    before = "".join(_aside(rng, words) for _ in range(rng.integers(1, 4)))
    after = "".join(_aside(rng, words) for _ in range(rng.integers(1, 4)))
    page = f"<html><head><title>{html.escape(texts[0] if texts else '')}</title></head><body>{before}{main}{after}</body>"
    contexts, out = Contexts(), []
    for context, tag, text, linked in blocks(page, contexts):
        marked = text.startswith(mark)
        out.append(((*sorted(contexts.sets[context]), *text_marks(tag, text.lstrip(mark), linked)), int(marked)))
    return out


def train(pages: list[str], seed: int = 17) -> Chain:
    """Fit on the pages as they stand and in further layouts."""
    rng = np.random.default_rng(seed)
    data = []
    for page in pages or [""]:
        rows = labelled(page)
        texts = [t for _, main, t in rows if main] or [" ".join(PLAIN[:2]), *[" ".join(PLAIN)] * 3]
        if any(main for _, main, _ in rows):
            data.append([(marks, main) for marks, main, _ in rows])
        for _ in range(LAYOUTS if pages else 20 * LAYOUTS):
            some = texts[:1] + [texts[i] for i in sorted(rng.integers(len(texts), size=rng.integers(1, 12)))]
            data.append(laid_out(some, rng))
    return Chain().fit(data)


# ---------------------------------------------------------------- Spark

def fit(pages: DataFrame, page: str = "html", fit_pages: int = FIT_PAGES, fit_chars: int = FIT_CHARS) -> Chain:
    """Fit on a bounded sample of the pages, long or short, chosen by a hash of their html."""
    text = pages.select(text_of(page).alias("t")).where(F.length("t") > 0)
    hashed = text.withColumn("h", F.xxhash64("t"))
    chosen, left = [], fit_chars
    for r in hashed.select("h", F.length("t").alias("n")).distinct().orderBy("h", "n").limit(fit_pages).collect():
        left -= r["n"]
        if left < 0:
            break
        chosen.append(r["h"])
    rows = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    return train([r["t"] for r in rows])


def extract(pages: DataFrame, chain: Chain, page: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """Kept columns and ``text``, the main text of the whole page."""
    sent = Shared(pages.sparkSession, chain)

    def start():
        extractor = Extractor(sent.value)
        return lambda texts: [[extractor.extract(t) for t in texts]]
    names = kept(keep, ("text",))
    inner = pages.select(*[col(k) for k in names], text_of(page).alias("_page"))
    return map_texts(inner, "_page", names, "text string", start)
