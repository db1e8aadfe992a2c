"""Leaf blocks of a page: a forgiving reader of tags, in time linear in the page."""

from __future__ import annotations

import html
import re

from loanlab.llm.common import ship
from loanlab.llm.pretokens import Memo

ship(__name__)

# fixed values: elements by their role in HTML
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe legend li main menu
nav noframes object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead
title tr ul""".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"),
               "td": ("td", "th"), "th": ("td", "th")}
VOID_BLOCKS = frozenset(["hr"])
BREAKS = frozenset(["br", "wbr"])

# comments, raw elements (to the page's end if not closed), declarations, tags, and a tag cut off at the end
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|math)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def marks(tag: str, attributes: str) -> list[str]:
    """What an element adds to its blocks' ancestor features: its tag and the words of its names."""
    out = ["<" + tag]
    if attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            out += ["." + w.lower() for w in _PARTS.findall(a or b or c)]
    return out


class Contexts:
    """Sets of ancestor marks, as small numbers. ``known`` limits them to the marks that matter."""

    def __init__(self, known: frozenset | None = None):
        self.known, self.sets, self.numbers = known, [frozenset()], {frozenset(): 0}
        self.steps = Memo(self._step)

    def _step(self, key: str) -> int:
        parent, tag, attributes = key.split("\0", 2)
        new = marks(tag, attributes)
        grown = self.sets[int(parent)].union(new if self.known is None else [m for m in new if m in self.known])
        if grown not in self.numbers:
            self.numbers[grown] = len(self.sets)
            self.sets.append(grown)
        return self.numbers[grown]

    def step(self, parent: int, tag: str, attributes: str) -> int:
        return self.steps[f"{parent}\0{tag}\0{attributes}"]


def blocks(page: str, contexts: Contexts) -> list[tuple[int, str, str, int]]:
    """(context, innermost block tag, text, characters in links) of every leaf block with text, in page order."""
    out: list = []
    stack, open_tags = [("", 0)], {}
    texts: list[str] = []
    state = [0, False, 0]  # characters in links, in a link, where a link's text began

    def flush():
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append((stack[-1][1], stack[-1][0], text, state[0]))
            texts.clear()
            state[0] = 0

    def pop():
        tag, _ = stack.pop()
        open_tags[tag] -= 1

    at = 0
    for m in _MARKUP.finditer(page):
        start = m.start()
        if start > at:
            texts.append(page[at:start])
            if state[1]:
                state[0] += start - at
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BREAKS:
            texts.append(" ")
            continue
        closing = m[2] or m[5]
        if tag == "a":
            state[1] = not closing
            continue
        if tag not in BLOCK_TAGS:
            if tag in VOID_BLOCKS:
                flush()
            continue
        if m[6] and not page.endswith(">", 0, at):  # a tag that the page's end cuts off
            continue
        flush()
        state[1] = False
        if closing:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack[-1][0] == "p":
            pop()
        for other in SAME_CLOSES.get(tag, ()):
            if stack[-1][0] == other:
                pop()
        stack.append((tag, contexts.step(stack[-1][1], tag, m[4] or m[7] or "")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        texts.append(page[at:])
    flush()
    return out
