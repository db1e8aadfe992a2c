"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q that has at least ``times``
periods and ``least`` words and that no neighbouring word extends. Words are appended one by
one to the suffix automaton of the text so far. Its suffix-link tree is held as a link-cut
tree: every preferred path has one colour, the place where its strings last ended. Access to
an appended word's state walks the coloured segments up to the root and recolours them. A
segment of colour e whose deepest state has length s says that the last s words end both
here and at e, and no later. With d the distance and s >= (times - 1) * d these are squares of
period d, and since s is exact they reach s + d words back; the run is whole where the next
word breaks the period. With three periods or more d is the smallest period, and no run is
missed: a later end of the same words would give them a smaller period.

A word of a run stands in it ``times`` times at least. So words that are rarer in a stretch
cannot belong to a run there; they split the stretch, until nothing splits any more. Only
what is left goes through the automaton: most texts never reach it.

Memory follows the longest text: one state and one link-cut node per word, two at most.

Defined results: a null or empty text has no words and no runs, its collapsed text is empty;
repeated rows come out as they came in; an empty table gives no rows; other columns are
ignored unless kept, and a kept column with the name of a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from loanlab.llm.common import map_texts, ship

ship(__name__)


class PathTree:
    """The suffix-link tree as a link-cut tree. Node 0 is none; ``colour`` counts at splay roots."""

    def __init__(self):
        self.up, self.left, self.right, self.colour = [0], [0], [0], [-1]

    def add(self, up: int) -> int:
        """A new node under ``up``, alone on its path."""
        self.up.append(up)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(-1)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        """Makes x the root of its path's splay tree; the path's colour goes with it."""
        up, left, right = self.up, self.left, self.right
        p = top = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                top = g
                order = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            else:
                top = p
                order = (x,)
            for y in order:  # rotate y over its parent
                q = up[y]
                h = up[q]
                if left[q] == y:
                    b = right[y]
                    left[q], right[y] = b, q
                else:
                    b = left[y]
                    right[q], left[y] = b, q
                if b:
                    up[b] = q
                up[q], up[y] = y, h
                if h:
                    if left[h] == q:
                        left[h] = y
                    elif right[h] == q:
                        right[h] = y
            p = up[x]
        self.colour[x] = self.colour[top]

    def put_above(self, x: int) -> int:
        """A new node between x and its parent, on the path of x."""
        self.splay(x)
        new = self.add(x)
        above = self.left[x]
        self.left[new] = above
        if above:
            self.up[above] = new
        self.left[x] = new
        return new

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolours the path from x to the root; (colour, deepest node) of the segments it had."""
        up, right, colours, seen, below = self.up, self.right, self.colour, [], 0
        while x:
            self.splay(x)
            old, cut = colours[x], right[x]
            if cut:
                colours[cut] = old  # the part below keeps its colour
            right[x] = below
            if old >= 0:
                seen.append((old, x))
            below, x = x, up[x]
        colours[below] = colour
        return seen


def runs_of(words: list[int], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in no certain order."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found")
    tree = PathTree()
    root = last = tree.add(0)
    go, length, link = [{}, {}], [0, 0], [0, 0]
    found, end = [], len(words) - 1
    for i, word in enumerate(words):
        at, parent, last = last, root, tree.add(0)
        go.append({})
        length.append(i + 1)
        link.append(0)
        while at and word not in go[at]:
            go[at][word] = last
            at = link[at]
        if at:
            parent = go[at][word]
            if length[parent] != length[at] + 1:  # split off the strings that end here too
                whole, parent = parent, tree.put_above(parent)
                go.append(dict(go[whole]))
                length.append(length[at] + 1)
                link.append(link[whole])
                link[whole] = parent
                while at and go[at].get(word) == whole:
                    go[at][word] = parent
                    at = link[at]
        link[last] = tree.up[last] = parent
        for e, state in tree.access(last, i):
            same, gap = length[state], i - e
            if (same >= (times - 1) * gap and same + gap >= least
                    and (i == end or words[i + 1] != words[i + 1 - gap])):
                found.append((i + 1 - same - gap, same + gap, gap))
    return found


def stretches(ids: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the parts in which every word stands ``times`` times or more."""
    waiting = [(0, len(ids))]
    while waiting:
        a, b = waiting.pop()
        if b - a < max(times, least):
            continue
        part = ids[a:b]
        if a or b < len(ids):
            part = np.unique(part, return_inverse=True)[1]
        often = np.bincount(part)[part] >= times
        if often.all():
            yield a, b
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                waiting.append((a + s, a + e))


def word_runs(words: list, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    place = dict.fromkeys(words)
    place = dict(zip(place, range(len(place))))
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    found = []
    for a, b in stretches(ids, times, least):
        found += [(a + s, n, q) for s, n, q in runs_of(ids[a:b].tolist(), times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), times: int = 4,
                  least: int = 6) -> DataFrame:
    """Kept columns, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``
    (the words that no run repeats, joined by one space). Words end at ASCII white space."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found")

    def one(text: str) -> tuple:
        words = text.encode().split()
        runs = word_runs(words, times, least)
        rows = [{"start": s, "length": n, "period": q} for s, n, q in runs]
        return len(words), rows, b" ".join(collapsed(words, runs)).decode()

    def start():
        return lambda texts: list(zip(*map(one, texts))) if texts else [[], [], []]
    return map_texts(docs, text, keep, "n_words bigint, runs array<struct<start: bigint, length: bigint, "
                     "period: bigint>>, collapsed string", start)
