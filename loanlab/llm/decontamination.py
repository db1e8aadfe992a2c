"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of word characters. Seeds are windows of ``least`` words: those of
the benchmark are indexed by their Karp-Rabin hash, and the windows of each document are
joined with them. For every (document, item) pair with a common seed, the longest common
unmarked word runs are found by running Karp-Rabin at falling lengths and marked as tiles,
longest first, until none of ``least`` words is left. Tiles never overlap, so their total
length over the item's length is the share of the item that the document holds, in whatever
order its passages stand. Only the stretches of a document that lie in common seeds enter the
tiling; no tile can lie elsewhere.

The benchmark is a stated query set. It goes out in blocks of at most ``BLOCK_WORDS`` words,
whose index is broadcast; a larger benchmark takes one pass over the documents per block, whose
result is stored before the next index goes out, so one index at a time is held. Documents are
never shuffled.

Defined results: null texts count as empty and hold nothing; an item of fewer words than
``least`` is one seed of all its words, one without words is never found; equal benchmark rows count once, items may share an id or have a
null id and are then reported under it; repeated documents are reported as often as they
occur; empty tables give no rows; other columns are ignored unless kept, and a kept column
with the name of a result column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import Shared, col, fresh, kept, map_texts, ship, text_of
from loanlab.session import durable

ship(__name__)

LEAST = 5              # words of the shortest tile
SHARE = 0.5            # share of an item's words that makes a document contaminated
BLOCK_WORDS = 1_000_000  # about 100 MB of index
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: Karp-Rabin base modulo 2^64
_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` ids."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out *= _BASE
        out += ids[k:k + len(out)]
    return out


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], least: int):
        self.least, self.vocabulary = least, {}
        self.names, self.items, hashes, places = [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            size = min(least, len(ids))  # an item with fewer words is one seed
            found = windows(np.array(ids, np.uint64), size)
            hashes.append((size, found))
            places.append(np.full(len(found), len(self.items), np.int64))
            self.names.append(name)
            self.items.append(ids)
        self.tables = {}  # seed size to (sorted hashes, their items)
        for size in sorted({s for s, _ in hashes}):
            mine = np.concatenate([h for s, h in hashes if s == size])
            owner = np.concatenate([p for (s, _), p in zip(hashes, places) if s == size])
            order = np.argsort(mine, kind="stable")
            self.tables[size] = mine[order], owner[order]

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position in the document) of all common seeds."""
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        found = [self._seeds(ids, known, size, *table) for size, table in self.tables.items() if len(ids) >= size]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _seeds(self, ids, known, size: int, hashes, owner) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(known[size:] == known[:-size])
        mine = windows(ids, size)[at]
        low, high = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return owner[np.repeat(low, n) + within], np.repeat(at, n)

    def overlaps(self, text: str) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) for every item with a tile; a tile is (place in text, place in item, words)."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        owners, at = self.seeds(ids)
        out = []
        for item in np.unique(owners):
            cover = np.zeros(len(ids) + 1, np.int64)  # the stretches that lie in seeds of this item
            starts = np.unique(at[owners == item])
            size = min(self.least, len(self.items[item]))
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            inside = np.flatnonzero(np.cumsum(cover)[:-1])
            doc, places, last = [], [], None
            for p in inside.tolist():
                if last is not None and p != last + 1:
                    doc.append(0)
                    places.append(-1)
                doc.append(int(ids[p]))
                places.append(p)
                last = p
            tiles = tile(doc, self.items[item], size)
            if tiles:
                out.append((int(item), [(places[d], i, n) for d, i, n in tiles]))
        return out


def _scan(doc: list[int], item: list[int], free_doc: list[bool], free_item: list[bool], size: int) -> list[tuple]:
    """All maximal common unmarked runs of at least ``size`` words, as (-length, item place, doc place)."""
    at: dict[int, list[int]] = {}
    for i, h in _rolling(item, free_item, size):
        at.setdefault(h, []).append(i)
    out = []
    for d, h in _rolling(doc, free_doc, size):
        for i in at.get(h, ()):
            if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                continue  # inside a run that began before
            n = 0
            while (d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n]
                   and doc[d + n] == item[i + n]):
                n += 1
            if n >= size:  # else the hashes agree by chance
                out.append((-n, i, d))
    return out


def _rolling(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of every window without marked or foreign words."""
    base, prime = 1_000_003, (1 << 61) - 1
    lead = pow(base, size, prime)
    run = value = 0
    for k, word in enumerate(ids):
        if not word or not free[k]:
            run = value = 0
            continue
        value = (value * base + word) % prime
        run += 1
        if run > size:
            value = (value - ids[k - size] * lead) % prime
        if run >= size:
            yield k - size + 1, value


def _unmarked(a: list[bool], b: list[bool]) -> list[tuple[int, int]]:
    """(start, length) of the stretches that are free on both sides."""
    out, start = [], None
    for k, free in enumerate([*map(all, zip(a, b)), False]):
        if free and start is None:
            start = k
        elif not free and start is not None:
            out.append((start, k - start))
            start = None
    return out


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc place, item place, words): the longest first, then the earliest in the item."""
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    tiles, size = [], max(least, min(len(doc), len(item)))
    while True:
        waiting = _scan(doc, item, free_doc, free_item, size)
        heapify(waiting)
        while waiting:
            n, i, d = heappop(waiting)
            left = _unmarked(free_doc[d:d - n], free_item[i:i - n])
            if left == [(0, -n)]:
                free_doc[d:d - n] = free_item[i:i - n] = [False] * -n
                tiles.append((d, i, -n))
            else:  # longer tiles took a part; what they left waits again
                for start, words in left:
                    if words >= size:
                        heappush(waiting, (-words, i + start, d + start))
        if size <= least:
            return tiles
        size = max(least, size // 2)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[tuple[list, bool]]:
    """(items, whether another block follows)."""
    held = None
    for rows in _cut(benchmark, item_id, text, block_words):
        if held is not None:
            yield held, True
        held = rows
    if held is not None:
        yield held, False


def _cut(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list]:
    rows, words = [], 0
    for row in benchmark.select(col(item_id).alias("i"), text_of(text).alias("t")).distinct().toLocalIterator():
        rows.append((row["i"], row["t"]))
        words += len(words_of(row["t"]))
        if words >= block_words:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple = ("doc_id",),
             item_id: str = "item_id", item_text: str = "text", least: int = LEAST,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """Kept columns, ``item_id``, ``coverage`` (share of the item's words) and ``tiles``, for every pair with a tile."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    names = kept(keep, ("item_id", "coverage", "tiles"))
    made = f"_hits array<struct<item:{kind},coverage:double,tiles:array<struct<at:int,item_at:int,words:int>>>>"
    out, several = None, False
    for block, more in _blocks(benchmark, item_id, item_text, block_words):
        index, several = Shared(spark, Index(block, least)), several or more

        def start(index=index):
            known = index.value

            def work(texts):
                return [[[{"item": known.names[i], "coverage": sum(n for _, _, n in tiles) / len(known.items[i]),
                           "tiles": [{"at": a, "item_at": b, "words": n} for a, b, n in tiles]}
                          for i, tiles in known.overlaps(t)] for t in texts]]
            return work
        hits = map_texts(docs, text, names, made, start).select(*[col(k) for k in names], F.explode("_hits").alias("_h"))
        part = hits.select(*[col(k) for k in names], F.col("_h.item").alias("item_id"), "_h.coverage", "_h.tiles")
        if several:  # stored, so that one index at a time is held
            part = durable(part)
            index.sent.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = docs.limit(0).select(*[col(k) for k in names], F.lit(None).cast(kind).alias("item_id"))
        out = empty.selectExpr("*", "cast(null as double) coverage",
                               "cast(null as array<struct<at:int,item_at:int,words:int>>) tiles")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, **options) -> DataFrame:
    """The pairs of ``overlaps`` that hold at least ``share`` of an item's words."""
    return overlaps(docs, benchmark, **options).where(F.col("coverage") >= share)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", least: int = LEAST, share: float = SHARE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all columns, that hold less than ``share`` of every item."""
    spark, out = docs.sparkSession, docs
    several = False
    for block, more in _blocks(benchmark, item_id, item_text, block_words):
        index, several = Shared(spark, Index(block, least)), several or more
        mark, = fresh(docs, "_leak")

        def start(index=index):
            known = index.value
            return lambda texts: [[any(sum(n for _, _, n in tiles) >= share * len(known.items[i])
                                       for i, tiles in known.overlaps(t)) for t in texts]]
        whole, = fresh(out, "_whole")
        out = (map_texts(out.withColumn(whole, col(text)), whole, docs.columns, f"`{mark}` boolean", start)
               .where(~col(mark)).select(*[col(c) for c in docs.columns]))
        if several:
            out = durable(out)
            index.sent.unpersist()
    return out
