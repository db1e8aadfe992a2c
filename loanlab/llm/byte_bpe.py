"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the split pattern, and each is merged on its own. The
adjacent pairs of a pre-token wait in buckets, one per merge rank, that hold positions of a
linked list of parts. A bitmap marks the buckets in use and a second level marks its
non-zero words, so two find-first-set steps lead to the next rank whatever the length of
the pre-token. A merge changes the ranks of two pairs; their old
entries stay and are skipped when they come up. Very long pre-tokens take n log n time.

The vocabulary (token bytes and ranks) is read on the driver and broadcast: its size is
that of the file, which must not exceed ``MOST_RANKS`` entries.

Defined results: a null or empty text has no tokens and decodes to nothing; repeated rows
come out as they came in; an empty table gives no rows; other columns are ignored unless
kept, and a kept column with the name of a result column gives way to it. Decoding raises
on ids outside the vocabulary; a null id list decodes to empty bytes.
"""

from __future__ import annotations

import base64
import sys
from array import array
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import col, kept, map_texts, ship, worker_slot
from loanlab.llm.pretokens import MEMO_ENTRIES, Pieces

ship(__name__)

MOST_RANKS = 1_000_000
WORD = 8              # bitmap words of 256 bits: two levels hold 65,536 ranks in short words
LOW = (1 << WORD) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks")
    return ranks


class RankQueue:
    """Buckets of positions by rank, under two levels of bitmaps with words of 2^WORD bits.

    The top word marks the bitmap words in use. ``merge`` works on these fields directly, as
    the calls would cost more than the work; it leaves the queue empty.
    """

    def __init__(self, size: int):
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.words = [0] * ((size >> WORD) + 1)


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token: always the lowest rank next, its leftmost position first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, find, buckets, words, top = len(piece), ranks.get, queue.buckets, queue.words, 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [find(piece[i:i + 2], -1) for i in range(n)]  # rank of the pair that starts here; -1: none
    waiting[-1] = -1
    new = range(n - 1)
    while True:
        for i in new:  # push
            rank = waiting[i]
            if rank >= 0:
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    at = rank >> WORD
                    words[at] |= 1 << (rank & LOW)
                    top |= 1 << at
        while top:  # pop, until an entry is not an old one
            at = (top & -top).bit_length() - 1
            word = words[at]
            bit = word & -word
            rank = (at << WORD) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                words[at] = word = word ^ bit
                if not word:
                    top ^= 1 << at
            if waiting[i] == rank:
                break
        else:
            break
        gone = after[i]
        end = after[i] = after[gone]
        left = before[i]
        waiting[gone] = -1
        if end < n:
            before[end] = i
            waiting[i] = find(piece[i:after[end]], -1)
        else:
            waiting[i] = -1
        if left >= 0:
            waiting[left] = find(piece[left:end], -1)
            new = (left, i)
        else:
            new = (i,)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = MEMO_ENTRIES):
        queue = RankQueue(max(ranks.values()) + 1)
        self.pieces = Pieces(pattern, lambda token: self._pack(merge(token.encode(), ranks, queue)), b"", entries)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.tokens.__getitem__, ids))


def _encoder(shared, pattern: str, entries: int = MEMO_ENTRIES) -> Encoder:
    """The worker's encoder: made once, with its memos, for one broadcast vocabulary."""
    return worker_slot(("byte_bpe", shared.id, pattern, entries), lambda: Encoder(shared.value, pattern, entries))


class _Shared:
    """A broadcast with a name that is new for every vocabulary sent."""

    def __init__(self, spark, ranks):
        self.sent = spark.sparkContext.broadcast(ranks)
        self.id = f"{spark.sparkContext.applicationId}-{id(self.sent)}-{len(ranks)}-{hash(frozenset(ranks.items()))}"

    @property
    def value(self):
        return self.sent.value


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns and ``ids``: the token ids of the whole text, packed as little-endian unsigned 32-bit."""
    shared = _Shared(docs.sparkSession, ranks)

    def start():
        encoder = _encoder(shared, pattern)
        return lambda texts: [[encoder.encode(t) for t in texts]]
    return map_texts(docs, text, keep, "ids binary", start)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
                      keep: tuple = ("doc_id",), entries: int = MEMO_ENTRIES) -> DataFrame:
    """As ``encode``, with ``decoded``: the bytes that the ids stand for. One pass over the texts.

    ``entries``: words that a worker's memo holds in each of its two generations.
    """
    shared = _Shared(docs.sparkSession, ranks)

    def start():
        encoder = _encoder(shared, pattern, entries)

        def work(texts):
            ids = [encoder.encode(t) for t in texts]
            return [ids, [encoder.decode(i) for i in ids]]
        return work
    return map_texts(docs, text, keep, "ids binary, decoded binary", start)


def decode(rows: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids",
           keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns and ``decoded``: the bytes of packed ids."""
    shared = _Shared(rows.sparkSession, ranks)
    names = kept(keep, ("decoded",))
    hexed = rows.select(*[col(k) for k in names], F.hex(col(ids)).alias("_hex"))

    def start():
        encoder = _encoder(shared, pattern)
        return lambda texts: [[encoder.decode(bytes.fromhex(t)) for t in texts]]
    return map_texts(hexed, "_hex", names, "decoded binary", start)


def n_tokens(ids: str = "ids") -> F.Column:
    return (F.octet_length(col(ids)) / 4).cast("bigint")
