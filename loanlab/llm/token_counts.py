"""Token counts of whole texts, with a shortcut for pre-tokens that are one token.

Offline, on the driver, every vocabulary string is put through the merges alone; those that
come out as themselves are proven whole tokens. A pre-token among them counts as one without
any merging, and only the rest is merged (by a heap of pair ranks over a linked list, so
very long pre-tokens take n log n time). Counts of recurring pieces are kept in bounded memos.

The vocabulary file is a byte-level BPE model in JSON: merges, vocabulary, added tokens. Its
special strings inside a text count as one token each, as its library does by default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows come out as
they came in; an empty table gives no rows; other columns are ignored unless kept, and a kept
column with the name of a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import Shared, col, kept, map_texts, ship, text_of, worker_slot
from loanlab.llm.pretokens import Pieces

ship(__name__)

MOST_MERGES = 1_000_000  # bounds the broadcast model


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: printable bytes stand
    for themselves, the others follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merged(signs: str, merges: dict[tuple[str, str], int]) -> list[str]:
    """The parts left after all merges, lowest rank first and leftmost among equals."""
    n = len(signs)
    parts, after, before = list(signs), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if j >= n or not parts[i] or merges.get((parts[i], parts[j])) != rank:
            continue  # an old entry
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            rank = merges.get((parts[i], parts[after[i]]))
            if rank is not None:
                heappush(heap, (rank, i))
        left = before[i]
        if left >= 0:
            rank = merges.get((parts[left], parts[i]))
            if rank is not None:
                heappush(heap, (rank, left))
    return [p for p in parts if p]


class Model:
    """What counting needs of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            content = f.read()
        spec, self.digest = json.loads(content), hashlib.sha256(content).hexdigest()
        model, steps = spec["model"], spec.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or spec.get("normalizer") or steps.get("type") != "ByteLevel"
                or steps.get("add_prefix_space") or not steps.get("use_regex", True) or model.get("ignore_merges")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
            raise ValueError("only plain byte-level BPE models are counted")
        if len(model["merges"]) > MOST_MERGES:
            raise ValueError(f"more than {MOST_MERGES} merges")
        self.merges = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i
                       for i, m in enumerate(model["merges"])}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.whole = self._proven(model["vocab"])

    def _proven(self, vocabulary) -> set[str]:
        """Pre-token texts that encode as one token, each put to the proof."""
        byte_of = {s: b for b, s in enumerate(byte_signs())}
        out = set()
        for token in vocabulary:
            if all(s in byte_of for s in token) and merged(token, self.merges) == [token]:
                try:
                    out.add(bytes(byte_of[s] for s in token).decode())
                except UnicodeDecodeError:
                    continue  # part of a character: never a pre-token
        return out


class Counter:
    def __init__(self, model: Model, pattern: str):
        signs = byte_signs()
        whole, merges = model.whole, model.merges

        def one(token: str) -> int:
            return 1 if token in whole else len(merged("".join([signs[b] for b in token.encode()]), merges))
        self.pieces = Pieces(pattern, one, 0)
        added = sorted(filter(None, model.added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return sum(self.pieces(text))
        sections = self.added.split(text)
        return len(sections) - 1 + sum([sum(self.pieces(s)) for s in sections if s])


def _counter(shared, name: str, pattern: str) -> Counter:
    return worker_slot(("token_counts", name, pattern), lambda: Counter(shared.value, pattern))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, text: str = "text",
                 keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than the limit)."""
    spark = docs.sparkSession
    model = Model(path)
    shared, name = Shared(spark, model), model.digest  # a changed file is another model
    names = kept(keep, ("n_bytes", "n_tokens", "over_limit"))
    inner = docs.select(*[col(k) for k in names], text_of(text).alias("_t"),
                        F.octet_length(text_of(text)).cast("bigint").alias("n_bytes"))

    def start():
        counter = _counter(shared, name, pattern)
        return lambda texts: [[counter.count(t) for t in texts]]
    return map_texts(inner, "_t", (*names, "n_bytes"), "n_tokens bigint", start).withColumn(
        "over_limit", F.col("n_tokens") > limit)
