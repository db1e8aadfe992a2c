"""Removal of passages that occur before, by sliding runs of sentences.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at line
ends). Spans are: every run of ``sentences`` consecutive sentences, lengthened to the right
and, ending at the same place, to the left until it has ``least_words`` words; and every
shorter run of ``long_words`` words or more. So a passage of whole sentences is covered to
both ends whether its sentences are short or long. Spans compare by their words, A-Z
lower-cased, through 96-bit hashes, over all documents.

Of every span that occurs again, the occurrence in the smallest id (then the smallest text
hash, then the earliest sentence) is the first. Sentences covered by any other occurrence
are removed, with the white space that follows them.

Hashes that occur once are dropped by a grouped count of their first 64 bits, so only
repeated spans are held with their places. Counts and firsts are pre-aggregated; places
meet them in plain equality joins that adaptive execution may split, as neither side comes
from a grouping on the key.

Defined results: null texts count as empty and come out empty; rows equal in id and text are
one document and lose nothing to each other; a null id comes after all others; a document
may become empty but its row stays; an empty table gives no rows; all columns are passed
through, except that ``n_sentences`` and ``n_removed`` replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.llm.common import ROWS_AT_ONCE, batch_of, col, flat_map_texts, fresh, kept, map_arrow, ship, text_of
from loanlab.session import durable

ship(__name__)

SENTENCES = 3
LEAST_WORDS = 20
LONG_WORDS = 40
# white space after a sentence end, or white space with a line end in it; never at the text's start
_CUT = re.compile(r"((?<=[.!?])[ \t\n\r\f\v]+|(?<=[^ \t\n\r\f\v])[ \t\r\f\v]*\n[ \t\n\r\f\v]*)")


def cut(text: str) -> list[str]:
    """The sentences with the white space that follows them; joined, they are the text again."""
    parts = _CUT.split(text)
    parts.append("")
    return [a + b for a, b in zip(parts[::2], parts[1::2]) if a or b]


def spans(counts: list[int], sentences: int, least: int, long: int) -> list[tuple[int, int]]:
    """(first, end) of every span, given the words of each sentence."""
    n, sums = len(counts), [0, *accumulate(counts)]
    out = set()
    for i in range(n):
        end = i + sentences
        for j in range(i + 1, min(end, n + 1)):  # shorter runs with many words
            if sums[j] - sums[i] >= long:
                out.add((i, j))
        if end <= n:
            if sums[end] - sums[i] >= least:
                out.add((i, end))
                continue
            j = end
            while j < n and sums[j] - sums[i] < least:
                j += 1
            if sums[j] - sums[i] >= least:
                out.add((i, j))
            j = i
            while j > 0 and sums[end] - sums[j] < least:
                j -= 1
            if sums[end] - sums[j] >= least:
                out.add((j, end))
    return sorted(out)


def _spans_of(sentences: int, least: int, long: int):
    digest = xxhash.xxh3_128_digest

    def work(texts):
        rows, numbers, hashes = [], [], []
        for r, text in enumerate(texts):
            words = [s.encode().lower().split() for s in cut(text)]
            found = spans([len(w) for w in words], sentences, least, long)
            lines = [b" ".join(w) for w in words]
            rows += [r] * len(found)
            numbers += range(len(found))
            hashes += [digest(b" ".join(lines[i:j])) for i, j in found]
        pairs = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        # the span's number in its document above 32 bits of the hash: a short row to shuffle
        return rows, [pairs[:, 0], np.array(numbers, np.int64) << 32 | pairs[:, 1] & 0xFFFFFFFF]
    return lambda: work


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: int = SENTENCES,
             least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, hash, number): every non-first occurrence of a repeated span.

    ``hash`` is that of the text, ``number`` the span's place in the text's list of ``spans``.
    """
    ready = docs.select(col(id_col).alias("id"), text_of(text).alias("t"), F.xxhash64(text_of(text)).alias("hash"))
    found = flat_map_texts(ready, "t", ("id", "hash"), "h1 bigint, span bigint",
                           _spans_of(sentences, least_words, long_words))
    counts = durable(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"))
    again = durable(found.join(counts, "h1", "left_semi"))
    again = again.select("h1", F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h2"), F.struct(
        F.col("id").isNull().alias("late"), "id", "hash", F.shiftright("span", 32).alias("number")).alias("place"))
    firsts = durable(again.groupBy("h1", "h2").agg(F.min("place").alias("p"), F.max("place").alias("q"))
                     .where("p <> q").select("h1", "h2", "p"))
    return again.join(firsts, ["h1", "h2"]).where("place <> p").select("place.id", "place.hash", "place.number")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: int = SENTENCES,
                    least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """All columns, the text without repeated spans, and ``n_sentences`` and ``n_removed``."""
    found = repeated(docs, id_col, text, sentences, least_words, long_words)
    # at most a document's own spans come together here
    lists = durable(found.groupBy("id", "hash").agg(F.collect_set("number").alias("codes")))

    names = kept(docs.columns, ("n_sentences", "n_removed"))
    codes, own = fresh(docs, "_codes", "_hash")
    marked = _attach(docs.select(*[col(c) for c in names]), lists, id_col, text, own, codes)
    at = names.index(text)
    fields = [T.StructField(text, T.StringType()) if c == text else marked.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("n_sentences", T.IntegerType()),
                           T.StructField("n_removed", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts, totals, removed = [], [], []
                for whole, taken in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    pieces = cut(whole)
                    gone = set()
                    if taken:
                        own = spans([len(s.encode().split()) for s in pieces], sentences, least_words, long_words)
                        gone.update(i for number in taken for i in range(*own[number]))
                    texts.append("".join([s for i, s in enumerate(pieces) if i not in gone]).rstrip()
                                 if gone else whole)
                    totals.append(len(pieces))
                    removed.append(len(gone))
                arrays = [part.column(i) for i in range(len(names))]
                arrays[at] = pa.array(texts, type=pa.string())
                arrays += [pa.array(totals, type=pa.int32()), pa.array(removed, type=pa.int32())]
                yield batch_of(arrays)

    return map_arrow(marked, run, schema)


def _attach(docs: DataFrame, lists: DataFrame, id_col: str, text: str, own: str, codes: str) -> DataFrame:
    """Documents (nulls as empty text) with the codes of their spans, or null."""
    left = docs.withColumn(text, text_of(text)).withColumn(own, F.xxhash64(text_of(text)))
    right = lists.select(F.col("id").alias(f"{own}id"), F.col("hash").alias(f"{own}hash"), F.col("codes").alias(codes))
    on = col(id_col).eqNullSafe(col(f"{own}id")) & (col(own) == col(f"{own}hash"))
    return left.join(right, on, "left").select(*[col(c) for c in docs.columns], codes)
