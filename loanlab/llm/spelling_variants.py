"""Spelling variants by blocked Gram matrices of letter counts.

Words are maximal runs of Latin letters, lower-cased in A-Z only. Two words are near if one
inserted, deleted or replaced letter turns one into the other. Such words have letter counts
whose squared distance is at most two, and all distances of two blocks of words come from one
matrix product. A block holds the words of one length with the same number of letters in each
of ``GROUPS`` letter groups. One edit moves at most one letter out of a group and one into
another, so near words lie in the same block or in two blocks next to each other, of equal
or adjacent length; no other blocks are compared. Pairs at most two apart are verified letter by
letter. Blocks of more than ``SLICE`` words are cut into slices, and pairs of slices are separate
rows, so no group is held whole by a task. Nothing is capped: every word meets every slice that
can hold a near word.

A word's form is its most frequent near word (ties: first in code-point order) if that is at
least ``ratio`` times as frequent; its root is where the forms lead. Frequencies at least
double on the way for the usual ratio, so doubling the steps ends after a few joins.

Counts are summed inside the tasks before the shuffle, in a table of at most ``TABLE`` words at
a time. Words that are too short leave before it.

Defined results: a null or empty text has no words; repeated rows count as often as they stand
there; in a row with a null id no letter is dropped; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.llm.common import batch_of, col, map_arrow, ship, text_of
from loanlab.session import durable

ship(__name__)

GROUPS = 8        # letter groups of a block's key
SLICE = 512       # words of a block that are compared at a time, about
FOLDED = 32       # letter counts kept: a-z alone, accented letters in six bins
TABLE = 200_000   # words counted in a task before the counts are handed on
_ROWS = 20_000    # result rows handed on at a time


def _letters() -> bytes:
    """Latin-1 byte to itself where it is a letter, A-Z to lower case, others to a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _folding() -> np.ndarray:
    """Latin-1 byte to one of the ``FOLDED`` letter bins."""
    return np.array([c - 97 if 97 <= c <= 122 else 26 + c % (FOLDED - 26) for c in range(256)])


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, drop_every: int = 0, shortest: int = 5, text: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """``word`` and ``n``, its occurrences over all texts, of words with ``shortest`` letters or more.

    With ``drop_every``, the crc32 h of ``<id>:<word>`` decides whether a word of this document
    loses a letter: if ``drop_every`` divides h, letter h modulo the length goes.
    """
    table = _letters()
    schema = T.StructType.fromDDL("word string, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return batch_of([words, pa.array(held.values(), pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                name, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                # one byte per code point; whatever is no Latin letter parts words
                words = Counter(text.encode("latin-1", "replace").translate(table).split())
                if drop_every and name is not None:
                    prefix, crc32 = zlib.crc32(f"{name}:".encode()), zlib.crc32
                    for word, n in words.items():
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= shortest:
                            held[word] += n
                else:
                    for word, n in words.items():
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= TABLE:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    rows = map_arrow(docs.select(col(id_col).cast("string"), text_of(text)), run, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- blocks

def _key(words: DataFrame) -> DataFrame:
    """``word``, ``n`` and ``key``: one byte per letter group, the letters that the word has of it.

    Counts over 255 stand as 255: an edit among them keeps the key, so near words still meet.
    """
    schema = T.StructType.fromDDL("word string, n bigint, key binary")

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(w.encode("latin-1"), np.uint8) for w in batch.column(0).to_pylist()]
            rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            flat = _folding()[np.concatenate(codes)] % GROUPS if codes else rows
            counts = np.bincount(rows * GROUPS + flat, minlength=len(codes) * GROUPS)
            counts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, GROUPS)
            yield batch_of([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in counts], pa.binary())])
    return map_arrow(words.select("word", "n"), run, schema)


def _neighbours(key: bytes) -> list[bytes]:
    """The keys that one edit can reach, each unordered pair of keys from one side only, itself first."""
    out = [key]
    for i in range(GROUPS):
        if key[i] < 255:
            more = key[:i] + bytes([key[i] + 1]) + key[i + 1:]
            out.append(more)  # one letter more
            # one letter replaced, into an earlier group
            out += [more[:j] + bytes([more[j] - 1]) + more[j + 1:] for j in range(i + 1, GROUPS) if more[j]]
    return out


def _next_keys(keys: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL("key binary, other binary")

    def run(batches):
        for batch in batches:
            pairs = [(k, o) for k in batch.column(0).to_pylist() for o in _neighbours(k)]
            yield batch_of([pa.array([k for k, _ in pairs], pa.binary()), pa.array([o for _, o in pairs], pa.binary())])
    return map_arrow(keys.select("key"), run, schema)


def _packed(slices: DataFrame) -> DataFrame:
    """(key, slice, codes, ns): a slice's words as rows of Latin-1 codes, padded, and their counts."""
    schema = T.StructType.fromDDL("key binary, slice int, width int, codes binary, ns binary")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(2)[i].as_py()
                words = [r["word"].encode("latin-1") for r in rows]
                width = max(map(len, words))
                codes = b"".join(w.ljust(width, b" ") for w in words)
                ns = np.array([r["n"] for r in rows], np.int64).tobytes()
                yield batch_of([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([width], pa.int32()),
                                pa.array([codes], pa.binary()), pa.array([ns], pa.binary())])
    return map_arrow(slices, run, schema)


# ---------------------------------------------------------------- pairs

def _vectors(codes: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Letter counts of the rows of codes, as float32: sums are exact below 2^24."""
    rows, places = np.nonzero(codes != 32)
    flat = rows * FOLDED + fold[codes[rows, places]]
    return np.bincount(flat, minlength=len(codes) * FOLDED).reshape(-1, FOLDED).astype(np.float32)


def near_pairs(a: np.ndarray, b: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) that are one edit apart; codes are padded with spaces at the end."""
    x, y = _vectors(a, fold), _vectors(b, fold)
    # squared distances |x|^2 - 2 xy + |y|^2 as one product
    left = np.hstack([x, (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)])
    right = np.hstack([-2 * y, np.ones((len(y), 1), np.float32), (y * y).sum(1, keepdims=True)])
    i, j = np.divmod(np.flatnonzero((left @ right.T) <= 2.5), len(y))
    if not i.size:
        return i, j
    width = max(a.shape[1], b.shape[1])
    a = np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=32)
    b = np.pad(b, ((0, 0), (0, width - b.shape[1])), constant_values=32)
    size_a, size_b = (a != 32).sum(1), (b != 32).sum(1)
    good = []
    for at in range(0, len(i), 1 << 16):
        good.append(_one_edit(a, b, size_a, size_b, i[at:at + (1 << 16)], j[at:at + (1 << 16)]))
    good = np.concatenate(good)
    return i[good], j[good]


def _one_edit(a, b, size_a, size_b, i, j) -> np.ndarray:
    """Whether row i of a and row j of b are exactly one edit apart."""
    p, q, m, n = a[i], b[j], size_a[i], size_b[j]
    same = p == q
    replaced = (m == n) & ((~same).sum(1) == 1)
    longer = np.where((m > n)[:, None], p, q)
    shorter = np.where((m > n)[:, None], q, p)
    # as far as both agree from the front, then all but one letter of the longer from there on
    front = np.cumprod(same, axis=1).astype(bool)
    back = np.ones_like(front)
    back[:, :-1] = shorter[:, :-1] == longer[:, 1:]
    added = (abs(m - n) == 1) & (front | back).all(1)
    return replaced | added


def _compare(pairs: DataFrame) -> DataFrame:
    """(word, n_near, n, form) of each side of each pair of slices: near words there, and the best of them."""
    schema = T.StructType.fromDDL("word string, n_near bigint, form_n bigint, form string")

    def run(batches):
        fold, held, size = _folding(), [], 0
        for batch in batches:
            same, wa, ca, na, wb, cb, nb = (batch.column(i) for i in range(7))
            for r in range(batch.num_rows):
                a = np.frombuffer(ca[r].as_py(), np.uint8).reshape(-1, wa[r].as_py())
                b = np.frombuffer(cb[r].as_py(), np.uint8).reshape(-1, wb[r].as_py())
                n_a, n_b = np.frombuffer(na[r].as_py(), np.int64), np.frombuffer(nb[r].as_py(), np.int64)
                i, j = near_pairs(a, b, fold)
                if not i.size:
                    continue
                sides = [(a, i, b, j, n_b)] if same[r].as_py() else [(a, i, b, j, n_b), (b, j, a, i, n_a)]
                for own, u, other, v, n_other in sides:
                    names = other.view(f"S{other.shape[1]}").ravel()
                    order = np.lexsort((names[v], -n_other[v], u))  # best near word of each word first
                    u, v = u[order], v[order]
                    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                    count = np.diff(np.append(first, len(u)))
                    held.append((_texts(own[u[first]]), count, n_other[v[first]], _texts(other[v[first]])))
                    size += len(first)
                if size >= _ROWS:
                    yield _rows_of(held)
                    held, size = [], 0
        if held:
            yield _rows_of(held)
    return map_arrow(pairs, run, schema)


def _texts(codes: np.ndarray) -> list[str]:
    width, text = codes.shape[1], codes.tobytes().decode("latin-1")
    return [text[k:k + width].rstrip(" ") for k in range(0, len(text), width)]


def _rows_of(held: list) -> pa.RecordBatch:
    words, counts, ns, forms = zip(*held)
    return batch_of([pa.array([w for part in words for w in part], pa.string()), pa.array(np.concatenate(counts), pa.int64()),
                     pa.array(np.concatenate(ns), pa.int64()), pa.array([w for part in forms for w in part], pa.string())])


def near_words(words: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """``word``, ``n_near``, ``form_n``, ``form``: near words of each word that has any, and the best of them.

    ``words`` has each ``word`` once, with its count ``n``; letters are those of ``word_counts``.
    """
    keyed = durable(_key(words))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("slices"))
    sizes = durable(sizes)
    cut = keyed.join(sizes, "key").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    slices = durable(_packed(cut.groupBy("key", "slice").agg(
        F.collect_list(F.struct("word", "n")).alias("rows"))))
    meet = _next_keys(sizes).join(sizes.withColumnsRenamed({"key": "other", "slices": "others"}), "other").join(sizes, "key")
    meet = meet.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    self_pair = F.col("key") == F.col("other")
    meet = meet.withColumn("oslice", F.explode(F.sequence(F.when(self_pair, F.col("slice")).otherwise(0), F.col("others") - 1)))
    other = slices.select(F.col("key").alias("other"), F.col("slice").alias("oslice"), F.col("width").alias("owidth"),
                          F.col("codes").alias("ocodes"), F.col("ns").alias("ons"))
    pairs = meet.join(slices, ["key", "slice"]).join(other, ["other", "oslice"]).select(
        (self_pair & (F.col("slice") == F.col("oslice"))).alias("same"), "width", "codes", "ns", "owidth", "ocodes", "ons")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = _compare(pairs).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``words`` (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must not lead in a circle")
    words = durable(words.select("word", "n"))
    joined = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    all_rows = durable(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                     F.when(good, F.col("form")).alias("form"),
                                     F.when(good, F.col("form_n")).alias("form_n")))
    steps = all_rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        steps = durable(steps)
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root", "left")
        if moved.where("next IS NOT NULL").limit(1).count() == 0:
            break
        steps = moved.select("word", F.coalesce("next", "root").alias("root"))
    return all_rows.join(steps, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
