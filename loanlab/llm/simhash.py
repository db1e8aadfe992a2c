"""Near duplicates by SimHash fingerprints, linked through deletion-variant signatures.

A fingerprint of 64 bits sums up the shingles of a whole text. Two fingerprints that differ
in at most ``distance`` bits are cut into ``distance // 2 + 1`` segments; one segment then
differs in at most one bit. Every fingerprint is indexed under each segment as it is and
under each segment with one bit wildcarded. Fingerprints that share such a key meet in an
equality join, and the bit count of their difference decides. A pair is taken at the exact
key, or at the key whose wildcard bit is the one that differs, so it comes once per segment.

Only distinct fingerprints are indexed: copies of a text are folded first. Keys held by one
fingerprint alone are dropped before the join. A key held by more than ``BUCKET``
fingerprints is cut again by variants of the remaining bits, and loses no pair: below it at
most 2^18 different fingerprints can be left at the usual distance of 3.

Defined results: a null text counts as empty; a text without words has fingerprint zero,
which links like any other; repeated rows come out as often as they came in; rows with a
null id get the smallest id of their component (null if it has none); an empty table gives
no rows; other columns are ignored unless kept.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.llm.common import col, fresh, map_texts, ship, text_of
from loanlab.llm.components import components
from loanlab.session import durable

ship(__name__)

BUCKET = 4_096   # fingerprints under one key that are compared directly
SPREAD = 8_192   # fingerprints per task when signatures are made
_SEED = 42
_CHUNK = 1 << 16  # shingle hashes counted at a time


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64 bits of a text, as a signed integer."""
    words = text.encode().lower().split()  # on bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(_SEED))
    for at in range(0, total, _CHUNK):
        part = np.fromiter(hashes, np.uint64, min(_CHUNK, total - at))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), shingle: int = 3) -> DataFrame:
    """Kept columns and ``fingerprint`` (the 64 bits as a signed bigint)."""
    def start():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]
    return map_texts(docs, text, keep, "fingerprint bigint", start)


# ---------------------------------------------------------------- links

def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(bits: list[int], segments: int) -> list[tuple[int, int]]:
    """(mask, wildcard bit) of every key over the given bit positions."""
    out, size = [], -(-len(bits) // segments)
    for at in range(0, len(bits), size):
        whole = sum(1 << b for b in bits[at:at + size])
        out.append((_signed(whole), 0))
        out += [(_signed(whole & ~(1 << b)), _signed(1 << b)) for b in bits[at:at + size]]
    return out


def _longs(values) -> F.Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _pairs(members: DataFrame, keys: list[str], distance: int, wild: list[F.Column]) -> DataFrame:
    """Verified pairs of fingerprints that share the keys and differ in every wildcard bit."""
    a, b = members.alias("a"), members.alias("b")
    gap = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    on = F.col("a.fp") < F.col("b.fp")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    for w in wild:
        on &= gap.bitwiseAND(w) == w
    on &= F.bit_count(gap) <= distance
    # signatures are some dozens of times the rows that Spark estimates: never broadcast
    return a.join(b.hint("merge"), on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(distinct: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """All pairs (u, v), u < v, of the distinct fingerprints ``fp`` at most ``distance`` bits apart."""
    segments = distance // 2 + 1
    first = _variants(list(range(64)), segments)
    # a fingerprint becomes some dozens of signatures: spread by rows, not by bytes
    spread = distinct.repartition(distinct.count() // SPREAD + 1, "fp")
    signatures = spread.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m, _ in first])).alias("slot", "part"))
    counts = signatures.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the estimate does not see the explode and would send all signatures through the driver
    shared = durable(signatures.join(counts.hint("merge"), ["slot", "part"]))
    wild = F.element_at(_longs([w for _, w in first]), F.col("a.slot") + 1)
    light = _pairs(shared.where(F.col("n") <= bucket), ["slot", "part"], distance, [wild])

    # keys with too many holders: the bits outside the segment are cut in the same way
    second = []
    for mask, w in first:
        seg = mask | w
        second.append(_variants([b for b in range(64) if not (seg >> b) & 1], segments))
    width = max(map(len, second))
    second = [v + [(0, -1)] * (width - len(v)) for v in second]  # padding, dropped below
    heavy = shared.where(F.col("n") > bucket)
    masks = F.array(*[_longs([m for m, _ in v]) for v in second])
    wilds = F.array(*[_longs([w for _, w in v]) for v in second])
    heavy = heavy.select("fp", "slot", "part", F.posexplode(F.transform(
        F.element_at(masks, F.col("slot") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("slot2", "part2"))
    heavy = heavy.where(F.element_at(F.element_at(masks, F.col("slot") + 1), F.col("slot2") + 1) != 0)
    wild2 = F.element_at(F.element_at(wilds, F.col("a.slot") + 1), F.col("a.slot2") + 1)
    deep = _pairs(heavy, ["slot", "part", "slot2", "part2"], distance, [wild, wild2])
    return light.unionByName(deep).distinct()


def _folded(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``rows``, stored."""
    distinct = durable(rows.select(F.col("fingerprint").alias("fp")).distinct())
    stars = components(links(distinct, distance))
    return durable(distinct.join(stars, distinct.fp == stars.node, "left")
                   .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable)."""
    rows = durable(fingerprints(docs, text, (id_col,), shingle))
    folded = _folded(rows, distance)
    least = rows.groupBy("fingerprint").agg(F.min(col(id_col)).alias("least"))
    named = folded.join(least, folded.fp == least.fingerprint).select("fp", "root", "least")
    named = durable(named)
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = durable(named.select("fp", "root").join(of_root, "root").select("fp", "component_id"))
    return rows.join(of_print, rows.fingerprint == of_print.fp, "left").select(
        col(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
             distance: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the row of the smallest id.

    Rows without an id come last; among rows of one id the smallest text hash stays, and of
    equal rows one.
    """
    own, = fresh(docs, "_hash")
    hashed = docs.withColumn(own, F.xxhash64(text_of(text)))
    rows = durable(fingerprints(hashed, text, (id_col, own), shingle)
                   .withColumnsRenamed({id_col: "_id", own: "_h"}))
    folded = _folded(rows, distance)
    best = F.min(F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("i"), F.col("_h").alias("h")))
    of_print = durable(rows.groupBy("fingerprint").agg(best.alias("best")))
    chosen = (folded.join(of_print, folded.fp == of_print.fingerprint)
              .groupBy("root").agg(F.min("best").alias("best")).select("best.i", "best.h"))
    chosen = durable(chosen.distinct())
    stay = hashed.join(chosen, col(id_col).eqNullSafe(chosen.i) & (col(own) == chosen.h), "left_semi")
    place, = fresh(hashed, "_place")
    order = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text)] or [F.lit(0)]
    one = W.partitionBy(col(id_col), col(own)).orderBy(*order)
    return stay.withColumn(place, F.row_number().over(one)).where(col(place) == 1).select(
        *[col(c) for c in docs.columns])
