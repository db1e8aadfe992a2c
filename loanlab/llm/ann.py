"""Approximate nearest neighbours by a hash-prefix forest, for the largest inner product.

Every tree gives each vector a hash string of ``BITS`` signs of random projections, kept in
sorted arrays. A query descends in every tree to its longest prefixes and then ascends in all
trees at once: the prefix is the longest one at which the trees together hold enough
candidates (``hits``, at least ``MIN_HITS``, or ``share`` of all vectors). Norms count too: an
item gets one more coordinate that fills it up to the largest norm, a query a zero there.

In Spark: a directory counts the items under every ``TOP``-bit prefix of every tree
(trees x 65,536 numbers at most, whatever the corpus; it is broadcast). Each query reads its
common prefix length from it and asks one unit, a prefix of that length, per tree. Items and
queries meet by a shuffle on the unit. Large units are cut into slices of ``SLICE`` items on
average; queries go to all slices. In units of ``TOP`` bits the slice's own sorted array is
descended further. Candidates are scored in double precision on the original vectors.

Every vector is indexed. Of equal vectors only the k + 1 smallest ids can be among k nearest,
so others are folded away after indexing their class, and equal queries are asked once;
both are found by grouping with partial limits, so copies never meet in one task. Rows that
repeat an id are folded before, so that the limit counts ids.

Recall depends on the data and on ``trees`` and ``share``. Vectors without any structure, as
in the test tables, need about a whole corpus of hits (``share=1.0``, 20 trees: recall@20 of
0.97); for clustered vectors a share of 0 and a few thousand hits do.

Defined results: vectors that are null, zero, or that hold null or non-finite components take
no part, nor do rows without an id; vectors of different lengths never meet, each length that
queries have is searched on its own, one after another; rows that repeat an id answer for one;
a query never finds its own id; fewer candidates than k are all found if
``hits`` reaches them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.llm.common import Shared, col, ship
from loanlab.session import durable

ship(__name__)

TREES, BITS, TOP = 20, 32, 16
MIN_HITS = 4_096
SHARE = 1.0
SLICE = 4_096       # items of one unit that are held together, on average
_BLOCK = 1 << 20    # scores held at a time
_SAME = 12          # decimals to which scores are compared while choosing; the exact ones are returned


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Forest:
    """Projections and, once counted, the directory of all trees."""

    def __init__(self, dims: int, trees: int, norm: float, top: int = TOP, slice_rows: int = SLICE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees, self.norm, self.top, self.slice_rows = trees, norm, top, slice_rows
        self.planes = rng.normal(size=(dims + 1, trees * BITS))
        self.below = None  # items before each TOP-bit prefix, per tree
        self.hits = 0

    def codes(self, vectors: np.ndarray, item: bool) -> np.ndarray:
        """The hash strings, one column per tree, as integers of BITS bits."""
        x = vectors.astype(np.float64)
        z = x @ self.planes[:-1]
        if item:
            rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0))
            z += rest[:, None] * self.planes[-1]
        bits = (z > 0).reshape(len(x), self.trees, BITS)
        return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def count(self, tree, depth, prefix) -> np.ndarray:
        low = prefix << (self.top - depth)
        return self.below[tree, low + (np.int64(1) << (self.top - depth))] - self.below[tree, low]

    def depths(self, codes: np.ndarray) -> np.ndarray:
        """Longest common prefix length at which all trees together hold enough items."""
        out, tree = np.zeros(len(codes), np.int64), np.arange(self.trees)
        for depth in range(1, self.top + 1):
            held = self.count(tree, depth, codes >> (BITS - depth)).sum(axis=1)
            out[held >= self.hits] = depth
        return out

    def unit(self, tree, depth, prefix) -> np.ndarray:
        return (tree * (self.top + 1) + depth) << self.top | prefix

    def slices(self, tree, depth, prefix) -> np.ndarray:
        return np.maximum(1, -(-self.count(tree, depth, prefix) // self.slice_rows))


_UNIT = "unit bigint, slice int, query boolean, code bigint, id bigint"


def _routed(forest, ids, vectors, codes, rows, trees, depths, slices, query):
    """A batch of unit rows."""
    full = codes[rows, trees]
    unit = forest.unit(trees, depths, full >> (BITS - depths))
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(unit), pa.array(slices.astype(np.int32)), pa.array(np.full(n, query)), pa.array(full),
         ids.take(pa.array(rows)), vectors.take(pa.array(rows))],
        names=["unit", "slice", "query", "code", "id", "vector"])


def _search(items: tuple, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, deep: int, k: int, top: int) -> Iterator:
    """The best k items (more on ties) of one slice for every query, as arrays (query, item, score).

    ``deep``: items wanted by a further descent in the sorted codes, 0 if the unit is wanted whole.
    """
    item_ids, item_codes, table = items
    step = max(1, _BLOCK // len(item_ids))
    for a in range(0, len(ids), step):
        mine = vectors[a:a + step]
        scores = np.round(mine @ table.T, _SAME)
        if deep:
            low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(item_ids))
            done = np.zeros(len(mine), bool)
            for depth in range(BITS, top, -1):
                shift = BITS - depth
                floor = codes[a:a + step] >> shift << shift
                lo, hi = np.searchsorted(item_codes, floor), np.searchsorted(item_codes, floor + (1 << shift))
                new = ~done & (hi - lo >= deep)
                low[new], high[new] = lo[new], hi[new]
                done |= new
            at = np.arange(len(item_ids))
            scores[(at < low[:, None]) | (at >= high[:, None])] = -np.inf
        kth = min(k, len(item_ids))
        edge = np.partition(scores, -kth, axis=1)[:, -kth]
        q, i = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        yield ids[a:a + step][q], item_ids[i], np.einsum("ij,ij->i", mine[q], table[i])


def _valid(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = col(vector)
    return rows.select(col(id_col).cast("bigint").alias("id"), v.alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("vector", lambda c: c != 0))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, share: float = SHARE, min_hits: int = MIN_HITS, top: int = TOP,
            slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every query row.

    ``is_query`` is a condition on the column ``id``. Every vector length has its own forest.
    """
    valid = _valid(rows, id_col, vector)
    lengths = sorted(r[0] for r in valid.where(is_query).select(F.size("vector")).distinct().collect())
    parts = [_nearest(valid.where(F.size("vector") == d), is_query, k, trees, share, min_hits, top, slice_rows)
             for d in lengths]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if len(parts) == 1:
        return parts[0]
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # an id may repeat in several lengths
    return (reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest(valid: DataFrame, is_query: Column, k: int, trees: int, share: float, min_hits: int, top: int,
             slice_rows: int) -> DataFrame:
    """``nearest`` among valid vectors of one length."""
    spark = valid.sparkSession
    keyed = valid.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.reverse("vector"), F.lit(1)))
    copies = W.partitionBy("h1", "h2").orderBy("id")
    # repeated rows go first: they would take the places of other ids of their class
    single = keyed.dropDuplicates(["id", "h1", "h2"])
    items = durable(single.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
                    .select("id", "vector", "h1", "h2"))
    shape = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"), F.max(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).alias("norm")).first()
    forest = Forest(shape["d"], trees, shape["norm"], top, slice_rows)
    sent = Shared(spark, forest)

    def tally(batches):
        own = sent.value
        for batch in batches:
            codes = own.codes(_matrix(batch.column(0)), True) >> (BITS - own.top)
            flat = (codes + (np.arange(own.trees, dtype=np.int64) << own.top)).ravel()
            slots, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n)], names=["slot", "n"])

    # trees x 2^top rows at most
    counted = items.select("vector").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    table = np.zeros((trees, (1 << top) + 1), np.int64)
    slots = counted["slot"].to_numpy()
    table[slots >> top, (slots & (1 << top) - 1) + 1] = counted["n"].to_numpy()
    forest.below = np.cumsum(table, axis=1)
    forest.hits = max(min_hits, int(share * shape["n"]))
    known = Shared(spark, forest)
    vector_kind = items.schema["vector"].dataType.simpleString()
    unit_schema = f"{_UNIT}, vector {vector_kind}"

    asked = durable(keyed.where(is_query).select("id", "h1", "h2").dropDuplicates())
    first = asked.groupBy("h1", "h2").agg(F.min("id").alias("q"))
    # the smallest id of a class is among the items; its vector stands for all queries of the class
    stands = items.withColumn("n", F.row_number().over(copies)).where("n = 1").drop("n", "id")
    queries = durable(first.join(stands, ["h1", "h2"]).select(F.col("q").alias("id"), "vector"))

    def ask(batches):
        own = known.value
        for batch in batches:
            codes = own.codes(_matrix(batch.column(1)), False)
            depths = own.depths(codes)
            for a in range(0, batch.num_rows, 256):
                n = min(256, batch.num_rows - a)
                rows_at = np.repeat(np.arange(a, a + n), own.trees)
                tree = np.tile(np.arange(own.trees), n)
                depth = depths[rows_at]
                real = (depth > 0) | (tree == 0)  # without a prefix all trees hold the same
                rows_at, tree, depth = rows_at[real], tree[real], depth[real]
                pieces = own.slices(tree, depth, codes[rows_at, tree] >> (BITS - depth))
                spread = np.repeat(np.arange(len(rows_at)), pieces)
                piece = np.arange(len(spread)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                yield _routed(own, batch.column(0), batch.column(1), codes, rows_at[spread], tree[spread],
                              depth[spread], piece, True)

    probes = durable(queries.mapInArrow(ask, unit_schema))
    used = sorted(r[0] for r in probes.select(F.shiftright("unit", top) % (top + 1)).distinct().collect())

    def offer(batches):
        own = known.value
        for batch in batches:
            codes = own.codes(_matrix(batch.column(1)), True)
            every = np.arange(batch.num_rows)
            place = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for depth in used:
                for tree in range(own.trees if depth else 1):
                    pieces = own.slices(tree, depth, codes[:, tree] >> (BITS - depth))
                    yield _routed(own, batch.column(0), batch.column(1), codes, every, np.full(len(every), tree),
                                  np.full(len(every), depth), place.astype(np.int64) % pieces, False)

    def meet(batches):
        own = known.value
        key, parts, held = None, [], None
        for batch in batches:
            unit, piece = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            query = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(piece) != 0) | np.diff(query)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(unit)]):
                if a == b:
                    continue
                if (unit[a], piece[a]) != key:
                    key, parts, held = (unit[a], piece[a]), [], None
                ids, codes = batch.column(4)[a:b].to_numpy(), batch.column(3)[a:b].to_numpy()
                vectors = _matrix(batch.column(5)[a:b]).astype(np.float64)
                if not query[a]:
                    parts.append((ids, codes, vectors))
                    continue
                if held is None and parts:
                    held, parts = tuple(np.concatenate(x) for x in zip(*parts)), []
                if held is None:
                    continue
                depth = (int(unit[a]) >> own.top) % (own.top + 1)
                deep = 0
                if depth == own.top:
                    tree = (int(unit[a]) >> own.top) // (own.top + 1)
                    n = int(own.slices(tree, depth, int(unit[a]) & (1 << own.top) - 1))
                    deep = max(k + 1, -(-own.hits // (own.trees * n)))
                for q, i, s in _search(held, ids, codes, vectors, deep, k + 1, own.top):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["q", "i", "s"])

    offered = items.select("id", "vector").mapInArrow(offer, unit_schema)
    met = (offered.unionByName(probes).repartition("unit", "slice")
           .sortWithinPartitions("unit", "slice", "query", "code"))
    found = met.mapInArrow(meet, "q bigint, i bigint, s double").groupBy("q", "i").agg(F.max("s").alias("s"))
    best = W.partitionBy("q").orderBy(F.desc("s"), "i")
    hits = durable(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))

    answers = durable(first).join(hits, "q").select("h1", "h2", "i", "s")
    own = W.partitionBy("id").orderBy(F.desc("s"), "i")
    return (asked.join(durable(answers), ["h1", "h2"]).where("id <> i").groupBy("id", "i").agg(F.max("s").alias("s"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), "rank", F.col("i").alias("vec_id"), F.col("s").alias("score")))
