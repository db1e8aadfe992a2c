"""A random forest grown from binned rows, level by level.

Rows are stored once as blocks of bytes (one code per feature). A row's place in a tree's bootstrap
sample is a Poisson(1) count from a hash of the row and the tree, and a node's features are drawn by a
hash of tree and node, so nothing depends on partitions. A node with more than ``LOCAL_ROWS`` sampled rows is split by
counts that Spark sums over all blocks; a smaller one goes with its rows, a bounded number, to one group,
which grows the rest below it. Trees are kept as arrays, about 15 bytes a node.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

LOCAL_ROWS = 200_000  # sampled rows below which a node is grown in one group
BLOCK_ROWS = 20_000   # rows of a stored block, about
NODES_AT_ONCE = 512   # nodes of a level whose counts are held together: a few megabytes, some ten times in all
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salt(seed: int, tree: int) -> np.uint64:
    return _mix(np.array([seed * 1_000_003 + tree], np.uint64))[0]


def _drawn(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's sample."""
    u = (_mix(keys ^ _salt(seed, tree)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_POISSON, u, "right")


def _features(nodes: np.ndarray, width: int, take: int, seed: int, tree: int) -> np.ndarray:
    """The features that each node may split on: (nodes, take)."""
    base = _mix(nodes.astype(np.uint64) ^ _salt(seed + 1, tree))
    order = np.stack([_mix(base ^ np.uint64(f + 1)) for f in range(width)], axis=1)
    return np.sort(np.argsort(order, axis=1)[:, :take], axis=1)


def _counts(codes, y, times, at, feats, slots: int) -> np.ndarray:
    """Sampled rows by (node, drawn feature, code, class). ``at``: the node's place of each row."""
    m, take = feats.shape
    out = np.empty((m, take, slots, 2))
    rows = np.arange(len(at))
    for j in range(take):
        cell = (at * slots + codes[rows, feats[at, j]]) * 2 + y
        out[:, j] = np.bincount(cell, times, m * slots * 2).reshape(m, slots, 2)
    return out


def _splits(counts: np.ndarray, feats: np.ndarray, weights: np.ndarray, min_leaf: int) -> dict[str, np.ndarray]:
    """By node: feature (-1: a leaf), code of the cut, P(1), rows left and right, gain (weighted Gini)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = counts.cumsum(axis=2)
        whole = left[:, :1, -1:, :]
        right = whole - left
        n_left, n_right = left.sum(axis=3), right.sum(axis=3)
        lw, rw, ww = left * weights, right * weights, (whole * weights)[:, 0, 0]
        purity = (lw ** 2).sum(axis=3) / lw.sum(axis=3) + (rw ** 2).sum(axis=3) / rw.sum(axis=3)
        purity = np.where((n_left >= max(1, min_leaf)) & (n_right >= max(1, min_leaf)), purity, -np.inf)
        p, before = ww[:, 1] / ww.sum(axis=1), (ww ** 2).sum(axis=1) / ww.sum(axis=1)
    m, take, slots = purity.shape
    best = purity.reshape(m, -1).argmax(axis=1)
    slot, code, here = best // slots, best % slots, np.arange(m)
    gain = purity[here, slot, code] - before
    good = gain > before * 1e-12
    return {"feature": np.where(good, feats[here, slot], -1), "code": code, "p": p, "gain": gain,
            "n_left": n_left[here, slot, code], "n_right": n_right[here, slot, code]}


@dataclass
class Growth:
    """What every task needs to know."""

    width: int
    slots: int             # codes of a feature, at most
    take: int              # features drawn for a node
    weights: np.ndarray    # of the classes
    max_depth: int
    min_leaf: int
    seed: int

    def _found(self, tree: int, ids: np.ndarray, codes, y, times, at) -> dict[str, np.ndarray]:
        """``_splits`` of the nodes of a level, some at a time."""
        parts = []
        for a in range(0, len(ids), NODES_AT_ONCE):
            some = ids[a:a + NODES_AT_ONCE]
            feats = _features(some, self.width, self.take, self.seed, tree)
            rows = slice(None) if len(some) == len(ids) else np.flatnonzero((at >= a) & (at < a + len(some)))
            counts = _counts(codes[rows], y[rows], times[rows], at[rows] - a, feats, self.slots)
            parts.append(_splits(counts, feats, self.weights, self.min_leaf))
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def grow(self, tree: int, root: int, codes, y, times) -> dict[str, np.ndarray]:
        """The subtree below a node, from its sampled rows: arrays by node, the root first."""
        made, total = [], 1
        ids, at, gains = np.array([root], np.int64), np.zeros(len(y), np.int64), np.zeros(self.width)
        for depth in range(root.bit_length() - 1, self.max_depth + 1):
            found = self._found(tree, ids, codes, y, times, at)
            if depth == self.max_depth:
                found["feature"][:] = -1
            f = found["feature"]
            split = f >= 0
            np.add.at(gains, f[split], found["gain"][split])
            rank = np.cumsum(split) - 1
            child = np.where(split, total + 2 * rank, -1)
            made.append((f, found["code"], child, np.where(split, child + 1, -1), found["p"]))
            total += 2 * int(split.sum())
            if not split.any():
                break
            goes = split[at]
            codes, y, times, at = codes[goes], y[goes], times[goes], at[goes]
            over = codes[np.arange(len(at)), f[at]] > found["code"][at]
            at = 2 * rank[at] + over
            ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).ravel()
        feature, code, left, right, p = (np.concatenate(part) for part in zip(*made))
        return {"feature": feature.astype(np.int16), "code": code.astype(np.uint8), "left": left.astype(np.int32),
                "right": right.astype(np.int32), "p": p.astype(np.float32), "gains": gains}


def _place(top: dict, codes: np.ndarray) -> np.ndarray:
    """Number of the node that each row reaches among the split nodes of a tree, as yet."""
    node, rows = np.ones(len(codes), np.int64), np.arange(len(codes))
    for at in sorted(k for k, s in top.items() if s[0] >= 0):
        f, code = top[at][:2]
        here = rows[node == at]
        node[here] = 2 * at + (codes[here, f] > code)
    return node


def _blocks(batch, width: int) -> Iterator[tuple]:
    for codes, y, keys in zip(*[batch.column(i) for i in range(3)]):
        yield (np.frombuffer(codes.as_py(), np.uint8).reshape(-1, width), np.frombuffer(y.as_py(), np.uint8),
               np.frombuffer(keys.as_py(), np.uint64))


def _stored(train: DataFrame, id_col: str, cuts: list[list[float]]) -> DataFrame:
    """Blocks of rows (codes, classes, hashes of the rows), stored."""
    edges = [np.array(c) for c in cuts]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(edges))
                codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
                y, keys = part.column(1).to_numpy(), part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in (codes.astype(np.uint8), y.astype(np.uint8), keys)],
                    names=["codes", "y", "keys"])
    x = vector_to_array("features")
    rows = train.select(x.alias("x"), F.col("label").cast("int").alias("y"),
                        F.xxhash64(F.col(id_col), x, F.col("label").cast("double")))
    return durable(rows.mapInArrow(run, "codes binary, y binary, keys binary"))


def _split_top(blocks: DataFrame, g: Growth, tops: list[dict], waiting: dict[int, list[int]]) -> list:
    """Splits of nodes with many rows, from counts over all blocks."""
    def run(batches):
        sums = {}  # trees x waiting nodes, of some kilobytes each: bounded by sampled rows / LOCAL_ROWS
        for batch in batches:
            for codes, y, keys in _blocks(batch, g.width):
                for tree, nodes in waiting.items():
                    times, ids = _drawn(keys, g.seed, tree), np.array(sorted(nodes), np.int64)
                    node = _place(tops[tree], codes)
                    at = np.searchsorted(ids, node).clip(0, len(ids) - 1)
                    live = (times > 0) & (ids[at] == node)
                    feats = _features(ids, g.width, g.take, g.seed, tree)
                    counts = _counts(codes[live], y[live], times[live], at[live], feats, g.slots)
                    sums[tree] = sums[tree] + counts if tree in sums else counts
        for tree, counts in sums.items():
            rows = [(tree, n, c.tobytes()) for n, c in zip(sorted(waiting[tree]), counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))],
                names=["tree", "node", "counts"])

    def choose(table):
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        counts = sum(np.frombuffer(c.as_py()) for c in table.column("counts"))
        feats = _features(np.array([node]), g.width, g.take, g.seed, tree)
        found = _splits(counts.reshape(1, g.take, g.slots, 2), feats, g.weights, g.min_leaf)
        if node.bit_length() > g.max_depth:
            found["feature"][:] = -1
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
                         **{k: pa.array([float(found[k][0])]) for k in ("feature", "code", "p", "gain", "n_left", "n_right")}})
    return blocks.mapInArrow(run, "tree int, node bigint, counts binary").groupBy("tree", "node").applyInArrow(
        choose, "tree int, node bigint, feature double, code double, p double, gain double, n_left double, "
                "n_right double").collect()


def _grow_rest(blocks: DataFrame, g: Growth, tops: list[dict], rest: dict[int, set]) -> list:
    """The subtrees of the nodes with few rows, each in the group of its rows."""
    def run(batches):
        for batch in batches:
            for codes, y, keys in _blocks(batch, g.width):
                for tree, nodes in rest.items():
                    times = _drawn(keys, g.seed, tree)
                    node = np.where(times > 0, _place(tops[tree], codes), 0)
                    rows = [(tree, int(n), np.concatenate(
                        (codes[here], y[here, None], times[here, None].astype(np.uint8)), axis=1).tobytes())
                        for n in np.unique(node) if n in nodes for here in [np.flatnonzero(node == n)]]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))],
                            names=["tree", "node", "rows"])

    def grow(table):
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        rows = np.concatenate([np.frombuffer(r.as_py(), np.uint8).reshape(-1, g.width + 2) for r in table.column("rows")])
        made = g.grow(tree, node, rows[:, :g.width], rows[:, -2].astype(np.int64), rows[:, -1].astype(np.float64))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()),
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in made.items()}})
    tasks = min(2_000, sum(map(len, rest.values())))
    return blocks.mapInArrow(run, "tree int, node bigint, rows binary").repartition(tasks, "tree", "node").groupBy(
        "tree", "node").applyInArrow(grow, "tree int, node bigint, feature binary, code binary, left binary, "
                                           "right binary, p binary, gains binary").collect()


PARTS = {"feature": np.int16, "code": np.uint8, "left": np.int32, "right": np.int32, "p": np.float32}


@dataclass
class ForestModel:
    """Trees as arrays by node (feature -1: a leaf), one after the other; ``roots`` are their first nodes."""

    nodes: dict[str, np.ndarray]
    roots: np.ndarray
    cuts: list[list[float]]
    importances: list[float]
    kind: str = "forest"

    def score(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.nodes, self.roots, [np.array(c) for c in self.cuts]))

        @F.pandas_udf("double")
        def share(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
            nodes, roots, edges = sent.value
            for part in rows:
                yield pd.Series(_descend(nodes, roots, edges, part))
        return df.withColumn("score", share(vector_to_array("features"))).withColumn(
            "prediction", (F.col("score") > 0.5).cast("int"))

    def importance(self):
        return self.importances


def _descend(nodes: dict, roots: np.ndarray, edges: list, part) -> np.ndarray:
    """Mean of the leaves' P(1) over the trees."""
    if not len(part):
        return np.zeros(0)
    x = np.stack(part.to_numpy())
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
    total = np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root)
        live = np.flatnonzero(nodes["feature"][at] >= 0)
        while len(live):
            here = at[live]
            over = codes[live, nodes["feature"][here]] > nodes["code"][here]
            at[live] = np.where(over, nodes["right"][here], nodes["left"][here])
            live = live[nodes["feature"][at[live]] >= 0]
        total += nodes["p"][at]
    return total / len(roots)


def fit(train: DataFrame, id_col: str, counts: dict, cuts: list[list[float]], num_trees: int, max_depth: int, min_leaf: int,
        seed: int, local_rows: int | None = None) -> ForestModel:
    """``counts``: rows by class, which are weighted alike; ``cuts``: candidate cuts by feature."""
    width, n = len(cuts), sum(counts.values())
    weights = np.array([n / (2 * counts[c]) if counts.get(c) else 0.0 for c in (0, 1)])
    g = Growth(width, max(map(len, cuts)) + 1, max(1, int(np.ceil(width ** 0.5))), weights, max_depth, min_leaf, seed)
    limit = LOCAL_ROWS if local_rows is None else local_rows
    blocks = _stored(train, id_col, cuts)
    tops: list[dict] = [{} for _ in range(num_trees)]
    rest: dict[int, set] = {t: set() for t in range(num_trees)}
    waiting = {t: [1] for t in range(num_trees)} if n > limit else {}
    if not waiting:
        rest = {t: {1} for t in range(num_trees)}
    while waiting:
        again: dict[int, list[int]] = {}
        for r in _split_top(blocks, g, tops, waiting):
            tree, node = r["tree"], r["node"]
            tops[tree][node] = (int(r["feature"]), int(r["code"]), r["p"], r["gain"])
            for child, rows in ((2 * node, r["n_left"]), (2 * node + 1, r["n_right"])):
                if r["feature"] >= 0:
                    again.setdefault(tree, []).append(child) if rows > limit else rest[tree].add(child)
        waiting = again
    rest = {t: s for t, s in rest.items() if s}
    grown = {(r["tree"], r["node"]): r for r in _grow_rest(blocks, g, tops, rest)} if rest else {}
    share = float(weights[1] * counts.get(1, 0) / max(1e-300, sum(weights[c] * counts.get(c, 0) for c in (0, 1))))
    parts, roots, at = {k: [] for k in PARTS}, [], 0
    gains = np.zeros(width)
    for tree in range(num_trees):
        roots.append(at)
        nodes, own = _assembled(tree, tops[tree], grown, at, width, share)
        for k in PARTS:
            parts[k].append(nodes[k])
        at += len(nodes["p"])
        gains += own / own.sum() if own.sum() > 0 else 0.0
    return ForestModel({k: np.concatenate(v) for k, v in parts.items()}, np.array(roots, np.int64), cuts,
                       [float(v) for v in (gains / gains.sum() if gains.sum() > 0 else gains)])


def _assembled(tree: int, top: dict, grown: dict, at: int, width: int, share: float) -> tuple[dict, np.ndarray]:
    """One tree's arrays, from node number ``at`` on, and its gains by feature."""
    first = sorted(top)
    place = {node: at + i for i, node in enumerate(first)}
    after, below, gains = at + len(first), [], np.zeros(width)
    roots = [c for n in first if top[n][0] >= 0 for c in (2 * n, 2 * n + 1) if c not in top] if first else [1]
    for node in roots:
        place[node], row = after, grown.get((tree, node))
        if row is None:  # no row of the sample came here
            got = {"feature": [-1], "code": [0], "left": [-1], "right": [-1], "p": [share]}
        else:
            got = {k: np.frombuffer(row[k], t) for k, t in PARTS.items()}
            gains += np.frombuffer(row["gains"])
        got = {k: np.array(v, PARTS[k]) for k, v in got.items()}
        for side in ("left", "right"):
            got[side] = np.where(got["feature"] >= 0, got[side] + after, -1).astype(np.int32)
        below.append(got)
        after += len(got["p"])
    head = {"feature": [top[n][0] for n in first], "code": [top[n][1] for n in first], "p": [top[n][2] for n in first],
            "left": [place.get(2 * n, -1) for n in first], "right": [place.get(2 * n + 1, -1) for n in first]}
    for n in first:
        if top[n][0] >= 0:
            gains[top[n][0]] += top[n][3]
    return {k: np.concatenate([np.array(head[k], t), *[b[k] for b in below]]).astype(t) for k, t in PARTS.items()}, gains
