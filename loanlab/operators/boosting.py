"""Gradient-boosted trees for two classes, on binned rows stored once.

The log loss of labels -1 and 1 at the margin F, 2 ln(1 + exp(-2yF)), is lowered by regression trees on its
negative gradient, split by weighted variance; the first tree fits the labels and counts in full, the
others at the learning rate, as Spark's own boosted trees do. A level of a tree is one pass: every task adds
up the rows and gradients of its blocks by (node, code), and the sums of a node meet in one group, which
names its best split. The margins are kept beside the codes, 8 bytes a row, and move on once a tree. Up to
``LOCAL_ROWS`` rows the passes would cost more than their work: one task holds the blocks and grows all trees.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.operators import binned
from loanlab.operators.binned import Packing, block_codes, block_rows, in_one_task, store_blocks, summed
from loanlab.operators.forest import PARTS, ForestModel, _mix, _salt
from loanlab.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

PASS_CELLS = 4_000_000  # sums a task holds at a time: a level with more nodes takes several passes
STORED_EVERY = 25       # trees after which the margins are stored, which ends their lineage


@dataclass
class BoostedModel(ForestModel):
    """Trees whose leaves add up to the margin."""

    kind: str = "boosted"

    def score(self, df: DataFrame) -> DataFrame:
        mean = super().score(df).drop("prediction")
        margin = F.col("score") * F.lit(2.0 * len(self.roots))
        return mean.withColumn("score", 1.0 / (1.0 + F.exp(-margin))).withColumn(
            "prediction", (F.col("score") > 0.5).cast("int"))


class _Tree:
    """A tree as it grows: nodes in order of their making, and the table by which rows go down."""

    def __init__(self, packing: Packing):
        self.packing = packing
        self.feature, self.code, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]
        self.depth = 0

    def split(self, node: int, feature: int, code: int, values: tuple[float, float]) -> None:
        self.feature[node], self.code[node] = feature, code
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            for column, first in ((self.feature, -1), (self.code, 0), (self.left, -1), (self.right, -1), (self.value, v)):
                column.append(first)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By node its group and its place in ``next``; there, by the group's code, the node that comes next."""
        group, after = np.zeros(len(self.feature), np.int64), []
        for i, f in enumerate(self.feature):
            if f < 0:
                after.append(np.full(self.packing.slots[0], i, np.int32))
                continue
            group[i] = self.packing.place[f][0]
            over = np.arange(self.packing.sizes[f]) > self.code[i]
            after.append(self.packing.spread(f, np.where(over, self.right[i], self.left[i]).astype(np.int32)))
        return group, np.cumsum([0, *map(len, after[:-1])]), np.concatenate(after)


def _place(table, depth: int, codes: np.ndarray) -> np.ndarray:
    """Number of the node that each row has reached."""
    group, start, after = table
    at, rows, flat = np.zeros(codes.shape[1], np.int32), np.arange(codes.shape[1]), codes.ravel()
    for _ in range(depth):
        at = after[start[at] + flat[group[at] * len(rows) + rows]]
    return at


def _gradient(margin: np.ndarray, zeros: int, first: bool) -> np.ndarray:
    """Negative gradient of the loss; the labels themselves for the first tree."""
    y = np.ones(len(margin))
    y[:zeros] = -1.0
    if first:
        return y
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _best_splits(sums: np.ndarray, packing: Packing, weights: np.ndarray, min_leaf: int) -> np.ndarray:
    """By node: feature (-1: none), code, leaf value of the left and the right side and gain; then the node's own
    value. ``sums``: by node and code its rows of class 0, of class 1 and weighted gradients."""
    here, best, choice = np.arange(len(sums)), np.zeros(len(sums)), np.zeros((len(sums), 6))
    choice[:, 0] = -1.0
    for f, part in enumerate(np.split(sums, np.cumsum(packing.sizes)[:-1], axis=1)):
        left = part.cumsum(axis=1)
        whole, left = left[:, -1], left[:, :-1]
        right = whole[:, None] - left
        w = whole[:, :2] @ weights
        choice[:, 5] = whole[:, 2] / w
        if not left.shape[1]:
            continue
        good = (left[..., :2].sum(axis=2) >= max(1, min_leaf)) & (right[..., :2].sum(axis=2) >= max(1, min_leaf))
        lw, rw = left[..., :2] @ weights, right[..., :2] @ weights
        whole = whole[:, 2] ** 2 / w
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(good, left[..., 2] ** 2 / lw + right[..., 2] ** 2 / rw - whole[:, None], -np.inf)
            at = gain.argmax(axis=1)
            found = np.stack([np.full(len(here), f), at, left[here, at, 2] / lw[here, at], right[here, at, 2] / rw[here, at],
                              gain[here, at]], axis=1)
        better = found[:, 4] > np.maximum(best, 1e-12 * whole)
        choice[better, :5], best[better] = found[better], found[better, 4]
    return choice


def _best_split(sums: np.ndarray, packing: Packing, weights: np.ndarray, min_leaf: int) -> list[float]:
    """As ``_best_splits``, of one node's sums, one after the other."""
    return _best_splits(sums.reshape(1, -1, 3), packing, weights, min_leaf)[0].tolist()


def _rows_sums(packing, weights, table, depth, wanted, n_nodes, first, draw):
    """Kernel: sums by node of the blocks' rows, as ``_best_split`` takes them."""
    where = np.full(n_nodes, -1, np.int64)  # a wanted node's place among them
    where[wanted] = np.arange(len(wanted))

    def kernel(blocks):
        m = len(wanted)
        sums = [np.zeros((3, m * s)) for s in packing.slots]
        for raw, zeros, keys, margin in blocks:
            codes = block_codes(raw, packing)
            r = _gradient(np.frombuffer(margin) if margin else np.zeros(codes.shape[1]), zeros, first)
            r[:zeros] *= weights[0]
            r[zeros:] *= weights[1]
            at = where[_place(table, depth, codes)]
            live = at >= 0
            if draw is not None:
                live &= draw(np.frombuffer(keys, np.uint64))
            if not live.all():
                kept = np.flatnonzero(live)
                zeros = int(np.searchsorted(kept, zeros))
                codes, r, at = codes[:, kept], r[kept], at[kept]
            for g, slots in enumerate(packing.slots):
                cell = at * slots + codes[g]
                sums[g][0] += np.bincount(cell[:zeros], minlength=m * slots)
                sums[g][1] += np.bincount(cell[zeros:], minlength=m * slots)
                sums[g][2] += np.bincount(cell, r, m * slots)
        by_code = packing.by_feature(np.concatenate([s.reshape(3, m, -1) for s in sums], axis=2).transpose(2, 1, 0))
        by_node = by_code.transpose(1, 0, 2)
        return {int(n): np.ascontiguousarray(s) for n, s in zip(wanted, by_node) if s[:, :2].any()}
    return kernel


def _moved(state: DataFrame, packing, table, depth, values) -> DataFrame:
    """The margins after one more tree."""
    def run(batches):
        for batch in batches:
            for raw, zeros, keys, margin in zip(*[c.to_pylist() for c in batch.columns]):
                codes = block_codes(raw, packing)
                step = values[_place(table, depth, codes)]
                step = step + np.frombuffer(margin) if margin else step
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw], pa.binary()), pa.array([zeros], pa.int32()), pa.array([keys], pa.binary()),
                     pa.array([step.tobytes()], pa.binary())], names=["codes", "zeros", "keys", "margin"])
    return state.mapInArrow(run, "codes binary, zeros int, keys binary, margin binary")


def _draw(seed: int, tree: int, rate: float):
    """Whether a row takes part in a tree, by its hash; None if all do."""
    if rate >= 1.0:
        return None
    return lambda keys: (_mix(keys ^ _salt(seed, tree)) >> np.uint64(11)).astype(float) / (1 << 53) < rate


def _arrays(tree: _Tree, values: np.ndarray) -> dict[str, np.ndarray]:
    return {k: np.array(values if k == "p" else getattr(tree, k)).astype(kind) for k, kind in PARTS.items()}


def _split_nodes(tree: _Tree, found: dict, gains: np.ndarray) -> list[int]:
    """Split the nodes for which a split was found; their children."""
    grown = []
    for node in sorted(found):
        feature, code, left, right, gain, _ = found[node]
        if feature >= 0:
            tree.split(node, int(feature), int(code), (left, right))
            gains[int(feature)] += gain
            grown += [tree.left[node], tree.right[node]]
    tree.depth += bool(grown)
    return grown


def _grown_here(blocks: list[tuple], packing: Packing, weights, rounds, max_depth, rate, min_leaf, subsample, seed):
    """All trees, as ``_arrays``, and the gains by feature, from blocks of rows at hand (codes, zeros, keys).

    Of two children only the smaller one's rows are summed: the other has the rest of the parent's sums.
    """
    codes = np.concatenate([block_codes(b[0], packing) for b in blocks], axis=1)
    keys = np.concatenate([np.frombuffer(b[2], np.uint64) for b in blocks])
    y = np.concatenate([np.arange(len(b[2]) // 8) >= b[1] for b in blocks])
    order = np.lexsort((keys, y))
    codes, keys, n, zeros = np.ascontiguousarray(codes[:, order]), keys[order], len(y), int(len(y) - y.sum())
    at_once = max(1, PASS_CELLS // (3 * int(packing.starts[-1])))
    trees, gains, margin, rows, flat = [], np.zeros(len(packing.sizes)), np.zeros(n), np.arange(n), codes.ravel()

    def sums(wanted):
        where = np.full(len(tree.feature), -1, np.int64)
        where[wanted] = np.arange(len(wanted))
        place = where[at]
        live = np.flatnonzero(place >= 0 if drawn is None else (place >= 0) & drawn)
        place, z, m, r_live, out = place[live], int(np.searchsorted(live, zeros)), len(wanted), r[live], []
        for g, slots in enumerate(packing.slots):
            cell = place * slots + (codes[g] if len(live) == n else codes[g, live])
            out.append(np.stack([np.bincount(cell[:z], minlength=m * slots), np.bincount(cell[z:], minlength=m * slots),
                                 np.bincount(cell, r_live, m * slots)]).reshape(3, m, slots))
        return packing.by_feature(np.concatenate(out, axis=2).transpose(2, 1, 0)).transpose(1, 0, 2)

    for t in range(rounds):
        r = _gradient(margin, zeros, t == 0)
        r[:zeros] *= weights[0]
        r[zeros:] *= weights[1]
        draw = _draw(seed, t, subsample)
        drawn = None if draw is None else draw(keys)
        tree, at, frontier, before = _Tree(packing), np.zeros(n, np.int32), [0], None
        while frontier and tree.depth < max_depth and (drawn is None or drawn.any()):
            found = {}
            if before is None or len(frontier) > at_once:
                for a in range(0, len(frontier), at_once):
                    wanted = frontier[a:a + at_once]
                    whole = sums(wanted)
                    found.update(zip(wanted, _best_splits(whole, packing, weights, min_leaf).tolist()))
                by_node = dict(zip(wanted, whole)) if len(frontier) <= at_once else None
            else:
                held = np.bincount(at if drawn is None else at[drawn], minlength=len(tree.feature))
                pairs = [(a, b) if held[a] <= held[b] else (b, a) for a, b in zip(frontier[::2], frontier[1::2])]
                parent = {tree.left[p]: p for p in before if tree.feature[p] >= 0}
                less = sums([a for a, _ in pairs])
                by_node = {}
                for (a, b), own in zip(pairs, less):
                    by_node[a], by_node[b] = own, before[parent[min(a, b)]] - own
                wanted = list(by_node)
                found.update(zip(wanted, _best_splits(np.stack([by_node[k] for k in wanted]), packing, weights,
                                                      min_leaf).tolist()))
            if tree.depth == 0:
                tree.value[0] = found[0][5]
            frontier, before = _split_nodes(tree, found, gains), by_node
            if frontier:
                group, start, after = tree.table()
                at = after[start[at] + flat[group[at] * n + rows]]
        values = np.array(tree.value) * (1.0 if t == 0 else rate)
        margin += values[at]
        trees.append(_arrays(tree, values))
    return trees, gains


def fit(train: DataFrame, id_col: str, cuts: list[list[float]], weights: tuple[float, float], rounds: int, max_depth: int,
        rate: float, min_leaf: int, subsample: float, seed: int) -> BoostedModel:
    """``cuts``: candidate cuts by feature; ``weights``: of a row of class 0 and of class 1."""
    packing, weights = Packing(cuts), np.array(weights, float)
    blocks = store_blocks(train, id_col, packing)
    if rounds and 0 < block_rows(blocks, packing) <= binned.LOCAL_ROWS:
        def work(held):
            trees, gains = _grown_here(held, packing, weights, rounds, max_depth, rate, min_leaf, subsample, seed)
            rows = [*[[tree[k].tobytes() for k in PARTS] for tree in trees], [gains.tobytes(), *[b""] * (len(PARTS) - 1)]]
            return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), *[
                pa.array(part, pa.binary()) for part in zip(*rows)]], names=["pos", *PARTS])
        *rows, last = sorted(in_one_task(blocks, work, "pos int, " + ", ".join(f"{k} binary" for k in PARTS)),
                             key=lambda r: r["pos"])
        trees = [{k: np.frombuffer(r[k], kind) for k, kind in PARTS.items()} for r in rows]
        return _model(trees, np.frombuffer(last[1]), cuts)
    kept = blocks.withColumn("margin", F.lit(b"").cast("binary"))
    if subsample >= 1.0:
        kept = kept.withColumn("keys", F.lit(b"").cast("binary"))
    state = kept.persist()
    at_once = max(1, PASS_CELLS // (3 * int(packing.starts[-1])))
    trees, gains = [], np.zeros(len(cuts))
    for t in range(rounds):
        tree, draw, frontier = _Tree(packing), _draw(seed, t, subsample), [0]
        while frontier and tree.depth < max_depth:
            table, found = tree.table(), {}
            for a in range(0, len(frontier), at_once):
                wanted = np.array(frontier[a:a + at_once])
                found.update(summed(
                    state, _rows_sums(packing, weights, table, tree.depth, wanted, len(tree.feature), t == 0, draw),
                    lambda sums: _best_split(sums, packing, weights, min_leaf), len(wanted)))
            if kept is not state and tree.depth == 0:
                kept.unpersist()  # the margins that this tree starts from are held by now
            if tree.depth == 0 and 0 in found:
                tree.value[0] = found[0][5]
            frontier = _split_nodes(tree, found, gains)
        values = np.array(tree.value) * (1.0 if t == 0 else rate)
        trees.append(_arrays(tree, values))
        if t + 1 == rounds:
            break
        kept, state = state, _moved(state, packing, tree.table(), tree.depth, values)
        state = (durable(state) if (t + 1) % STORED_EVERY == 0 else state).persist()
    state.unpersist()
    return _model(trees, gains, cuts)


def _model(trees: list[dict], gains: np.ndarray, cuts: list[list[float]]) -> BoostedModel:
    sizes = [len(tree["p"]) for tree in trees]
    nodes = {k: np.concatenate([tree[k] for tree in trees]) for k in PARTS}
    return BoostedModel(nodes | _shifted(nodes, sizes), np.cumsum([0, *sizes[:-1]]), cuts,
                        [float(g) for g in (gains / gains.sum() if gains.sum() > 0 else gains)])


def _shifted(nodes: dict, sizes: list[int]) -> dict:
    """Children by their number among all trees' nodes."""
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    return {side: np.where(nodes["feature"] >= 0, nodes[side] + base, -1).astype(PARTS[side]) for side in ("left", "right")}
