"""Rows as stored blocks of bytes, and sums over them: what the boosted learners share.

A feature's code is the number of its cuts below the value. Features are packed into groups, whose codes
make one number of two bytes (mixed radix), so a pass over the rows counts a group, not a feature, at
a time; a feature's sums are the group's, added up over the others. A block holds up to
``BLOCK_ROWS`` rows, group by group, those of class 0 first.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

BLOCK_ROWS = 16_384
LOCAL_ROWS = 1_500_000  # rows up to which one task boosts alone: they take it some 100 MB
GROUP_SLOTS = 256  # codes of a group, if it has more than one feature


class Packing:
    """Which features share a group: the first group with room, features with many codes first."""

    def __init__(self, cuts: list[list[float]]):
        self.edges = [np.array(c, float) for c in cuts]
        self.sizes = [len(c) + 1 for c in cuts]
        self.groups: list[list[int]] = []
        for f in sorted(range(len(cuts)), key=lambda f: -self.sizes[f]):
            for g in self.groups:
                if np.prod([self.sizes[i] for i in g]) * self.sizes[f] <= GROUP_SLOTS:
                    g.append(f)
                    break
            else:
                self.groups.append([f])
        self.shapes = [tuple(self.sizes[f] for f in g) for g in self.groups]
        self.slots = [int(np.prod(s)) for s in self.shapes]
        self.starts = np.concatenate([[0], np.cumsum(self.slots)])
        self.place = {f: (g, axis) for g, fs in enumerate(self.groups) for axis, f in enumerate(fs)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(groups, rows)"""
        codes = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)]
        return np.stack([np.ravel_multi_index([codes[f] for f in fs], shape) for fs, shape in zip(
            self.groups, self.shapes)]).astype(np.uint16)

    def spread(self, feature: int, by_code: np.ndarray) -> np.ndarray:
        """Values by a feature's code as values by its group's code."""
        g, axis = self.place[feature]
        shape = [1] * len(self.shapes[g])
        shape[axis] = -1
        return np.broadcast_to(by_code.reshape(shape), self.shapes[g]).ravel()

    def by_feature(self, sums: np.ndarray) -> np.ndarray:
        """Sums by all groups' codes as sums by all features' codes, one after the other, along the first axis."""
        out = []
        for f in range(len(self.sizes)):
            g, axis = self.place[f]
            part = sums[self.starts[g]:self.starts[g + 1]].reshape(*self.shapes[g], *sums.shape[1:])
            out.append(part.sum(axis=tuple(i for i in range(len(self.shapes[g])) if i != axis)))
        return np.concatenate(out)

    def parts(self, sums: np.ndarray) -> list[np.ndarray]:
        """Each feature's own of such sums."""
        return np.split(sums, np.cumsum(self.sizes)[:-1])


def store_blocks(train: DataFrame, id_col: str, packing: Packing) -> DataFrame:
    """(codes, zeros, keys): a block's codes, its number of rows of class 0 and hashes of the rows; stored."""
    def run(batches):
        held = []
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(packing.edges))
            held.append((packing.encode(x), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            if sum(len(y) for _, y, _ in held) >= BLOCK_ROWS:
                yield from blocks(held)
                held = []
        yield from blocks(held)

    def blocks(held):
        if not held:
            return
        codes, y, keys = (np.concatenate(part, axis=-1) for part in zip(*held))
        for a in range(0, len(y), BLOCK_ROWS):
            order = a + np.argsort(y[a:a + BLOCK_ROWS], kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([codes[:, order].tobytes()], pa.binary()), pa.array([int((y[order] == 0).sum())], pa.int32()),
                 pa.array([keys[order].tobytes()], pa.binary())], names=["codes", "zeros", "keys"])
    x = vector_to_array("features")
    rows = train.select(x.alias("x"), F.col("label").cast("int").alias("y"), F.xxhash64(id_col).alias("key"))
    # a row is some 30 bytes now: as many tasks as the cores take
    tasks = train.sparkSession.sparkContext.defaultParallelism
    return durable(rows.mapInArrow(run, "codes binary, zeros int, keys binary").repartition(tasks))


def block_codes(raw: bytes, packing: Packing) -> np.ndarray:
    return np.frombuffer(raw, np.uint16).reshape(len(packing.slots), -1)


def block_rows(blocks: DataFrame, packing: Packing) -> int:
    """Rows in all blocks."""
    return (blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) // (2 * len(packing.slots))


def in_one_task(blocks: DataFrame, work: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> list:
    """``work`` on all blocks together, where a task has room for them; its rows."""
    def run(batches):
        held = [row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])]
        if held:
            yield work(held)
    return blocks.repartition(1).mapInArrow(run, schema).collect()


def summed(blocks: DataFrame, kernel: Callable[[Iterator[tuple]], dict[int, np.ndarray]],
           finish: Callable[[np.ndarray], list[float]], keys: int) -> dict[int, list[float]]:
    """``kernel``: the sums by key over the blocks of a task; ``finish``: what is wanted of a key's whole sums."""
    def run(batches):
        found = kernel(row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(
                [s.tobytes() for s in found.values()], pa.binary())], names=["key", "sums"])

    def add(table):
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return pa.table({"key": table.column("key")[:1], "out": pa.array([finish(total)], pa.list_(pa.float64()))})
    rows = blocks.mapInArrow(run, "key int, sums binary").repartition(-(-keys // 4), "key").groupBy("key").applyInArrow(
        add, "key int, out array<double>").collect()
    return {r["key"]: r["out"] for r in rows}
