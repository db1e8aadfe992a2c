"""Exact k-nearest-neighbour join, distributed by space cells.

The points are cut into cells by a k-d split, and neighbouring cells make a group. A query first
looks inside its own cell; the k-th distance found there bounds the answer, and only cells whose
bounding box comes closer than that are visited: those of its own group at once, those of other
groups in a second round. Nothing is dropped: a box that is skipped cannot hold a nearer point. A query
is sent once to a group, whose cells it visits there, so what is sent grows with the groups reached and
not with the cells. Work is done in blocks of bounded size (a slice of one group's points against a
slice of its queries), and every block returns only its k best rows per query, so no task sees an
unbounded group and no pair table is ever produced.

Copies of one point would make a cell that cannot be split, so they are folded first: all
copies ask one question, and the k+1 smallest ids stand for them as neighbours (ties go to
the smallest id, so no other copy can be among the k nearest).

The k-d split is steered by a bounded sample of points; boxes are exact over all points.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.session import durable

# the kernels travel inside the tasks: executors need numpy and pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 1_024        # wanted points per cell
MAX_CELLS = 16_384       # bounds the box table: MAX_CELLS x dimensions x 2 doubles
GROUPS = 8               # groups of cells, if they need not be more to stay within a block
BLOCK_ROWS = 65_536      # most points, or queries, in one block
UNIT_QUERIES = 1_024     # queries of a block that are not spread further
SAMPLE_PER_CELL = 16
DECIMALS = 6             # distances are compared at this precision, then by id
_STEP = 10.0 ** -DECIMALS
_VISIT_ROWS = 256        # queries whose cells are looked up together
_MATRIX_CELLS = 500_000  # distances held at a time: a few megabytes per task


# ---------------------------------------------------------------- space cells

class _Cells:
    """Fitted k-d split: a few thousand nodes at most, shipped with the task closure."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.nodes, self.n = [], 0  # (dim, threshold, left, right) or (-1, cell, 0, 0)
        self._grow(sample, n_cells)
        self.table = np.array(self.nodes, dtype=float)

    def _grow(self, pts, want):
        me = len(self.nodes)
        self.nodes.append(None)
        dim = int(np.argmax(pts.var(axis=0))) if len(pts) > 1 else 0
        cut = float(np.median(pts[:, dim])) if len(pts) else 0.0
        left = pts[:, dim] <= cut if len(pts) else np.zeros(0, bool)
        if want > 1 and len(pts) > 1 and left.all():  # the median is the maximum
            cut = float(pts[:, dim].mean())
            left = pts[:, dim] <= cut
        if want <= 1 or len(pts) < 2 or left.all() or not left.any():
            self.nodes[me] = (-1, self.n, 0, 0)
            self.n += 1
            return me
        share = max(1, min(want - 1, round(want * left.mean())))
        a = self._grow(pts[left], share)
        b = self._grow(pts[~left], want - share)
        self.nodes[me] = (dim, cut, a, b)
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        while True:
            dim = self.table[at, 0].astype(int)
            inner = dim >= 0
            if not inner.any():
                return self.table[at, 1].astype(int)
            rows = np.flatnonzero(inner)
            go_left = x[rows, dim[rows]] <= self.table[at[rows], 1]
            at[rows] = np.where(go_left, self.table[at[rows], 2], self.table[at[rows], 3]).astype(int)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _with_cell(df: DataFrame, cells: _Cells) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType())])

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(cell=cells.assign(_matrix(pdf["vec"])).astype("int32") if len(pdf) else 0)

    if cells.n == 1:
        return df.withColumn("cell", F.lit(0))
    return df.mapInPandas(assign, schema)


def _boxes(points: DataFrame, dims: int, n_cells: int):
    """Exact bounding box and row count of every cell."""
    rows = points.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.array(*[F.min(F.element_at("vec", i + 1)) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.element_at("vec", i + 1)) for i in range(dims)]).alias("hi")).collect()
    lo, hi, n = np.full((n_cells, dims), np.inf), np.full((n_cells, dims), np.inf), np.zeros(n_cells, int)
    for r in rows:
        lo[r["cell"]], hi[r["cell"]], n[r["cell"]] = r["lo"], r["hi"], r["n"]
    return lo, hi, n


# ---------------------------------------------------------------- block kernel

def _block_best(q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray):
    """Row numbers (query, point) and distances of the k best points per query.

    ``bound``: a distance known to hold k points already (infinite if unknown). Points come
    sorted by id, so a smaller row number is a smaller id. Candidates are picked from
    |q|^2 + |p|^2 - 2qp, widened by its error and by the rounding step; the distances that
    are compared and returned are then computed directly, dimension by dimension.
    """
    qi, pi, dd = [], [], []
    p_norm, p_t = (p * p).sum(axis=1), np.ascontiguousarray(p.T)
    step = max(1, _MATRIX_CELLS // max(1, len(p)))
    for s in range(0, len(q), step):
        block, reach = q[s:s + step], bound[s:s + step]
        q_norm = (block * block).sum(axis=1)
        near = block @ p_t
        near *= -2.0
        near += q_norm[:, None]
        near += p_norm[None, :]
        limit = reach * reach
        if np.isinf(limit).any() and len(p) > k:
            kth = np.partition(near, k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, np.maximum(kth, 0.0))
        error = 1e-12 * (q_norm + p_norm.max())
        limit = limit + error + 4.0 * _STEP * (np.sqrt(np.where(np.isinf(limit), 0.0, limit) + error) + _STEP)
        r, c = np.nonzero(near <= limit[:, None])
        sq = np.zeros(len(r))
        for j in range(p.shape[1]):
            diff = block[r, j] - p[c, j]
            sq += diff * diff
        v = np.round(np.sqrt(sq), DECIMALS)
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        qi.append(r[keep] + s), pi.append(c[keep]), dd.append(v[keep])
    return np.concatenate(qi), np.concatenate(pi), np.concatenate(dd)


def _merge(best_d, best_p, rows, found, d) -> np.ndarray:
    """Put new (row, point, distance) entries among the k best of their rows; the rows touched."""
    touched, k = np.unique(rows), best_d.shape[1]
    r = np.concatenate((np.repeat(touched, k), rows))
    v = np.concatenate((best_d[touched].ravel(), d))
    c = np.concatenate((best_p[touched].ravel(), found))
    order = np.lexsort((c, v, r))
    r, v, c = r[order], v[order], c[order]
    at = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    keep = at < k
    best_d[r[keep], at[keep]], best_p[r[keep], at[keep]] = v[keep], c[keep]
    return touched


def _group_best(q: np.ndarray, home: np.ndarray, bound: np.ndarray, p: np.ndarray, cells: np.ndarray, k: int):
    """As ``_block_best``, over the points of several cells. ``home``: the cell a query starts in (-1: none).

    A cell is skipped for a query if its box is farther than the k-th distance known so far.
    """
    order = np.argsort(cells, kind="stable")  # by cell, then by id
    names, start = np.unique(cells[order], return_index=True)
    members = np.split(order, start[1:])
    lo, hi = np.minimum.reduceat(p[order], start, axis=0), np.maximum.reduceat(p[order], start, axis=0)
    bound, best_d = bound.copy(), np.full((len(q), k), np.inf)
    best_p = np.full((len(q), k), len(p), dtype=np.int64)

    def visit(c, rows):
        qi, pi, d = _block_best(q[rows], p[members[c]], k, bound[rows])
        if len(qi):
            touched = _merge(best_d, best_p, rows[qi], members[c][pi], d)
            bound[touched] = np.minimum(bound[touched], best_d[touched, -1])

    at = np.searchsorted(names, home).clip(0, len(names) - 1)
    at[names[at] != home] = -1
    by_home = np.argsort(at, kind="stable")
    for rows in np.split(by_home, np.flatnonzero(np.diff(at[by_home])) + 1):
        if at[rows[0]] >= 0:
            visit(at[rows[0]], rows)
    gap = np.empty((len(q), len(names)))
    step = max(1, _MATRIX_CELLS // (len(names) * q.shape[1]))
    for s in range(0, len(q), step):
        b = q[s:s + step, None]
        out = np.maximum(np.maximum(lo[None] - b, b - hi[None]), 0.0)
        gap[s:s + step] = np.sqrt((out * out).sum(axis=2))
    gap[np.flatnonzero(at >= 0), at[at >= 0]] = np.nan  # been there
    for c in range(len(names)):
        rows = np.flatnonzero(gap[:, c] <= bound + 2.0 * _STEP)
        if len(rows):
            visit(c, rows)
    qi, slot = np.nonzero(best_p < len(p))
    return qi, best_p[qi, slot], best_d[qi, slot]


def _block_join(queries: DataFrame, points: DataFrame, point_counts, query_counts, k: int) -> DataFrame:
    """k best points per (query, block): queries and points meet on (group, slices)."""
    # blocks are small in bytes and heavy in work, so partitions must not be merged by size
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # some blocks a core; more would only send the points more often
    blocks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    most = min(BLOCK_ROWS, max(UNIT_QUERIES, sum(query_counts.values()) // blocks))
    q_slices = {g: -(-n // most) for g, n in query_counts.items()}
    p_slices = {g: -(-int(n) // BLOCK_ROWS) for g, n in enumerate(point_counts)}

    def with_slices(df):
        for name, table in (("_q", q_slices), ("_p", p_slices)):
            big = [(int(g), int(n)) for g, n in table.items() if n > 1]
            if big:  # at most MAX_CELLS rows
                look = df.sparkSession.createDataFrame(big, f"group int, {name} int")
                df = df.join(F.broadcast(look), "group", "left").withColumn(name, F.coalesce(name, F.lit(1)))
            else:
                df = df.withColumn(name, F.lit(1))
        return df

    def own(n):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = with_slices(queries).select("id", "vec", "bound", "home", "group", own("_q").alias("qs"), every("_p").alias("ps"))
    p = with_slices(points).select("id", "vec", "label", "cell", "group", own("_p").alias("ps"), every("_q").alias("qs"))
    keys = ("group", "ps", "qs")
    q, p = q.repartition(n, *keys), p.repartition(n, *keys)
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType),
                           T.StructField("neighbor_id", points.schema["id"].dataType),
                           T.StructField("distance", T.DoubleType()),
                           T.StructField("label", points.schema["label"].dataType)])

    def best(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in schema})
        right = right.sort_values("id", kind="stable").reset_index(drop=True)
        ids = right["id"].to_numpy()
        bound = left["bound"].fillna(np.inf).to_numpy(dtype=float)
        qi, pi, d = _group_best(_matrix(left["vec"]), left["home"].to_numpy(), bound, _matrix(right["vec"]),
                                right["cell"].to_numpy(), k)
        return pd.DataFrame({"query_id": left["id"].to_numpy()[qi], "neighbor_id": ids[pi], "distance": d,
                             "label": right["label"].to_numpy()[pi]})

    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(best, schema)


def _groups(n_points: np.ndarray, most: int) -> np.ndarray:
    """Group of every cell: neighbouring leaves of the split, up to ``most`` points together."""
    out, group, held = np.zeros(len(n_points), int), 0, 0
    for c, n in enumerate(n_points):
        if held and held + n > most:
            group, held = group + 1, 0
        out[c], held = group, held + n
    return out


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- the join

def nearest_neighbors(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False,
                      cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance, label): the k nearest points of every query.

    Inputs: ``id``, ``vec`` ARRAY<DOUBLE> and, for points, an optional ``label``. Distances
    are Euclidean, rounded to 6 decimals; ties go to the smaller id. ``exclude_self``: a
    query does not find the point with its own id (queries and points share ids).
    """
    among_themselves = queries is points
    if "label" not in points.columns:
        points = points.withColumn("label", F.lit(None).cast("double"))
    vec = F.col("vec").cast("array<double>")
    points, queries = points.withColumn("vec", vec), queries.withColumn("vec", vec)

    # fold copies: row_number <= k+1 is cut before the shuffle (window group limit)
    w = W.partitionBy("vec").orderBy("id")
    copies = durable(points.withColumn("_c", F.row_number().over(w)).filter(F.col("_c") <= k + 1)
                     .select("id", "vec", "label", "_c"))
    folded = copies.drop("_c")
    if among_themselves:  # the first copy asks for all
        asked = copies.filter(F.col("_c") == 1).select("id", "vec")
    else:
        asked = durable(queries.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    facts = folded.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not facts["n"]:
        raise ValueError("no points to search")
    n_cells = min(MAX_CELLS, max(1, facts["n"] // cell_rows))
    room = n_cells * SAMPLE_PER_CELL
    sample = np.zeros((0, facts["d"]))
    if n_cells > 1:  # a fixed share by id hash, so a retried task picks the same rows
        share = min(1.0, room / facts["n"])
        picked = folded.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = _matrix(picked.select("vec").toPandas()["vec"])
    cells = _Cells(sample, n_cells)
    points_c = durable(_with_cell(folded, cells))  # read by the box pass and both rounds
    asked_c = _with_cell(asked, cells)

    # With copies folded, a query's own id may stand behind another copy's: k+1 are kept
    # for each question and the own id is taken out per query at the end.
    kk = k + 1 if exclude_self else k
    lo, hi, n_points = _boxes(points_c, facts["d"], cells.n)
    group_of = _groups(n_points, min(BLOCK_ROWS, max(cell_rows, facts["n"] // GROUPS)))
    n_groups = int(group_of[-1]) + 1
    n_in = np.bincount(group_of, n_points, n_groups).astype(int)

    def grouped(df):
        if n_groups == 1:
            return df.withColumn("group", F.lit(0))
        look = df.sparkSession.createDataFrame([(c, int(g)) for c, g in enumerate(group_of)], "cell int, group int")
        return df.join(F.broadcast(look), "cell")  # at most MAX_CELLS rows

    def count_by_group(df):
        return {r["group"]: r["n"] for r in df.groupBy("group").agg(F.count("*").alias("n")).collect()}

    points_g, asked_g = grouped(points_c), grouped(asked_c).withColumnRenamed("cell", "home")
    n_queries = count_by_group(asked_g)
    unknown = F.lit(None).cast("double").alias("bound")
    near = _k_best(_block_join(asked_g.select("*", unknown), points_g, n_in, n_queries, kk), kk)

    if n_groups > 1:
        # one row per question: its vector, what it found at home, and the groups still to visit
        near = durable(near)
        found = near.groupBy("query_id").agg(F.count("*").alias("m"), F.max("distance").alias("far"))
        state = asked_g.join(found, F.col("id") == F.col("query_id"), "left").select(
            "id", "vec", "group",
            F.when(F.col("m") >= kk, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))
        live = [np.flatnonzero((group_of == g) & (n_points > 0)) for g in range(n_groups)]
        group_lo = np.stack([lo[c].min(axis=0) if len(c) else np.full(facts["d"], np.inf) for c in live])
        group_hi = np.stack([hi[c].max(axis=0) if len(c) else np.full(facts["d"], np.inf) for c in live])
        visit_schema = T.StructType([*state.schema.fields, T.StructField("groups", T.ArrayType(T.IntegerType()))])

        def visits(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x, home = _matrix(pdf["vec"]), pdf["group"].to_numpy()
                bound, reached = pdf["bound"].to_numpy(dtype=float), []
                for s in range(0, len(x), _VISIT_ROWS):
                    b = x[s:s + _VISIT_ROWS]
                    step = max(1, _MATRIX_CELLS // (len(b) * x.shape[1]))
                    reach = np.zeros((len(b), n_groups), bool)
                    for c in range(0, n_groups, step):  # a block of queries against a block of boxes
                        gap = np.maximum(np.maximum(group_lo[None, c:c + step] - b[:, None], b[:, None] - group_hi[None, c:c + step]), 0.0)
                        reach[:, c:c + step] = np.sqrt((gap * gap).sum(axis=2)) <= bound[s:s + _VISIT_ROWS, None] + 2.0 * _STEP
                    reach &= (n_in > 0)[None]
                    reach[np.arange(len(b)), home[s:s + _VISIT_ROWS]] = False
                    reached += [np.flatnonzero(r).astype("int32") for r in reach]
                yield pdf.assign(groups=reached)

        todo = durable(state.mapInPandas(visits, visit_schema).filter(F.size("groups") > 0))
        trips = todo.select("id", "vec", "bound", F.lit(-1).alias("home"), F.explode("groups").alias("group"))
        n_trips = count_by_group(trips.select("group"))
        if n_trips:
            more = _block_join(trips, points_g, n_in, n_trips, kk)
            near = _k_best(near.drop("rank").unionByName(more), kk)

    # give every copy of a question its answer (at most k+1 entries each)
    packed = near.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbor_id", "label"))).alias("_near"))
    answers = asked.join(packed, F.col("id") == F.col("query_id")).select(F.col("vec").alias("_vec"), "_near")
    hits = F.col("_near")
    if exclude_self:
        hits = F.filter(hits, lambda h: h["neighbor_id"] != F.col("query_id"))
    # a hot vector is one row of `answers`; AQE splits its queries
    full = queries.select(F.col("id").alias("query_id"), "vec").join(answers, F.col("vec") == F.col("_vec"))
    return (full.select("query_id", F.posexplode(F.slice(hits, 1, k)).alias("_pos", "h"))
            .select("query_id", (F.col("_pos") + 1).alias("rank"), "h.neighbor_id", "h.distance", "h.label"))
