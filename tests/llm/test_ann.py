import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlab.llm import ann, catalog


def plain_nearest(ids, vectors, query_ids, k):
    out = {}
    for q in query_ids:
        mine = vectors[ids.index(q)]
        scored = sorted(((-float(np.dot(mine, v)), i) for i, v in zip(ids, vectors) if i != q))
        out[q] = scored[:k]
    return out


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = catalog.op9(spark, sf).toPandas()
    queries = ids[ids % 20 == 0]
    assert len(got) == 20 * len(queries)
    place = {v: i for i, v in enumerate(ids)}
    found = 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        exact = x @ x[place[q]]
        exact[place[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -exact))[:20]])
        found += len(best & set(part.vec_id))
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, exact[[place[v] for v in part.vec_id]], rtol=0, atol=1e-12)
        assert all((a, -i) >= (b, -j) for a, i, b, j in zip(part.score, part.vec_id, part.score[1:], part.vec_id[1:]))
    assert found / (20 * len(queries)) >= 0.9


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 90)]
    rows += [(i, [2.0, 2.0, 2.0]) for i in range(100, 180)]                     # many copies
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]),
             (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (206, [])]
    rows += [(40, [5.0, 1.0, 1.0])]                                             # a repeated row
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    got = {}
    for r in ann.nearest(frame, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    valid = {i: v for i, v in rows if i is not None and i < 200}
    ids = sorted(valid)
    expected = plain_nearest(ids, [np.array(valid[i], dtype=np.float64) for i in ids], [i for i in ids if i % 20 == 0], 20)
    assert got == expected  # so few vectors that every candidate is looked at


def test_repeated_rows_hide_no_copies(spark):
    """Copies whose rows occur twice, and one id repeated often: each class still gives its k + 1 smallest ids."""
    rows = [(i, [2.0, 2.0, 2.0]) for i in range(100, 140)] * 2
    rows += [(300, [-1.0, 3.0, 0.0])] * 30 + [(i, [-1.0, 3.0, 0.0]) for i in range(301, 320)]
    rows += [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    valid = dict(rows)
    ids = sorted(valid)
    expected = plain_nearest(ids, [np.array(valid[i]) for i in ids], [i for i in ids if i % 20 == 0], 20)
    assert got == expected  # every candidate is looked at


def test_every_vector_length_is_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(1, 50, 3 if i <= 120 else 2).astype(float).tolist()) for i in range(1, 201)]
    rows += [(140, [9.0, 9.0, 1.0])]  # one id in both lengths
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    assert sorted(got) == list(range(20, 201, 20))
    for q, found in got.items():
        best = {}
        for _, mine in (r for r in rows if r[0] == q):
            for i, v in rows:
                if i != q and len(v) == len(mine):
                    best[i] = max(best.get(i, -np.inf), float(np.dot(mine, v)))
        expected = sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:10]
        assert found == [(s, i, n) for n, (s, i) in enumerate(expected, 1)]


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 0.5), (20, 2, 2, -1.0)]
    for none in (frame.limit(0), frame.where("vec_id = 20")):
        assert ann.nearest(none, F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("slices", [64, 4096])
def test_dense_units_are_sliced_and_descended(spark, slices):
    """Vectors in one tight cone: all share the longest counted prefix, so the sorted arrays decide."""
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.03 * rng.normal(size=(300, 8)) for c in rng.normal(size=(4, 8))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("id") % 20 == 0, k=5, share=0.0, min_hits=2_000, top=4, slice_rows=slices).toPandas()
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    hit = [len(set(p.vec_id) & set(np.argsort(-exact[q])[:5])) for q, p in got.groupby("query_id")]
    assert len(got) == 60 * 5 and np.mean(hit) / 5 >= 0.9
