"""The distributed neighbour join against brute force, also with hot copies and many cells."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlab.operators import neighbors as nb
from loanlab.operators import resample as rs


def _points(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row], float(i % 2)) for i, row in enumerate(x)],
                                 "id bigint, vec array<double>, label double")


def _brute(q, p, k, exclude_self=False, start=0):
    out = {}
    for i, row in enumerate(q):
        d = np.round(np.sqrt(((p - row) ** 2).sum(axis=1)), 6)
        order = [j for j in np.lexsort((np.arange(len(p)), d)) if not (exclude_self and j == i)][:k]
        out[start + i] = [(int(j), float(d[j])) for j in order]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], round(r["distance"], 6)))
    return out


@pytest.mark.parametrize("cell_rows,block_rows", [(10_000, 65_536), (40, 65_536), (40, 13)])
def test_join_equals_brute_force(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(1)
    p = np.hstack([rng.normal(size=(400, 3)), rng.integers(0, 2, size=(400, 3))])
    q = np.hstack([rng.normal(size=(150, 3)), rng.integers(0, 2, size=(150, 3))])
    got = _got(nb.nearest_neighbors(_points(spark, q, 1000), _points(spark, p), 5, cell_rows=cell_rows))
    assert got == _brute(q, p, 5, start=1000)


@pytest.mark.parametrize("cell_rows", [10_000, 30])
def test_hot_copies_and_self_exclusion(spark, cell_rows):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(300, 3)).astype(float)  # many ties
    x[50:170] = [9.0, 9.0, 9.0]  # one point holds over a third of the rows
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 5, exclude_self=True, cell_rows=cell_rows))
    assert got == _brute(x, x, 5, exclude_self=True)


def test_fewer_points_than_k(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 5, exclude_self=True))
    assert got == _brute(x, x, 5, exclude_self=True)


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(120, 4))
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 4, exclude_self=True, cell_rows=25))
    assert got == _brute(x, x, 4, exclude_self=True)


def _class_rows(spark, majority, minority):
    rows = [(i, 0.0, [float(v) for v in r]) for i, r in enumerate(majority)]
    rows += [(len(majority) + i, 1.0, [float(v) for v in r]) for i, r in enumerate(minority)]
    return spark.createDataFrame(rows, "id bigint, label double, features array<double>")


def test_smote_between_two_points(spark):
    df = _class_rows(spark, np.zeros((6, 2)), np.array([[0.0, 0.0], [2.0, 4.0]]))
    with pytest.raises(ValueError, match="2 rows"):  # five neighbours need six rows
        rs.smote(df, "id")
    grown = rs.smote(df, "id", k=1)
    counts = {(r["label"], r["synthetic"]): r["count"] for r in grown.groupBy("label", "synthetic").count().collect()}
    assert counts == {(0.0, False): 6, (1.0, False): 2, (1.0, True): 4}
    for r in grown.filter("synthetic").collect():
        a, b = r["features"]
        assert 0.0 <= a <= 2.0 and b == pytest.approx(2 * a)


def test_smote_rows_lie_on_a_segment_to_a_near_neighbour(spark):
    rng = np.random.default_rng(4)
    minority = rng.normal(size=(40, 3))
    df = _class_rows(spark, rng.normal(size=(151, 3)), minority)
    grown = rs.smote(df, "id")
    new = [np.array(r["features"]) for r in grown.filter("synthetic").collect()]
    assert len(new) == 111 and grown.select("id").distinct().count() == 302
    near = _brute(minority, minority, 5, exclude_self=True)
    segments = [(minority[i], minority[j]) for i in near for j, _ in near[i]]
    for v in new:
        def gap(a, b):
            u = np.clip(np.dot(v - a, b - a) / np.dot(b - a, b - a), 0, 1)
            return np.linalg.norm(a + u * (b - a) - v)
        assert min(gap(a, b) for a, b in segments) < 1e-9


@pytest.mark.parametrize("ids", [lambda i: -i - 1, lambda i: (1 << 63) - 1 - i, lambda i: i - (1 << 63)])
def test_smote_ids_are_new_and_unique(spark, ids):
    rng = np.random.default_rng(5)
    rows = [(ids(i), float(i < 7), [float(v) for v in rng.normal(size=2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label double, features array<double>")
    grown = rs.smote(df, "id", k=3)
    assert grown.count() == grown.select("id").distinct().count() == 66


def test_smote_of_a_class_of_one_row(spark):
    df = _class_rows(spark, np.zeros((6, 2)), np.ones((1, 2)))
    with pytest.raises(ValueError, match="1 rows"):
        rs.rebalance(df, "id")


def test_smote_is_repeatable_and_keeps_vectors(spark, loans):
    from loanlab.operators.preprocess import fit_preprocessor
    from loanlab.roles import LOAN_ROLES
    rows = fit_preprocessor(loans, LOAN_ROLES).transform(loans)
    def once(frame):
        return {(r["app_id"], tuple(r["a"])) for r in rs.smote(frame, "app_id").filter("synthetic").select(
            "app_id", vector_to_array("features").alias("a")).collect()}
    assert once(rows.repartition(3)) == once(rows.repartition(11))
    assert rs.smote(rows, "app_id").schema["features"].dataType.typeName() == "vectorudt"


def test_equal_classes_are_left_alone(spark):
    df = _class_rows(spark, np.zeros((2, 1)), np.ones((2, 1)))
    assert rs.rebalance(df, "id", method="smote").count() == 4
    assert rs.rebalance(df, "id", method="none").count() == 4
    assert df.filter(F.col("label") == 1).count() == 2


def test_many_cells_and_few_rows_at_a_time(spark, monkeypatch):
    """Queries and boxes go in blocks; the block sizes must not show in the answer."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3))
    monkeypatch.setattr(nb, "_MATRIX_CELLS", 50)
    monkeypatch.setattr(nb, "_VISIT_ROWS", 7)
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 3, exclude_self=True, cell_rows=4))
    assert got == _brute(x, x, 3, exclude_self=True)


@pytest.mark.parametrize("groups", [1, 3])
def test_groups_of_cells_equal_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(nb, "GROUPS", groups)
    monkeypatch.setattr(nb, "UNIT_QUERIES", 20)
    rng = np.random.default_rng(13)
    x = np.hstack([rng.normal(size=(300, 4)), rng.integers(0, 2, size=(300, 2))])
    x[100:140] = x[60]
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 5, exclude_self=True, cell_rows=10))
    assert got == _brute(x, x, 5, exclude_self=True)


def test_a_query_is_sent_to_groups_and_not_to_cells(spark, monkeypatch):
    """Where every cell must be visited, a query goes out once for a group of cells."""
    sent, join = [], nb._block_join

    def counted(queries, points, point_counts, query_counts, k):
        sent.append(sum(query_counts.values()))
        return join(queries, points, point_counts, query_counts, k)
    monkeypatch.setattr(nb, "_block_join", counted)
    monkeypatch.setattr(nb, "GROUPS", 4)
    x = np.random.default_rng(14).normal(size=(320, 24))  # too many dimensions for boxes to help
    got = _got(nb.nearest_neighbors(_points(spark, x), _points(spark, x), 3, exclude_self=True, cell_rows=8))
    assert got == _brute(x, x, 3, exclude_self=True)
    assert sum(sent) <= 320 * 8  # 40 cells
