"""Boosted trees and stumps over blocks of binned rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from loanlab.operators import binned, boosting
from loanlab.operators import learners as ml
from loanlab.session import scratch_path
from loanlab.sources import results_store


def _rows(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 25, n), rng.integers(0, 2, n), rng.integers(0, 9, n)], axis=1).astype(float)
    y = ((x[:, 0] / 25 + 0.4 * x[:, 1] * (x[:, 2] > 4) + rng.normal(0, 0.2, n)) > 0.7).astype(float)
    rows = spark.createDataFrame([(i, float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))], ["id", "label", "features"])
    return rows, x, y


def plain_boosting(x, y, weight, rounds, depth, rate, min_leaf):
    """The same trees from loops over every value of the rows themselves."""
    sign, margin = 2 * y - 1, np.zeros(len(y))

    def grow(rows, r, left_depth, out):
        best = None
        if left_depth:
            w, s = weight[rows].sum(), (weight * r)[rows].sum()
            for f in range(x.shape[1]):
                for cut in sorted(set(x[rows, f]))[:-1]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(a), len(b)) < min_leaf:
                        continue
                    gain = sum((weight * r)[p].sum() ** 2 / weight[p].sum() for p in (a, b)) - s * s / w
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, a, b)
        if best is None:
            out[rows] = np.average(r[rows], weights=weight[rows])
        else:
            grow(best[1], r, left_depth - 1, out), grow(best[2], r, left_depth - 1, out)
    for t in range(rounds):
        r = sign if t == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), r, depth, step)
        margin += step if t == 0 else rate * step
    return 1 / (1 + np.exp(-2 * margin))


@pytest.mark.parametrize("name, min_leaf, balanced", [("Gradient Boosting", 1, False), ("XGBoost", 4, False), ("LightGBM", 20, True)])
def test_boosted_trees_equal_plain_loops(spark, monkeypatch, name, min_leaf, balanced):
    monkeypatch.setattr(binned, "BLOCK_ROWS", 64)
    monkeypatch.setattr(boosting, "STORED_EVERY", 2)
    monkeypatch.setattr(boosting, "PASS_CELLS", 3 * 25 * 2 * 9)  # one node a pass
    rows, x, y = _rows(spark)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    want = plain_boosting(x, y, w, 5, 3, 0.3, min_leaf)
    model = ml.fit_model(name, rows, "id", rounds=5, max_depth=3, rate=0.3)
    got = {r["id"]: r["score"] for r in ml.predict(name, model, rows, "id").collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-5) for i in range(len(y)))
    assert sum(model.importance()) == pytest.approx(1.0)


def test_boosted_trees_are_sparks(spark):
    rows, *_ = _rows(spark)
    spark_model = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.1, maxBins=32, seed=1).fit(rows)
    want = {r[0]: r[1][1] for r in spark_model.transform(rows).select("id", vector_to_array("probability")).collect()}
    model = ml.fit_model("Gradient Boosting", rows, "id", rounds=5, max_depth=3)
    got = {r["id"]: r["score"] for r in model.score(rows).collect()}
    assert np.mean([abs(got[i] - want[i]) < 1e-5 for i in want]) > 0.97  # cuts between values, not at them
    assert model.importance() == pytest.approx(list(spark_model.featureImportances.toArray()), abs=0.02)


def test_boosted_trees_ignore_partitions_and_are_stored(spark):
    rows, *_ = _rows(spark)
    a = ml.fit_model("XGBoost", rows.repartition(1), "id", rounds=4, max_depth=3, subsample=0.5)
    b = ml.fit_model("XGBoost", rows.repartition(7), "id", rounds=4, max_depth=3, subsample=0.5)
    assert np.array_equal(a.nodes["feature"], b.nodes["feature"]) and np.allclose(a.nodes["p"], b.nodes["p"], atol=1e-6)
    path = scratch_path(spark, "model")
    results_store.write_model(spark, a, path)
    again = results_store.load_model(spark, path)
    scores = [[r["score"] for r in m.score(rows).orderBy("id").collect()] for m in (a, again)]
    assert type(again) is type(a) and scores[0] == scores[1]


def test_boosted_trees_of_one_class(spark):
    rows, *_ = _rows(spark, 40)
    ones = rows.filter("label = 1")
    model = ml.fit_model("LightGBM", ones, "id", rounds=3)
    assert {r["prediction"] for r in model.score(ones).collect()} == {1}


def test_packed_sums_are_those_of_each_feature():
    rng = np.random.default_rng(1)
    cuts = [[0.5], [0.5, 1.5], [float(i) for i in range(200)], [], [0.5]]
    x = rng.integers(0, 3, (500, 5)).astype(float)
    x[:, 2] = rng.integers(0, 250, 500)
    packing, w = binned.Packing(cuts), rng.random(500)
    codes = packing.encode(x)
    assert len(packing.groups) < len(cuts) and sorted(f for g in packing.groups for f in g) == list(range(5))
    sums = np.concatenate([np.bincount(codes[g], w, s) for g, s in enumerate(packing.slots)])[:, None]
    for f, got in enumerate(packing.parts(packing.by_feature(sums))):
        want = np.bincount(np.searchsorted(cuts[f], x[:, f], "left"), w, len(cuts[f]) + 1)
        assert np.allclose(got[:, 0], want)


def test_rounds_read_few_full_blocks(spark):
    """The rows of a round are a few blocks, however many rows there are."""
    rows, x, _ = _rows(spark, 20_000)
    packing = binned.Packing([sorted(set(x[:, f]))[:-1] for f in range(3)])
    blocks = binned.store_blocks(rows.coalesce(2), "id", packing)
    assert blocks.count() <= 4
    assert sum(len(r["codes"]) for r in blocks.collect()) == 20_000 * 2 * len(packing.groups)


@pytest.mark.parametrize("name, options", [("XGBoost", {"subsample": 0.6}), ("LightGBM", {}), ("AdaBoost", {})])
def test_one_task_boosts_as_the_passes_do(spark, monkeypatch, name, options):
    """A table that one task has room for takes some jobs, not some for every round."""
    rows, *_ = _rows(spark, 600)
    sc, jobs, models = spark.sparkContext, [], []
    for most in (binned.LOCAL_ROWS, 0):
        monkeypatch.setattr(binned, "LOCAL_ROWS", most)
        sc.setJobGroup(f"{name} {most}", name)
        models.append(ml.fit_model(name, rows.repartition(3), "id", rounds=6, **options))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"{name} {most}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    here, passes = ({r["id"]: r["score"] for r in m.score(rows).collect()} for m in models)
    assert here == pytest.approx(passes, abs=1e-6)
    assert models[0].importance() == pytest.approx(models[1].importance(), abs=1e-9)
    monkeypatch.undo()
    sc.setJobGroup(f"{name} more", name)
    ml.fit_model(name, rows, "id", rounds=12, **options)
    more = len(sc.statusTracker().getJobIdsForGroup(f"{name} more"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert more <= jobs[0] + 2 < jobs[1]
