"""The grid of logistic regressions over folds, and the one-pass evaluation."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from loanlab.operators import evaluate as ev
from loanlab.operators import learners as ml
from loanlab.operators import logistic
from loanlab.operators.resample import kfold


def _rows(spark, n=900, seed=5, flip=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = x[:, 2]  # the same feature twice
    y = ((x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, flip, n)) > 0.6).astype(float)
    return spark.createDataFrame([(i, float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))],
                                 ["id", "label", "features"])


def test_grid_fits_are_the_single_fits(spark):
    rows = _rows(spark)
    folded = kfold(rows, "id", k=3).persist()
    sets = [{"c": 0.01, "l1_ratio": 0.0}, {"c": 0.1, "l1_ratio": 1.0}, {"c": 10, "l1_ratio": 1.0}, {"c": 1, "l1_ratio": 0.3}]
    blocks = logistic.store_rows(folded, 4)
    coefficients = logistic.fit_folds(blocks, 4, 3, sets)
    assert len(coefficients) == 12
    for n, options in enumerate(sets):
        for i in range(3):
            one = ml.fit_logistic_regression(folded.filter(f"fold <> {i}").drop("fold"), "id", **options)
            want = [*one.model.coefficients.toArray(), one.model.intercept]
            mine = coefficients[n * 3 + i]
            assert mine[:2] == pytest.approx(want[:2], abs=5e-3) and mine[-1] == pytest.approx(want[-1], abs=5e-3)
            assert mine[2] + mine[3] == pytest.approx(want[2] + want[3], abs=5e-3)
    scored = logistic.scored(blocks, 4, 3, coefficients)
    assert scored.count() == 900 * len(sets) and scored.select("model_name").distinct().count() == 12


def test_grid_takes_few_jobs(spark):
    """A pass serves every setting and fold: the number of jobs does not grow with them."""
    sc = spark.sparkContext
    sc.setJobGroup("grid", "grid")
    got = ml.tune("Logistic Regression", _rows(spark), "id", k=3, parallelism=2)
    n = got.count()
    jobs = len(sc.statusTracker().getJobIdsForGroup("grid"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert n == 8 * 3 * len(ev.METRICS) and jobs < 120
    assert got.filter("value IS NULL OR value NOT BETWEEN 0 AND 1").count() == 0


def test_grid_of_separable_and_one_class_rows(spark):
    apart = _rows(spark, 200, flip=0.0)
    got = ml.tune("Logistic Regression", apart, "id", k=2)
    best = got.filter("metric = 'roc_auc' AND setting LIKE 'c=10,%'").collect()
    assert len(best) == 4 and min(r["value"] for r in best) > 0.9
    ones = ml.tune("Logistic Regression", apart.filter("label = 1"), "id", k=2, sets=[{"c": 1.0}])
    assert {r["value"] for r in ones.filter("metric = 'recall'").collect()} == {1.0}


def test_evaluation_in_ranges(spark):
    """Ties across batches and ranges, rows without score, several models."""
    rng = np.random.default_rng(2)
    rows = [(f"m{i % 3}", i, int(rng.random() < 0.4), None if i % 17 == 0 else float(rng.integers(0, 40)) / 40, int(rng.random() < 0.5))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "model_name string, id int, label int, score double, prediction int").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["model_name"]: r for r in ev.evaluate(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for name in ("m0", "m1", "m2"):
        mine = [r for r in rows if r[0] == name]
        pos, neg = ([r[3] for r in mine if r[2] == c and r[3] is not None] for c in (1, 0))
        auc = np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])
        tp, fp = (sum(r[2] == c and r[4] == 1 for r in mine) for c in (1, 0))
        assert got[name]["roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert got[name]["precision"] == pytest.approx(tp / (tp + fp))
        assert got[name]["accuracy"] == pytest.approx(np.mean([r[2] == r[4] for r in mine]))


def test_tasks_are_given_few_blocks(spark, monkeypatch):
    """A worker gets the blocks of a partition at once: more rows are more partitions, not larger ones."""
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 10)
    monkeypatch.setattr(logistic, "TASK_BLOCKS", 2)
    blocks = logistic.store_rows(kfold(_rows(spark), "id", k=3), 4)
    held = blocks.rdd.glom().map(len).collect()
    assert sum(held) >= 90 and len(held) >= 45 and max(held) <= 12
    assert blocks.storageLevel.useDisk and not blocks.storageLevel.useMemory
    blocks.unpersist()


def test_folds_are_fitted_in_shared_passes(spark):
    """Cross-validated logistic regressions: more folds are not more jobs, and the values are those of single fits."""
    sc, jobs, rows = spark.sparkContext, [], _rows(spark).persist()
    for k in (2, 6):
        sc.setJobGroup(f"folds {k}", "folds")
        got = {(r["fold"], r["metric"]): r["value"] for r in ml.cross_validate("Logistic Regression", rows, "id", k=k).collect()}
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"folds {k}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 6 * len(ev.METRICS) and jobs[1] <= jobs[0] + 10
    folded = kfold(rows, "id", k=6)
    for i in (0, 5):
        one = ml.fit_model("Logistic Regression", folded.filter(f"fold <> {i}").drop("fold"), "id")
        want = ev.evaluate(ml.predict("LR", one, folded.filter(f"fold = {i}").drop("fold"), "id")).first()
        assert got[i, "roc_auc"] == pytest.approx(want["roc_auc"], abs=5e-3)
        assert got[i, "accuracy"] == pytest.approx(want["accuracy"], abs=0.02)
