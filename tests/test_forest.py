"""The forest: equal for every way of sharing the work out, equal to plain recursion, and kept whole in storage."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanlab.operators import forest
from loanlab.operators import learners as ml
from loanlab.sources.results_store import load_model, write_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 900) > 0.4).astype(int)
    table = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(table, "id long, x array<double>, label double").repartition(5)
    return df.select("id", array_to_vector("x").alias("features"), "label").persist()


def scores(model, rows):
    return {r.id: r.score for r in model.score(rows).collect()}


def grown(rows, local_rows, **options):
    cuts = ml._cuts(rows, 4, 32)
    return forest.fit(rows, "id", {0: rows.where("label = 0").count(), 1: rows.where("label = 1").count()}, cuts,
                      options.get("trees", 6), options.get("depth", 7), options.get("leaf", 2), 42, local_rows)


def test_the_same_forest_whoever_grows_it(rows):
    local, shared, partly = grown(rows, 10_000), grown(rows, 0), grown(rows, 150)
    for other in (shared, partly):
        assert scores(other, rows) == pytest.approx(scores(local, rows), abs=1e-6)
        assert other.importances == pytest.approx(local.importances)
        assert len(other.nodes["p"]) == len(local.nodes["p"])
    assert sum(local.importances) == pytest.approx(1)
    assert len(grown(rows, 10_000, depth=0).nodes["p"]) == 6 == len(grown(rows, 0, depth=0).nodes["p"])


def test_a_tree_equals_plain_recursion():
    rng = np.random.default_rng(1)
    codes, y = rng.integers(0, 6, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300)
    times, weights = rng.integers(1, 4, 300), np.array([0.7, 1.9])
    g = forest.Growth(3, 6, 2, weights, 5, 3, 42)

    def gini(here):
        w = [(times[here] * (y[here] == c)).sum() * weights[c] for c in (0, 1)]
        return (w[0] ** 2 + w[1] ** 2) / sum(w), w[1] / sum(w)

    def plain(node, here, out):
        best, (before, p) = None, gini(here)
        if node.bit_length() <= 5:
            for f in forest._features(np.array([node]), 3, 2, 42, 0)[0]:
                for cut in range(6):
                    left, right = here[codes[here, f] <= cut], here[codes[here, f] > cut]
                    if min(times[left].sum(), times[right].sum()) >= 3:
                        gain = gini(left)[0] + gini(right)[0] - before
                        if gain > before * 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left, right)
        if best is None:
            out[here] = p
        else:
            plain(2 * node, best[1], out), plain(2 * node + 1, best[2], out)
    expected = np.zeros(300)
    plain(1, np.arange(300), expected)
    made = g.grow(0, 1, codes, y, times.astype(float))
    at = np.zeros(300, int)
    for _ in range(5):
        f = made["feature"][at]
        over = codes[np.arange(300), f] > made["code"][at]
        at = np.where(f >= 0, np.where(over, made["right"][at], made["left"][at]), at)
    assert made["p"][at] == pytest.approx(expected, abs=1e-6) and made["gains"].sum() > 0


def test_a_sample_draws_each_row_once_on_average():
    times = forest._drawn(np.arange(100_000, dtype=np.uint64), 42, 3)
    assert times.mean() == pytest.approx(1, abs=0.02) and times.var() == pytest.approx(1, abs=0.03)


def test_the_driver_gets_arrays_and_storage_keeps_them(spark, rows, tmp_path):
    """Spark's own forest kept every node as objects on the driver, which had no room for them."""
    model = ml.fit_model("Random Forest", rows, "id", num_trees=5, max_depth=6)
    assert sum(v.nbytes for v in model.nodes.values()) == 15 * len(model.nodes["p"])
    write_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert scores(again, rows) == scores(model, rows) and again.importances == model.importances
    got = model.score(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.min("score"),
                                F.max("score")).first()
    assert got[0] > 0.85 and 0 <= got[1] and got[2] <= 1


def test_odd_tables(spark, rows):
    few = rows.where("id < 3").withColumn("id", F.lit(None).cast("long"))
    model = ml.fit_model("Random Forest", few, "id", num_trees=4, max_depth=3)
    assert all(0 <= v <= 1 for v in scores(model, rows).values())
    one = ml.fit_model("Random Forest", rows.where("label = 1"), "id", num_trees=4, max_depth=3)
    assert set(scores(one, rows).values()) == {1.0}


def test_counts_of_a_wide_level_are_not_held_together(monkeypatch):
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 30, (3_000, 5)).astype(np.uint8), rng.integers(0, 2, 3_000)
    times = rng.integers(1, 4, 3_000).astype(float)
    g, most, splits = forest.Growth(5, 30, 3, np.array([1.0, 1.5]), 12, 1, 42), [], forest._splits

    def seen(counts, *rest):
        most.append(len(counts))
        return splits(counts, *rest)
    monkeypatch.setattr(forest, "_splits", seen)
    whole = g.grow(3, 1, codes, y, times)
    assert max(most) > 100
    most.clear()
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 16)
    parts = g.grow(3, 1, codes, y, times)
    assert max(most) <= 16 and all(np.array_equal(whole[k], parts[k]) for k in whole)
