import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loanlab.operators import calibration as cal
from loanlab.operators import experiments as arms
from loanlab.operators import learners as ml
from loanlab.operators.reasons import contributions, reason_codes

SCHEMA = "model_name string, id long, label int, score double"


def invented(seed, n=400, levels=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(levels) / levels
        rows.append(("m", i, int(rng.random() < s * s), s))
    return rows + [("m", n, 1, None), ("m", n + 1, None, 0.3), ("m", n + 2, 0, float("nan")), ("one", 1, 1, 0.5), ("one", 2, 1, 0.7)]


def usable(rows, model="m"):
    return [(s, y) for m, _, y, s in rows if m == model and s is not None and y is not None and s == s]


@pytest.mark.parametrize("seed", [1, 2])
def test_separation_equals_plain_loops(spark, seed):
    rows = invented(seed)
    got = {r.model_name: r for r in cal.separation(spark.createDataFrame(rows, SCHEMA)).collect()}
    points = usable(rows)
    pos, neg = [s for s, y in points if y], [s for s, y in points if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    gaps = {t: abs(sum(s >= t for s in pos) / len(pos) - sum(s >= t for s in neg) / len(neg)) for t, _ in points}
    assert got["m"].gini == pytest.approx(2 * auc - 1) and got["m"].ks == pytest.approx(max(gaps.values()))
    assert got["m"].ks_threshold == max(t for t, g in gaps.items() if g > max(gaps.values()) - 1e-9)
    assert got["m"].brier == pytest.approx(np.mean([(s - y) ** 2 for s, y in points]))
    assert got["one"].gini is None and got["one"].ks is None and got["one"].brier == pytest.approx((0.25 + 0.09) / 2)


def test_calibration_holds_ties_together(spark):
    rows = [("m", i, i % 2, 0.1) for i in range(70)] + [("m", i, 1, 0.2 + i / 1000) for i in range(30)]
    got = {r.bin: r for r in cal.calibration(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {0, 7, 8, 9} and got[0].n == 70 and got[0].rate == 0.5 and got[0].gap == pytest.approx(0.4)
    assert sum(r.n for r in got.values()) == 100 and all(got[b].n == 10 for b in (7, 8, 9))


def brute_isotonic(points):
    """Largest of the least means over all stretches."""
    scores = sorted({s for s, _ in points})
    pos = np.array([sum(y for s, y in points if s == t) for t in scores], float)
    n = np.array([sum(1 for s, _ in points if s == t) for t in scores], float)
    k = len(scores)
    mean = [[pos[a:b + 1].sum() / n[a:b + 1].sum() if b >= a else 2.0 for b in range(k)] for a in range(k)]
    return {t: max(min(mean[a][i:]) for a in range(i + 1)) for i, t in enumerate(scores)}


@pytest.mark.parametrize("seed, levels", [(3, 60), (4, 8), (5, 200)])
def test_isotonic_equals_brute_force(spark, seed, levels):
    rows = invented(seed, 500, levels)
    got = [r for r in cal.isotonic(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect() if r.model_name == "m"]
    want = brute_isotonic(usable(rows))
    for t, rate in want.items():
        block, = [r for r in got if r.low <= t <= r.high]
        assert block.rate == pytest.approx(rate)
    rates = [r.rate for r in sorted(got, key=lambda r: r.low)]
    assert all(a < b for a, b in zip(rates, rates[1:])) and sum(r.n for r in got) == len(usable(rows))


def test_isotonic_of_falling_rates_is_one_block(spark):
    rows = [("m", i, int(i < 300), i / 1000) for i in range(1000)]
    got = cal.isotonic(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.low, r.high, r.n, r.rate) for r in got] == [(0.0, 0.999, 1000, 0.3)]


def test_best_thresholds_equal_plain_loops(spark):
    rows = invented(6)
    worth = {"tp": 1.0, "fp": -2.0, "fn": -6.0, "tn": 0.5}
    got = {(r.model_name, r.objective): r for r in cal.best_thresholds(spark.createDataFrame(rows, SCHEMA), **worth).collect()}
    points = usable(rows)

    def value(t, goal):
        tp, fp = sum(y for s, y in points if s >= t), sum(1 - y for s, y in points if s >= t)
        fn, tn = sum(y for s, y in points if s < t), sum(1 - y for s, y in points if s < t)
        return {"profit": tp - 2.0 * fp - 6.0 * fn + 0.5 * tn, "f1": 2 * tp / (2 * tp + fp + fn),
                "youden": tp / (tp + fn) - fp / (fp + tn)}[goal]
    for goal in ("profit", "f1", "youden"):
        values = {t: value(t, goal) for t in {s for s, _ in points} | {math.inf}}
        top = max(values.values())
        r = got["m", goal]
        assert r.value == pytest.approx(top) and r.threshold == max(t for t, v in values.items() if v > top - 1e-9)
        assert r.approval_rate == pytest.approx(sum(s < r.threshold for s, _ in points) / len(points))
    assert ("one", "youden") not in got and got["one", "f1"].value == 1.0


def test_expected_loss(spark):
    rows = spark.createDataFrame([("a", 0.1, 100, 0), ("a", 0.2, 50, 1), ("a", 0.9, 10, 1), ("b", 0.8, 5, 0)],
                                 "g string, score double, amount int, label int")
    got = {r.g: r for r in cal.expected_loss(rows, ["g"], "amount", 0.5).collect()}
    assert (got["a"].n, got["a"].n_approved, got["a"].exposure) == (3, 2, 150.0)
    assert got["a"].expected_loss == pytest.approx(10.0) and got["a"].realised_loss == 25.0
    assert (got["b"].n_approved, got["b"].expected_loss, got["b"].approval_rate) == (0, 0.0, 0.0)


def test_empty_predictions(spark):
    none = spark.createDataFrame([], SCHEMA)
    for found in (cal.separation(none), cal.calibration(none), cal.isotonic(none), cal.best_thresholds(none)):
        assert found.count() == 0


# ---------------------------------------------------------------- arms

def test_arms_are_stable_and_grow(spark):
    ids = spark.range(20_000).withColumn("small", arms.arm("id", 0.1)).withColumn("large", arms.arm("id", 0.3))
    ids = ids.withColumn("again", arms.arm("id", 0.1)).withColumn("other", arms.arm("id", 0.1, "second"))
    n = {r.small: r["count"] for r in ids.groupBy("small").count().collect()}
    assert abs(n["challenger"] / 20_000 - 0.1) < 0.01
    assert ids.where("small = 'challenger' AND large <> 'challenger'").count() == 0 == ids.where("small <> again").count()
    assert ids.where("small = 'challenger' AND other = 'challenger'").count() < 400
    assert {r.a for r in spark.range(50).select(arms.arm("id", 0.0).alias("a")).collect()} == {"champion"}
    with pytest.raises(ValueError):
        arms.arm("id", 1.5)


def test_welch_statistic(spark):
    a, b = [1.0, 2.0, 4.0, 4.0], [5.0, 7.0, 9.0]
    rows = [("champion", v) for v in a] + [("challenger", v) for v in b] + [("champion", None)]
    r, = arms.compare(spark.createDataFrame(rows, "model_name string, v double"), {"v": F.col("v")}).collect()
    want = (np.mean(b) - np.mean(a)) / math.sqrt(np.var(a, ddof=1) / 4 + np.var(b, ddof=1) / 3)
    assert r.statistic == pytest.approx(want) and r.significant and (r.n_champion, r.n_challenger) == (4, 3)
    lone = arms.compare(spark.createDataFrame(rows[:4], "model_name string, v double"), {"v": F.col("v")}).first()
    assert lone.statistic is None and lone.significant is None


# ---------------------------------------------------------------- reasons

def test_reasons_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [(i, Vectors.dense(rng.normal(i % 2, 1, 4)), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    for name in ("Naive Bayes", "Logistic Regression"):
        model = ml.fit_model(name, df, "id")
        full = {r.id: r for r in reason_codes(model, df, "id", list("abcd"), top=4).collect()}
        against = {r.id: r for r in reason_codes(model, df, "id", list("abcd"), top=4, toward=0).collect()}
        scores = {r.id: r.score for r in ml.predict(name, model, df, "id").collect()}
        assert len(full) == 200
        base, _ = contributions(model)
        for i, r in full.items():
            assert r.score == pytest.approx(scores[i], abs=1e-9)
            weights = [c.contribution for c in r.reasons]
            assert weights == sorted(weights, reverse=True) and all(w > 0 for w in weights)
            others = [c.contribution for c in against[i].reasons]
            assert r.margin == pytest.approx(base + sum(weights) + sum(others))
        short = reason_codes(model, df, "id", list("abcd"), top=2)
        assert all(len(r.reasons) <= 2 for r in short.collect())
    assert reason_codes(model, df.limit(0), "id", list("abcd")).count() == 0
    with pytest.raises(ValueError):
        contributions(ml.fit_model("Decision Tree", df, "id"))
