"""Learners, training, storage, batch job, streaming transform."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loanlab import fixed_values as fv
from loanlab.operators import evaluate as ev
from loanlab.operators import learners as ml
from loanlab.plans import learn_queries, registry
from loanlab.plans.model_run import ModelRun
from loanlab.plans.prepare_job import NotFitted, Preprocessor, prepare
from loanlab.plans.train_job import run_batch_job
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import scratch_path
from loanlab.sources import prepared_store, results_store
from loanlab.streaming.transform_stream import transform_stream


@pytest.fixture(scope="module")
def data(spark, loans):
    ready = prepare(loans, R, imbalance="none")
    rows = ready.rows.persist()
    return (rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), ready.names)


SMALL = {"Random Forest": {"num_trees": 10, "max_depth": 6}, "Gradient Boosting": {"rounds": 5},
         "XGBoost": {"rounds": 5}, "LightGBM": {"rounds": 5}, "AdaBoost": {"rounds": 12}}


@pytest.mark.parametrize("name", fv.MODEL_NAMES)
def test_learner(data, name):
    train, test, names = data
    m = ml.train_model(name, train, test, R.id, names, **SMALL.get(name, {}))
    assert m.metrics["roc_auc"] > 0.85 and m.train_seconds > 0
    assert m.predictions.count() == test.count()
    assert m.predictions.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    has = name not in ("K-Nearest Neighbors", "Naive Bayes")
    assert (m.importance is not None) == has
    if has:
        assert [f for f, _ in m.importance] == list(names)


def test_registry_order():
    assert tuple(ml.REGISTRY) == fv.MODEL_NAMES


@pytest.mark.parametrize("key", ["m3_random_forest", "m4_gradient_boosting", "m5_regularised_boosting",
                                 "m6_histogram_boosting", "m9_adaboost"])
def test_registered_learners_run_with_the_defaults(monkeypatch, key):
    asked = {}
    monkeypatch.setattr(learn_queries, "train_test", lambda spark, sf: (None, None, []))
    monkeypatch.setattr(learn_queries, "_facts", lambda models: models)
    monkeypatch.setattr(ml, "train_model", lambda name, *_, **options: asked.update({name: options}))
    registry.QUERIES[key](None, None)
    assert list(asked.values()) == [{}]


def test_unknown_model(data):
    with pytest.raises(ml.UnknownModel):
        ml.train_model("Nope", data[0], data[1], R.id)
    with pytest.raises(ml.UnknownModel):
        ml.cross_validate("Nope", data[0], R.id)


def test_naive_bayes_against_numpy(data):
    train, test, _ = data
    def arrays(df):
        rows = df.select("label", vector_to_array("features").alias("x"), R.id).orderBy(R.id).collect()
        return np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    x, y = arrays(train)
    t, _ = arrays(test)
    eps, logs = 1e-9 * x.var(axis=0).max(), []
    for c in (0, 1):
        m, v = x[y == c].mean(axis=0), x[y == c].var(axis=0) + eps
        logs.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * v) + (t - m) ** 2 / v).sum(axis=1))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], None, 700)))
    model = ml.fit_model("Naive Bayes", train, R.id)
    got = [r["score"] for r in ml.predict("nb", model, test, R.id).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_adaboost_weights_follow_the_margin(data):
    """Boosted rounds change the stumps, and the score is the sigmoid of their mean log odds."""
    train, test, _ = data
    model = ml.fit_adaboost(train, R.id, rounds=8)
    assert len({(f, t) for f, t, _, _ in model.stumps}) > 1
    assert sum(model.importances) == pytest.approx(1.0)
    row = test.limit(1).withColumn("x", vector_to_array("features")).first()
    logits = [ml.StumpsModel.logit(a if row["x"][f] <= t else b) for f, t, a, b in model.stumps]
    got = model.score(test.filter(F.col(R.id) == row[R.id])).first()["score"]
    assert got == pytest.approx(1 / (1 + np.exp(-np.mean(logits))))


def test_logistic_regression_solves_the_summed_penalised_loss(data):
    """The gradient of 0.5|w|^2 + C sum w_i loss_i vanishes at the fitted coefficients."""
    train, _, _ = data
    m = ml.fit_model("Logistic Regression", train, R.id).model
    rows = train.select("label", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    gradient = m.coefficients.toArray() + x.T @ (w * (p - y))
    assert np.abs(gradient).max() < 1e-2 * len(y) ** 0.5


def test_cross_validation_shape(data):
    cv = ml.cross_validate("Naive Bayes", data[0], R.id, k=3)
    assert cv.count() == 15 and cv.filter("value IS NULL").count() == 0


def test_grids():
    assert len(ml.grid_options("Logistic Regression")) == 8
    assert len(ml.grid_options("Random Forest")) == 12
    assert len(ml.grid_options("XGBoost")) == 24
    assert len(ml.grid_options("LightGBM")) == 12
    assert all(o["max_depth"] > 0 for o in ml.grid_options("LightGBM"))


def test_tune(data):
    got = ml.tune("Naive Bayes", data[0], R.id, k=2, sets=[{"smoothing": 1e-9}, {"smoothing": 1e-3}])
    assert got.count() == 2 * 2 * len(ev.METRICS)


# ---------------------------------------------------------------- storage

@pytest.mark.parametrize("name", ["Decision Tree", "K-Nearest Neighbors", "Naive Bayes", "AdaBoost"])
def test_saved_model_scores_alike(spark, data, name):
    train, test, _ = data
    model = ml.fit_model(name, train, R.id, **SMALL.get(name, {}))
    path = scratch_path(spark, "model")
    results_store.write_model(spark, model, path)
    again = results_store.load_model(spark, path)
    def score(m):
        return {r["id"]: r["score"] for r in ml.predict(name, m, test, R.id).collect()}
    assert score(model) == score(again)
    assert again.importance() == model.importance()


def test_saving_needs_results(spark):
    with pytest.raises(ValueError):
        results_store.save_model(spark, {}, "Decision Tree")
    with pytest.raises(ValueError):
        results_store.save_results(spark, {}, [])


def test_absent_results(spark):
    path = scratch_path(spark, "none")
    assert not results_store.results_exist(spark, path) and results_store.load_results(spark, path) is None
    assert prepared_store.load_prepared(spark, path) is None


def test_model_slug():
    assert results_store.model_slug("K-Nearest Neighbors") == "k-nearest_neighbors"


def test_batch_job(spark, loans):
    out = scratch_path(spark, "job")
    report = run_batch_job(spark, loans, out, names=["Naive Bayes", "Decision Tree", "Nope"])
    assert set(report.run.models) == {"Naive Bayes", "Decision Tree"} and set(report.run.failed) == {"Nope"}
    back = results_store.load_results(spark, report.results_path)
    assert back.best == report.best == report.comparison.first()["model_name"]
    assert back.predictions.count() == 2 * 300
    assert back.models["Decision Tree"].importance == report.run.models["Decision Tree"].importance
    rows, names = prepared_store.load_prepared(spark, report.prepared_path)
    train = {r["label"]: r["count"] for r in rows.filter("split = 'train'").groupBy("label").count().collect()}
    assert train[0.0] == train[1.0] and len(names) == 22


def test_model_run_reports(spark, data):
    train, test, names = data
    run = ModelRun(spark, R.id, names)
    assert run.comparison().count() == 0 and run.best() is None
    run.train("Naive Bayes", train, test)
    run.train_all(train, test, ["Decision Tree"])
    assert run.comparison().count() == 2 and run.best() in run.models
    assert run.confusion().count() == 2 and run.average_precision().count() == 2
    assert run.roc_curve().filter("threshold = double('inf')").count() == 2
    assert run.pr_curve().filter("threshold IS NULL").count() == 2
    assert run.top_features(3).count() == 3 and run.importance().count() == len(names)
    assert run.top_models(1).count() == 5 and run.train_times().count() == 2
    path = run.save(scratch_path(spark, "run"))
    other = ModelRun(spark, R.id)
    assert other.load(path) and other.best() == run.best() and other.feature_names == list(names)
    assert not other.load(path + "-absent")


# ---------------------------------------------------------------- preprocessing job

def test_prepare_equals_the_single_steps(loans):
    pre = Preprocessor()
    step_rows, names = pre.fit_transform(pre.impute_missing(pre.handle_outliers(loans)))
    ready = prepare(loans, R, imbalance="none")
    assert ready.names == names
    def vectors(df):
        return {r[R.id]: r["a"] for r in df.select(R.id, vector_to_array("features").alias("a")).collect()}
    a, b = vectors(step_rows), vectors(ready.rows)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    chained = [s for s, _ in ready.log.steps if not s.startswith("Split")]
    assert chained == [s for s, _ in pre.log.steps]


def test_transformed_numerics_are_standardised(loans):
    flat = Preprocessor().fit(loans).transform(loans, flat=True)
    for c in R.numeric:
        row = flat.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)


def test_fit_on_train_ignores_test_rows(loans):
    ready = prepare(loans, R, imbalance="none", fit_on="train")
    parts = {r["split"]: r["count"] for r in ready.rows.groupBy("split").count().collect()}
    assert parts == {"train": 1200, "test": 300} and ready.model.rows == 1200
    with pytest.raises(ValueError):
        prepare(loans, R, fit_on="test")


def test_prepare_variants(loans):
    ready = prepare(loans, R, outliers="remove", imbalance="undersample")
    train = {r["label"]: r["count"] for r in ready.rows.filter("split = 'train'").groupBy("label").count().collect()}
    assert train[0.0] == train[1.0]
    with pytest.raises(ValueError):
        prepare(loans, R, outliers="bogus")


def test_transform_before_fit(loans):
    with pytest.raises(NotFitted):
        Preprocessor().transform(loans)


def test_stream_gives_the_batch_rows(spark, loans):
    model = Preprocessor().fit(loans)
    source, sink, mark = (scratch_path(spark, s) for s in ("in", "out", "mark"))
    loans.repartition(4).write.parquet(source)
    transform_stream(spark, model, source, loans.schema, sink, mark).awaitTermination()
    assert (spark.read.parquet(sink).select(R.id, vector_to_array("features").alias("a")).exceptAll(
        model.transform(loans).select(R.id, vector_to_array("features").alias("a"))).count()) == 0
    assert spark.read.parquet(sink).count() == loans.count()


def plain_boosting(x, y, rounds, rate):
    """SAMME.R with stumps, every cut of every feature tried on the rows themselves."""
    weights, logits = np.ones(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= cut
                impurity = 0.0
                for side in (left, ~left):
                    n = weights[side].sum()
                    p = weights[side & (y == 1)].sum() / n
                    impurity += n * 2 * p * (1 - p)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, left)
        left = best[1]
        p = np.empty(len(y))
        for side in (left, ~left):
            p[side] = weights[side & (y == 1)].sum() / weights[side].sum()
        eps = np.finfo(float).eps
        step = np.log(np.clip(p, eps, None)) - np.log(np.clip(1 - p, eps, None))
        logits += step / rounds
        weights *= np.exp(-0.5 * rate * np.where(y == 1, step, -step))
        weights /= weights.sum()
    return 1 / (1 + np.exp(-logits))


def test_boosted_stumps_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 3)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.7, 90)) > 0).astype(int)
    rows = spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["id", "features", "label"])
    model = ml.fit_model("AdaBoost", rows, "id", rounds=12, rate=0.5)
    got = {r.id: r.score for r in ml.predict("AdaBoost", model, rows, "id").collect()}
    want = plain_boosting(x, y, 12, 0.5)
    assert len(model.stumps) == 12 and sum(model.importances) == pytest.approx(1.0)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(90))


def test_boosted_stumps_stop_without_a_split(spark):
    rows = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0]), float(i % 2)) for i in range(10)], ["id", "features", "label"])
    model = ml.fit_model("AdaBoost", rows, "id")
    assert model.stumps == [] and {r.score for r in ml.predict("AdaBoost", model, rows, "id").collect()} == {0.5}
