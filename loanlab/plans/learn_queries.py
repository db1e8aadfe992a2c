"""Queries: learners, training, cross-validation, tuning, model storage.

Learners are checked on facts that hold whatever the engine: row and class counts, score
range, and a floor on the AUC. Nearest neighbours and naive Bayes are exact and compared
row by row. Every learner runs with the API defaults, over all rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import evaluate as ev
from loanlab.operators import learners as ml
from loanlab.plans.prepare_job import prepare
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import FEATURE_NAMES, prep_ctes, split_ctes, union_all
from loanlab.plans.train_job import JobReport, run_batch_job
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import durable, let_go, scratch_path
from loanlab.sources.loan_applications import loan_applications
from loanlab.sources.prepared_store import load_prepared
from loanlab.sources.results_store import load_model, load_results, results_exist, save_model

AUC_FLOOR = {"K-Nearest Neighbors": 0.85, "Naive Bayes": 0.85}


def train_test(spark, sf):
    """Prepared rows without oversampling, kept on disk: (train, test, feature names)."""
    # the table is a join: stored once, as every pass of the fit reads it
    ready = prepare(durable(loan_applications(spark, sf)), R, imbalance="none")
    # in memory, the rows of a large table fill the heap beside the workers that need the room
    rows = ready.rows.persist(StorageLevel.DISK_ONLY)
    return (rows.filter(F.col("split") == "train").drop("split"),
            rows.filter(F.col("split") == "test").drop("split"), ready.names)


_LABELLED = "labelled AS (SELECT app_id, CAST(loan_status AS DOUBLE) AS label FROM loans)"
_SPLIT = (_LABELLED, *split_ctes("labelled", "label"))


def _facts_sql(name):
    return loans_sql(f"""SELECT '{name}' AS model_name, count(*) AS n_test, count(*) FILTER (label = 1) AS n_positive,
  TRUE AS scores_in_range, TRUE AS auc_above_floor, TRUE AS decisions_match FROM parted WHERE split = 'test'""", *_SPLIT)


def _facts(models):
    """One row per model of engine-independent facts."""
    scored = ml.predictions_table(models)
    counts = scored.groupBy("model_name").agg(
        F.count("*").alias("n_test"), F.count_if(F.col("label") == 1).alias("n_positive"),
        F.every(F.col("score").between(0.0, 1.0)).alias("scores_in_range"),
        F.every(F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("decisions_match"))
    floor = F.lit(0.9)
    for n, v in AUC_FLOOR.items():
        floor = F.when(F.col("model_name") == n, v).otherwise(floor)
    auc = ev.roc_auc(scored).select("model_name", (F.col("roc_auc") > floor).alias("auc_above_floor"))
    return counts.join(F.broadcast(auc), "model_name")  # one row per model


def _learner_query(key, name):
    def run(spark, sf):
        train, test, names = train_test(spark, sf)
        return _facts({name: ml.train_model(name, train, test, R.id, names)})
    query(key, _facts_sql(name))(run)


for _key, _name in (
    ("m1_logistic_regression", "Logistic Regression"), ("m2_decision_tree", "Decision Tree"),
    ("m3_random_forest", "Random Forest"), ("m4_gradient_boosting", "Gradient Boosting"),
    ("m5_regularised_boosting", "XGBoost"), ("m6_histogram_boosting", "LightGBM"),
    ("m9_adaboost", "AdaBoost"),
):
    _learner_query(_key, _name)


_PREPARED = (*prep_ctes(), *split_ctes("prep", "label"))
_DISTANCE = " + ".join(f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in FEATURE_NAMES)


@query("m7_nearest_neighbours_score", loans_sql(f"""
SELECT id, label, list_avg(list_transform(best, lambda b: b.label)) AS score,
  CASE WHEN list_avg(list_transform(best, lambda b: b.label)) > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT a.app_id AS id, CAST(a.label AS INT) AS label,
    min(struct_pack(d := round(sqrt({_DISTANCE}), 6), id := b.app_id, label := b.label), 5) AS best
  FROM (SELECT * FROM parted WHERE split = 'test') a JOIN (SELECT * FROM parted WHERE split = 'train') b ON a.split <> b.split
  GROUP BY a.app_id, a.label)""", *_PREPARED))
def m7(spark, sf):
    train, test, _ = train_test(spark, sf)
    model = ml.fit_model("K-Nearest Neighbors", train, R.id)
    return ml.predict("K-Nearest Neighbors", model, test, R.id).drop("model_name")


# moments of the train rows of ``parted`` by feature and class
NAIVE_BAYES_CTES = (
    "cells AS (" + union_all(f"SELECT app_id, label, split, '{n}' AS feature, {i} AS pos, {n} AS value FROM parted"
                             for i, n in enumerate(FEATURE_NAMES)) + ")",
    "stats AS (SELECT feature, label AS c, avg(value) AS mean, var_pop(value) AS var FROM cells WHERE split = 'train' GROUP BY feature, label)",
    "smooth AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(value) AS v FROM cells WHERE split = 'train' GROUP BY feature))",
    "priors AS (SELECT label AS c, count(*) * 1e0 / (SELECT count(*) FROM parted WHERE split = 'train') AS prior FROM parted WHERE split = 'train' GROUP BY label)")


def naive_bayes_sql(*prepared):
    """Score and decision of the test rows of ``parted``, from the moments of its train rows."""
    return loans_sql("""
SELECT id, label, round(1e0 / (1e0 + exp(least(l0 - l1, 700e0))), 6) AS score,
  CASE WHEN 1e0 / (1e0 + exp(least(l0 - l1, 700e0))) > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT t.app_id AS id, CAST(t.label AS INT) AS label,
    sum(-0.5e0 * ln(2e0 * pi() * (var + eps)) - (value - mean) * (value - mean) / (2e0 * (var + eps)))
      FILTER (stats.c = 0) + (SELECT ln(prior) FROM priors WHERE c = 0) AS l0,
    sum(-0.5e0 * ln(2e0 * pi() * (var + eps)) - (value - mean) * (value - mean) / (2e0 * (var + eps)))
      FILTER (stats.c = 1) + (SELECT ln(prior) FROM priors WHERE c = 1) AS l1
  FROM cells t JOIN stats USING (feature), smooth WHERE split = 'test' GROUP BY t.app_id, t.label)""",
    *prepared,
    *NAIVE_BAYES_CTES)


@query("m8_gaussian_naive_bayes", naive_bayes_sql(*_PREPARED))
def m8(spark, sf):
    train, test, _ = train_test(spark, sf)
    model = ml.fit_model("Naive Bayes", train, R.id)
    scored = ml.predict("Naive Bayes", model, test, R.id).drop("model_name")
    return scored.withColumn("score", r6("score"))


_QUICK = ("Logistic Regression", "Decision Tree", "Naive Bayes")


@query("m10_train_one_model", _facts_sql("Naive Bayes"))
def m10(spark, sf):
    train, test, names = train_test(spark, sf)
    return _facts({"Naive Bayes": ml.train_model("Naive Bayes", train, test, R.id, names)})


@query("m11_train_several_models", loans_sql("""
SELECT model_name, model_name <> 'Unknown' AS trained, model_name = 'Decision Tree' AS has_importance FROM (
  SELECT unnest(['Decision Tree', 'Naive Bayes', 'Unknown']) AS model_name)"""))
def m11(spark, sf):
    """A failing learner is reported and the others go on."""
    train, test, names = train_test(spark, sf)
    done, failed = ml.train_models(train, test, R.id, names, ["Decision Tree", "Unknown", "Naive Bayes"],
                                   parallelism=3)
    rows = [(n, True, m.importance is not None) for n, m in done.items()] + [(n, False, False) for n in failed]
    return spark.createDataFrame(rows, "model_name string, trained boolean, has_importance boolean")


@query("m12_class_probabilities", loans_sql(
    "SELECT app_id AS id, TRUE AS in_range FROM parted WHERE split = 'test'", *_SPLIT))
def m12(spark, sf):
    train, test, _ = train_test(spark, sf)
    model = ml.fit_model("Logistic Regression", train, R.id)
    return ml.predict("Logistic Regression", model, test, R.id).select(
        "id", F.col("score").between(0.0, 1.0).alias("in_range"))


@query("m13_feature_importance", loans_sql(
    "SELECT model_name, name AS feature, TRUE AS not_negative FROM "
    "(SELECT unnest(['Logistic Regression', 'Decision Tree']) AS model_name), "
    "(SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURE_NAMES) + "]) AS name)"))
def m13(spark, sf):
    """Importance per feature where the learner has one (naive Bayes has none)."""
    train, test, names = train_test(spark, sf)
    done, _ = ml.train_models(train, test, R.id, names, _QUICK, parallelism=3)
    return ml.importance_table(spark, done).select(
        "model_name", "feature", (F.col("importance") >= 0).alias("not_negative"))


# the folds' sizes and positives from the rows; every learner scores each train row once
@query("m14_cross_validation", loans_sql(f"""
SELECT model_name, CAST(fold AS INT) AS fold, metric, TRUE AS in_range, n > 0 AND pos > 0 AS has_both_classes
FROM (SELECT unnest(['Logistic Regression', 'Decision Tree', 'Naive Bayes']) AS model_name), range(5) f(fold),
  (SELECT unnest([{", ".join(f"'{m}'" for m in ev.METRICS)}]) AS metric),
  (SELECT count(*) AS n, count(*) FILTER (label = 1) AS pos FROM parted WHERE split = 'train')""", *_SPLIT))
def m14(spark, sf):
    train, _, _ = train_test(spark, sf)
    out = None
    for name in _QUICK:
        part = ml.cross_validate(name, train, R.id, parallelism=4).select(
            F.lit(name).alias("model_name"), "fold", "metric", F.col("value").between(0.0, 1.0).alias("in_range"),
            (F.col("value") > 0.0).alias("has_both_classes"))
        out = part if out is None else out.unionByName(part)
    return out


_SETTINGS = [ml.setting_text(o) for o in ml.grid_options("Logistic Regression")]


def _names(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("m15_tuning_grid", loans_sql(f"""
SELECT setting, CAST(fold AS INT) AS fold, metric, n > 0 AS in_range FROM (SELECT unnest({_names(_SETTINGS)}) AS setting),
  range(5) f(fold), (SELECT unnest({_names(ev.METRICS)}) AS metric), (SELECT count(*) AS n FROM loans)"""))
def m15(spark, sf):
    """The whole logistic regression grid over five folds."""
    train, _, _ = train_test(spark, sf)
    return ml.tune("Logistic Regression", train, R.id, parallelism=4).select(
        "setting", "fold", "metric", F.col("value").between(0.0, 1.0).alias("in_range"))


# ---------------------------------------------------------------- the batch job and what it stores

_JOBS: dict[tuple, JobReport] = {}


def batch_job(spark, sf) -> JobReport:
    """The job end to end: prepared with oversampling, all nine learners trained, compared and stored.

    The queries below read different results of it, so a session runs it once for a table.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _JOBS:
        _JOBS[key] = run_batch_job(spark, durable(loan_applications(spark, sf)), scratch_path(spark, "job"))
    return _JOBS[key]


_NINE = list(ml.REGISTRY)


@query("s8_model_round_trip", loans_sql(f"""
SELECT model_name, n, n AS same FROM (SELECT count(*) AS n FROM parted WHERE split = 'test'),
  (SELECT unnest({_names(_NINE)}) AS model_name)""", *_SPLIT))
def s8(spark, sf):
    """Stored and reloaded models score every test row as before."""
    job = batch_job(spark, sf)
    rows, _ = load_prepared(spark, job.prepared_path)
    test, stored = rows.where("split = 'test'").drop("split"), load_results(spark, job.results_path)
    out = None
    for name, m in stored.models.items():
        again = load_model(spark, save_model(spark, stored.models, name, scratch_path(spark, "model")))
        after = ml.predict(name, again, test, R.id).select("id", F.col("score").alias("again"))
        row = m.predictions.join(after, "id").groupBy("model_name").agg(
            F.count("*").alias("n"), F.count_if(F.abs(F.col("score") - F.col("again")) < 1e-12).alias("same"))
        out = row if out is None else out.unionByName(row)
        let_go(spark)
    return out


@query("s10_results_round_trip", loans_sql(f"""
SELECT model_name, n AS n_predictions, TRUE AS same_metrics, TRUE AS exists_after FROM
  (SELECT count(*) AS n FROM parted WHERE split = 'test'), (SELECT unnest({_names(_NINE)}) AS model_name)""",
    *_SPLIT))
def s10(spark, sf):
    """All stored results, loaded: metrics recomputed from stored predictions are the saved ones."""
    path = batch_job(spark, sf).results_path
    exists = results_exist(spark, path)
    back = load_results(spark, path)
    saved = back.metrics.select("model_name", F.struct(*[F.round(m, 9).alias(m) for m in ev.METRICS]).alias("saved"))
    fresh = ev.evaluate(back.predictions).select(
        "model_name", F.struct(*[F.round(m, 9).alias(m) for m in ev.METRICS]).alias("fresh"))
    n = back.predictions.groupBy("model_name").agg(F.count("*").alias("n_predictions"))
    return (n.join(saved, "model_name").join(fresh, "model_name")
            .select("model_name", "n_predictions", (F.col("saved") == F.col("fresh")).alias("same_metrics"),
                    F.lit(exists).alias("exists_after")))


def _times_sql(names):
    return loans_sql(f"""SELECT model_name, n > 0 AS timed, n AS n_test FROM (SELECT unnest({_names(names)}) AS model_name),
  (SELECT count(*) AS n FROM parted WHERE split = 'test')""", *_SPLIT)


def _timed(times, scored):
    """Train times as facts: every model has one, in ascending order, next to its scored rows."""
    n = scored.groupBy("model_name").agg(F.count("*").alias("n_test"))
    return times.select("model_name", (F.col("train_seconds") > 0).alias("timed")).join(n, "model_name")


@query("e11_training_times", _times_sql(_NINE))
def e11(spark, sf):
    """Train-time comparison of the stored results, fastest first."""
    back = load_results(spark, batch_job(spark, sf).results_path)
    return _timed(ev.by_train_time(back.metrics), back.predictions)


@query("t4_models_by_train_time", _times_sql(_NINE))
def t4(spark, sf):
    """The batch job end to end, all nine models by training time."""
    report = batch_job(spark, sf)
    return _timed(report.run.train_times(), load_results(spark, report.results_path).predictions)
