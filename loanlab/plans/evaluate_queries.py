"""Queries: metrics, curves, comparison tables, importance tables, over plain scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import evaluate as ev
from loanlab.operators.profile import correlation_matrix
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import (
    AUC, CONFUSION, CUMULATIVE, METRIC_CTES, NUM, PREDICTIONS, corr_sql, union_all,
)
from loanlab.roles import LOAN_ROLES as R
from loanlab.sources.loan_applications import loan_applications


def scorecards(spark, sf):
    """predictions(model_name, id, label, score, prediction) of three scorecards, in one scan."""
    def card(name, score):
        return F.struct(F.lit(name).alias("model_name"), score.cast("double").alias("score"),
                        ev.decide(score).alias("prediction"))
    grade = (F.ascii("loan_grade") - 65) / F.lit(6.0)
    cards = F.array(card("pct_income", F.col("loan_percent_income")), card("grade", grade),
                    card("constant", F.lit(0.5)))
    return (loan_applications(spark, sf)
            .select(F.col(R.id).alias("id"), F.col(R.target).alias("label"), F.explode(cards).alias("c"))
            .select("c.model_name", "id", "label", "c.score", "c.prediction"))


def importances(spark, sf):
    """importance(model_name, feature, importance): |correlation| with the target or the grade."""
    df = loan_applications(spark, sf).withColumn("grade_no", F.ascii("loan_grade") - 65)
    corr = correlation_matrix(df, [*R.numeric, R.target, "grade_no"])
    name = F.when(F.col("y") == R.target, "pct_income").when(F.col("y") == "grade_no", "grade")
    return corr.filter(F.col("x").isin(*R.numeric) & name.isNotNull()).select(
        name.alias("model_name"), F.col("x").alias("feature"), F.round(F.abs("corr"), 9).alias("importance"))


IMPORTANCE = "graded AS (SELECT *, ascii(loan_grade) - 65 AS grade_no FROM loans), importance AS (" + union_all(
    f"SELECT '{m}' AS model_name, '{f}' AS feature, round(abs({corr_sql(f, t, 'graded')}), 9) AS importance FROM graded"
    for m, t in (("pct_income", "loan_status"), ("grade", "grade_no")) for f in NUM) + ")"


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


def _rounded_metrics(table="metrics"):
    return ", ".join(f'round("{m}", 6) AS "{m}"' for m in ev.METRICS)


# ---------------------------------------------------------------- decisions and metrics

@query("f8_threshold_decision", loans_sql("SELECT model_name, id, prediction FROM preds", PREDICTIONS))
def f8(spark, sf):
    return scorecards(spark, sf).select("model_name", "id", "prediction")


@query("e1_confusion_matrix", loans_sql(
    "SELECT model_name, tn, fp, fn, tp, " + ", ".join(
        f"round({k} * 100e0 / (tn + fp + fn + tp), 6) AS {k}_pct" for k in ("tn", "fp", "fn", "tp"))
    + " FROM conf", PREDICTIONS, CONFUSION))
def e1(spark, sf):
    return _r6(ev.confusion(scorecards(spark, sf)), "tn_pct", "fp_pct", "fn_pct", "tp_pct")


def _one_metric(name):
    sql = loans_sql(f'SELECT model_name, round("{name}", 6) AS "{name}" FROM metrics', *METRIC_CTES)

    def run(spark, sf):
        return ev.classification_metrics(scorecards(spark, sf)).select("model_name", r6(name).alias(name))
    return sql, run


for _id, _name in (("e2", "accuracy"), ("e3", "precision"), ("e4", "recall"), ("e5", "f1")):
    _sql, _run = _one_metric(_name)
    query(f"{_id}_{_name}", _sql)(_run)


@query("e6_roc_auc", loans_sql("SELECT model_name, round(roc_auc, 6) AS roc_auc FROM auc",
                               PREDICTIONS, CUMULATIVE, AUC))
def e6(spark, sf):
    return _r6(ev.roc_auc(scorecards(spark, sf)), "roc_auc")


@query("e7_roc_curve", loans_sql("""
SELECT model_name, score AS threshold, round(cum_neg * 1e0 / total_neg, 6) AS fpr, round(cum_pos * 1e0 / total_pos, 6) AS tpr
FROM (SELECT *, lag(pos) OVER w AS prev FROM cum WINDOW w AS (PARTITION BY model_name ORDER BY score DESC))
WHERE prev IS NULL OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT DISTINCT model_name, CAST('inf' AS DOUBLE), 0e0, 0e0 FROM preds""", PREDICTIONS, CUMULATIVE))
def e7(spark, sf):
    return _r6(ev.roc_curve(scorecards(spark, sf)), "fpr", "tpr")


@query("e7_roc_curve_all_points", loans_sql("""
SELECT model_name, score AS threshold, round(cum_neg * 1e0 / total_neg, 6) AS fpr, round(cum_pos * 1e0 / total_pos, 6) AS tpr
FROM cum UNION ALL SELECT DISTINCT model_name, CAST('inf' AS DOUBLE), 0e0, 0e0 FROM preds""", PREDICTIONS, CUMULATIVE))
def e7_all(spark, sf):
    return _r6(ev.roc_curve(scorecards(spark, sf), drop_intermediate=False), "fpr", "tpr")


@query("e8_precision_recall_curve", loans_sql("""
SELECT model_name, score AS threshold, round(cum_pos * 1e0 / (cum_pos + cum_neg), 6) AS "precision",
  round(cum_pos * 1e0 / total_pos, 6) AS recall FROM cum
UNION ALL SELECT DISTINCT model_name, CAST(NULL AS DOUBLE), 1e0, 0e0 FROM preds""", PREDICTIONS, CUMULATIVE))
def e8(spark, sf):
    return _r6(ev.pr_curve(scorecards(spark, sf)), "precision", "recall")


@query("e9_average_precision", loans_sql("""
SELECT model_name, round(sum(1e0 * pos / total_pos * cum_pos / (cum_pos + cum_neg)), 6) AS average_precision
FROM cum GROUP BY model_name""", PREDICTIONS, CUMULATIVE))
def e9(spark, sf):
    return _r6(ev.average_precision(scorecards(spark, sf)), "average_precision")


@query("w3_cumulative_counts", loans_sql(
    "SELECT model_name, score, pos, neg, cum_pos, cum_neg, total_pos, total_neg, next_pos, next_neg FROM cum",
    PREDICTIONS, CUMULATIVE))
def w3(spark, sf):
    return ev.cumulative_counts(scorecards(spark, sf))


# ---------------------------------------------------------------- comparison of models

_RANKED = """ranked AS (
  SELECT model_name, round(accuracy, 4) AS accuracy, round("precision", 4) AS "precision", round(recall, 4) AS recall,
    round(f1, 4) AS f1, round(roc_auc, 4) AS roc_auc,
    CAST(row_number() OVER (ORDER BY round(roc_auc, 4) DESC, model_name) AS INT) AS rank FROM metrics)"""


@query("e10_comparison_table", loans_sql("SELECT * FROM ranked", *METRIC_CTES, _RANKED))
def e10(spark, sf):
    return ev.comparison_table(ev.evaluate(scorecards(spark, sf)))


@query("w1_model_rank", loans_sql("SELECT model_name, rank FROM ranked", *METRIC_CTES, _RANKED))
def w1(spark, sf):
    return ev.comparison_table(ev.evaluate(scorecards(spark, sf))).select("model_name", "rank")


@query("t1_sorted_comparison", loans_sql("SELECT * FROM ranked ORDER BY rank", *METRIC_CTES, _RANKED))
def t1(spark, sf):
    return ev.sorted_comparison(ev.evaluate(scorecards(spark, sf)))


def _melt(table, names, extra=""):
    return union_all(f"SELECT model_name{extra}, '{m}' AS metric, \"{m}\" AS score FROM {table}" for m in names)


@query("t3_top_models_radar", loans_sql(
    f"SELECT * FROM ({_melt('ranked', ev.METRICS, ', rank')}) WHERE rank <= 2", *METRIC_CTES, _RANKED))
def t3(spark, sf):
    return ev.top_models(ev.evaluate(scorecards(spark, sf)), 2)


@query("t5_best_model", loans_sql(
    "SELECT model_name, round(roc_auc, 6) AS roc_auc FROM metrics ORDER BY metrics.roc_auc DESC, model_name LIMIT 1",
    *METRIC_CTES))
def t5(spark, sf):
    return _r6(ev.best_model(ev.evaluate(scorecards(spark, sf))), "roc_auc")


@query("t6_metrics_long", loans_sql(
    f"SELECT model_name, metric, round(score, 6) AS score FROM ({_melt('metrics', ev.METRICS)})", *METRIC_CTES))
def t6(spark, sf):
    return _r6(ev.metrics_long(ev.evaluate(scorecards(spark, sf))), "score")


@query("u3_gathered_metrics", loans_sql(f"SELECT model_name, {_rounded_metrics()} FROM metrics", *METRIC_CTES))
def u3(spark, sf):
    """All models' metrics from one long predictions table."""
    return _r6(ev.evaluate(scorecards(spark, sf)), *ev.METRICS)


# ---------------------------------------------------------------- importance

_IMPORTANCE_RANKED = """SELECT model_name, feature, importance,
  CAST(row_number() OVER o AS INT) AS rank,
  round(sum(importance) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        / nullif(sum(importance) OVER (PARTITION BY model_name), 0) * 100e0, 2) AS cumulative_pct
FROM importance WINDOW o AS (PARTITION BY model_name ORDER BY importance DESC, feature)"""


@query("w2_importance_rank", loans_sql(_IMPORTANCE_RANKED, IMPORTANCE))
def w2(spark, sf):
    return ev.ranked_importance(importances(spark, sf))


@query("t2_top_features", loans_sql(
    f"SELECT model_name, feature, importance, rank FROM ({_IMPORTANCE_RANKED}) WHERE rank <= 5", IMPORTANCE))
def t2(spark, sf):
    return ev.top_features(importances(spark, sf), 5)


@query("f6_models_with_importance", loans_sql(
    "SELECT model_name FROM metrics WHERE model_name IN (SELECT model_name FROM importance)",
    *METRIC_CTES, IMPORTANCE))
def f6(spark, sf):
    return ev.models_with_importance(ev.evaluate(scorecards(spark, sf)), importances(spark, sf))
