"""Queries: separation, calibration, thresholds, expected loss, arms and reason codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import calibration as cal
from loanlab.operators import evaluate as ev
from loanlab.operators import experiments as arms
from loanlab.operators import learners as ml
from loanlab.operators.reasons import reason_codes
from loanlab.plans.evaluate_queries import scorecards
from loanlab.plans.learn_queries import NAIVE_BAYES_CTES, train_test
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import AUC, CUMULATIVE, PREDICTIONS, prep_ctes, split_ctes
from loanlab.roles import LOAN_ROLES as R
from loanlab.sources.loan_applications import loan_applications

GAINS = {"tp": 0.0, "fp": -1.0, "fn": -5.0, "tn": 1.0}  # worth of one application in each cell
LOSS_SHARE, SHARE = 0.45, 0.1


def _clipped(rows):
    """Scores as probabilities: the scorecards reach above 1."""
    return rows.withColumn("score", F.least("score", F.lit(1.0)))


_PROBABILITY = "probs AS (SELECT model_name, id, label, least(score, 1e0) AS score, prediction FROM preds)"
_PROB_CUMULATIVE = CUMULATIVE.replace("FROM preds", "FROM probs")


@query("x9_separation", loans_sql("""
SELECT model_name, round(2e0 * roc_auc - 1e0, 6) AS gini, round(best.g, 6) AS ks, best.score AS ks_threshold, round(brier, 6) AS brier
FROM auc JOIN (SELECT model_name, max(struct_pack(g := round(abs(cum_pos / CAST(total_pos AS DOUBLE)
    - cum_neg / CAST(total_neg AS DOUBLE)), 12), score := score)) AS best FROM cum GROUP BY model_name) USING (model_name)
JOIN (SELECT model_name, avg((score - label) * (score - label)) AS brier FROM probs GROUP BY model_name) USING (model_name)""",
    PREDICTIONS, _PROBABILITY, _PROB_CUMULATIVE, AUC))
def x9_separation(spark, sf):
    found = cal.separation(_clipped(scorecards(spark, sf)))
    return found.select("model_name", r6("gini").alias("gini"), r6("ks").alias("ks"), "ks_threshold", r6("brier").alias("brier"))


@query("x9_calibration", loans_sql("""
SELECT model_name, bin, CAST(sum(n) AS BIGINT) AS n, min(score) AS low, max(score) AS high,
  round(sum(score * n) / sum(n), 6) AS mean_score, round(CAST(sum(pos) AS DOUBLE) / sum(n), 6) AS rate,
  round(abs(sum(score * n) / sum(n) - CAST(sum(pos) AS DOUBLE) / sum(n)), 6) AS gap
FROM (SELECT *, CAST(floor((sum(n) OVER (PARTITION BY model_name ORDER BY score) - n) * 10e0
        / sum(n) OVER (PARTITION BY model_name)) AS INTEGER) AS bin
      FROM (SELECT model_name, score, pos, pos + neg AS n FROM per_score)) GROUP BY model_name, bin""",
    PREDICTIONS, _PROBABILITY, _PROB_CUMULATIVE))
def x9_calibration(spark, sf):
    found = cal.calibration(_clipped(scorecards(spark, sf)))
    return found.select("model_name", "bin", "n", "low", "high", r6("mean_score").alias("mean_score"),
                        r6("rate").alias("rate"), r6("gap").alias("gap"))


# the rising fit as the largest of the least means: means over all stretches that hold a score
@query("x9_isotonic", loans_sql("""
SELECT model_name, min(score) AS low, max(score) AS high, CAST(sum(n) AS BIGINT) AS n, round(fit, 6) AS rate FROM (
  SELECT model_name, score, any_value(n) AS n, max(least_mean) AS fit FROM (
    SELECT p.model_name, p.score, any_value(p.n) AS n, s.a, min(s.mean) AS least_mean
    FROM placed p JOIN stretches s ON s.model_name = p.model_name AND s.a <= p.i AND s.b >= p.i
    GROUP BY p.model_name, p.score, s.a) GROUP BY model_name, score)
GROUP BY model_name, fit""", PREDICTIONS, _PROBABILITY, _PROB_CUMULATIVE,
    """placed AS (SELECT model_name, score, pos, pos + neg AS n, row_number() OVER w AS i,
  sum(pos) OVER w AS cp, sum(pos + neg) OVER w AS cn FROM per_score WINDOW w AS (PARTITION BY model_name ORDER BY score))""",
    """stretches AS (SELECT a.model_name, a.i AS a, b.i AS b, CAST(b.cp - a.cp + a.pos AS DOUBLE) / (b.cn - a.cn + a.n) AS mean
  FROM placed a JOIN placed b ON a.model_name = b.model_name AND a.i <= b.i)"""))
def x9_isotonic(spark, sf):
    return cal.isotonic(_clipped(scorecards(spark, sf))).withColumn("rate", r6("rate"))


@query("x10_best_thresholds", loans_sql("""
SELECT model_name, objective, best.score AS threshold, round(best.v, 6) AS value, round(best.share, 6) AS positive_rate,
  round(1e0 - best.share, 6) AS approval_rate
FROM (SELECT model_name, objective, max(struct_pack(v := round(v, 12), score := score, share := share)) AS best FROM (
  SELECT model_name, score, (cum_pos + cum_neg) / CAST(total_pos + total_neg AS DOUBLE) AS share, unnest([
    struct_pack(o := 'profit', v := -1e0 * cum_neg - 5e0 * (total_pos - cum_pos) + (total_neg - cum_neg)),
    struct_pack(o := 'f1', v := 2e0 * cum_pos / (cum_pos + cum_neg + total_pos)),
    struct_pack(o := 'youden', v := cum_pos / CAST(total_pos AS DOUBLE) - cum_neg / CAST(total_neg AS DOUBLE))], recursive := true)
  FROM points) t(model_name, score, share, objective, v) GROUP BY model_name, objective)""",
    PREDICTIONS, _PROBABILITY, _PROB_CUMULATIVE,
    """points AS (SELECT model_name, score, cum_pos, cum_neg, total_pos, total_neg FROM cum
  UNION ALL SELECT DISTINCT model_name, CAST('inf' AS DOUBLE), 0, 0, total_pos, total_neg FROM cum)"""))
def x10_thresholds(spark, sf):
    found = cal.best_thresholds(_clipped(scorecards(spark, sf)), **GAINS)
    for c in ("value", "positive_rate", "approval_rate"):
        found = found.withColumn(c, r6(c))
    return found


_APPROVED = "least(loan_percent_income, 1e0) < 0.3e0"


@query("x10_expected_loss", loans_sql(f"""
SELECT loan_grade, count(*) AS n, count(*) FILTER ({_APPROVED}) AS n_approved,
  round(CAST(count(*) FILTER ({_APPROVED}) AS DOUBLE) / count(*), 6) AS approval_rate,
  CAST(coalesce(sum(loan_amnt) FILTER ({_APPROVED}), 0) AS DOUBLE) AS exposure,
  round(coalesce(sum(least(loan_percent_income, 1e0) * 0.45e0 * loan_amnt) FILTER ({_APPROVED}), 0e0), 4) AS expected_loss,
  round(coalesce(sum(0.45e0 * loan_amnt) FILTER ({_APPROVED} AND loan_status = 1), 0e0), 4) AS realised_loss
FROM loans GROUP BY loan_grade"""))
def x10_loss(spark, sf):
    rows = loan_applications(spark, sf).withColumn("label", F.col(R.target)).withColumn(
        "score", F.least("loan_percent_income", F.lit(1.0)))
    found = cal.expected_loss(rows, ["loan_grade"], "loan_amnt", LOSS_SHARE, threshold=0.3)
    return (found.withColumn("approval_rate", r6("approval_rate")).withColumn("expected_loss", F.round("expected_loss", 4))
            .withColumn("realised_loss", F.round("realised_loss", 4)))


# ---------------------------------------------------------------- champion and challenger

_ARM = """served AS (SELECT * FROM (SELECT CASE model_name WHEN 'pct_income' THEN 'champion' ELSE 'challenger' END AS model_name,
    id, label, least(score, 1e0) AS score, prediction FROM preds WHERE model_name <> 'constant')
  WHERE model_name = CASE WHEN CAST('0x' || substr(md5('arm:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 < 0.1e0
    THEN 'challenger' ELSE 'champion' END)"""


def served(spark, sf):
    """Nine tenths of the applications get the first scorecard, a tenth the second."""
    both = _clipped(scorecards(spark, sf)).where("model_name <> 'constant'").withColumn(
        "model_name", F.when(F.col("model_name") == "pct_income", arms.CHAMPION).otherwise(arms.CHALLENGER))
    return arms.served(both, "id", SHARE)


@query("x15_arm_metrics", loans_sql("""
SELECT conf.model_name, tn + fp + fn + tp AS n, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy,
  round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS "precision", round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(roc_auc, 6) AS roc_auc
FROM (SELECT model_name, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
  FROM served GROUP BY model_name) conf JOIN auc USING (model_name)""",
    PREDICTIONS, _ARM, CUMULATIVE.replace("FROM preds", "FROM served"), AUC))
def x15_metrics(spark, sf):
    rows = served(spark, sf)
    counts = rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    found = ev.classification_metrics(rows).join(ev.roc_auc(rows), "model_name").join(counts, "model_name")
    return found.select("model_name", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "roc_auc")])


@query("x15_arm_test", loans_sql("""
SELECT measure, n_champion, round(mean_champion, 6) AS mean_champion, n_challenger, round(mean_challenger, 6) AS mean_challenger,
  round(mean_challenger - mean_champion, 6) AS difference,
  round((mean_challenger - mean_champion) / sqrt(v_champion / n_champion + v_challenger / n_challenger), 6) AS statistic,
  abs((mean_challenger - mean_champion) / sqrt(v_champion / n_champion + v_challenger / n_challenger)) > 1.959963984540054e0 AS significant
FROM (SELECT measure, """ + ", ".join(
        f"count(*) FILTER (model_name = '{a}') AS n_{a}, avg(v) FILTER (model_name = '{a}') AS mean_{a}, "
        f"var_samp(v) FILTER (model_name = '{a}') AS v_{a}" for a in ("champion", "challenger")) + """
  FROM (SELECT model_name, 'accuracy' AS measure, CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END AS v FROM served
    UNION ALL SELECT model_name, 'squared_error', (score - label) * (score - label) FROM served) GROUP BY measure)""",
    PREDICTIONS, _ARM))
def x15_test(spark, sf):
    error = F.col("score") - F.col("label")
    found = arms.compare(served(spark, sf), {"accuracy": (F.col("label") == F.col("prediction")).cast("int"),
                                             "squared_error": error * error})
    for c in ("mean_champion", "mean_challenger", "difference", "statistic"):
        found = found.withColumn(c, r6(c))
    return found


# ---------------------------------------------------------------- reasons

@query("x19_reason_codes", loans_sql("""
SELECT id, round(any_value(base) + sum(term), 3) AS margin,
  coalesce(max(feature) FILTER (r = 1 AND term > 0), '') AS first, coalesce(max(feature) FILTER (r = 2 AND term > 0), '') AS second,
  coalesce(max(feature) FILTER (r = 3 AND term > 0), '') AS third, round(coalesce(max(term) FILTER (r = 1 AND term > 0), 0e0), 3) AS first_weight
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY term DESC, pos) AS r FROM terms) GROUP BY id""",
    *prep_ctes(), *split_ctes("prep", "label"), *NAIVE_BAYES_CTES,
    """terms AS (SELECT t.app_id AS id, t.feature, t.pos, (SELECT ln(p.prior) FROM priors p WHERE c = 1) - (SELECT ln(p.prior) FROM priors p WHERE c = 0) AS base,
  0.5e0 * ln((z.var + eps) / (o.var + eps)) + (value - z.mean) * (value - z.mean) / (2e0 * (z.var + eps))
    - (value - o.mean) * (value - o.mean) / (2e0 * (o.var + eps)) AS term
  FROM cells t JOIN stats z ON z.feature = t.feature AND z.c = 0 JOIN stats o ON o.feature = t.feature AND o.c = 1, smooth
  WHERE split = 'test')"""))
def x19_reasons(spark, sf):
    """The three strongest grounds for a default, for every test row."""
    train, test, names = train_test(spark, sf)
    found = reason_codes(ml.fit_model("Naive Bayes", train, R.id), test, R.id, names)
    place = [F.coalesce(F.get("reasons", F.lit(i))["feature"], F.lit("")) for i in range(3)]
    weight = F.coalesce(F.get("reasons", F.lit(0))["contribution"], F.lit(0.0))
    return found.select("id", F.round("margin", 3).alias("margin"), place[0].alias("first"), place[1].alias("second"),
                        place[2].alias("third"), F.round(weight, 3).alias("first_weight"))
