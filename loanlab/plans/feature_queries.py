"""Queries: engineered features, fairness, portfolio scoring, retraining trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import drift
from loanlab.operators import evaluate as ev
from loanlab.operators import fairness as fair
from loanlab.operators import features as ft
from loanlab.operators import learners as ml
from loanlab.plans.evaluate_queries import scorecards
from loanlab.plans.learn_queries import naive_bayes_sql
from loanlab.plans.monitor_queries import REFERENCE_END, TIME, _cells_sql, _psi_sql
from loanlab.plans.portfolio_job import retraining_reasons, score_portfolio
from loanlab.plans.prepare_job import prepare
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import AUC, CUMULATIVE, NUM, PREDICTIONS, corr_sql, long_num, prep_ctes, split_ctes, union_all
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import durable, scratch_path
from loanlab.sources.loan_applications import loan_applications
from loanlab.sources.results_store import write_model
from loanlab.streaming.scoring_stream import save_preprocessor


def _six(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("x3_derived_features", loans_sql("""SELECT app_id, round(loan_amnt / CAST(nullif(person_income, 0) AS DOUBLE), 6) AS debt_to_income,
  person_age - cb_person_cred_hist_length AS age_at_first_credit,
  round(person_income / (person_emp_length + 1e0), 6) AS income_per_employment_year FROM loans"""))
def x3(spark, sf):
    made = ft.derive(loan_applications(spark, sf)).select(R.id, "debt_to_income", "age_at_first_credit", "income_per_employment_year")
    return _six(made, "debt_to_income", "income_per_employment_year")


_GAPPY = ("person_emp_length", "loan_int_rate", "person_home_ownership")


@query("x4_missing_flags", loans_sql("SELECT app_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in _GAPPY)
    + ", coalesce(person_home_ownership, 'Unknown') AS person_home_ownership FROM loans"))
def x4(spark, sf):
    flagged = ft.flag_missing(loan_applications(spark, sf), _GAPPY)
    return ft.fill_unknown(flagged, ["person_home_ownership"]).select(
        R.id, *[f"{c}_missing" for c in _GAPPY], "person_home_ownership")


_SCALED = ("person_income", "loan_amnt", "loan_int_rate")


@query("x5_scalings", loans_sql("SELECT app_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM loans)) / (SELECT max({c}) - min({c}) FROM loans), 6) AS {c}_minmax, "
    f"round((CAST({c} AS DOUBLE) - (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM loans)) / (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75)"
    f" - quantile_cont(CAST({c} AS DOUBLE), 0.25) FROM loans), 6) AS {c}_robust" for c in _SCALED) + " FROM loans"))
def x5_scalings(spark, sf):
    df = durable(loan_applications(spark, sf))
    both = ft.fit_robust(df, _SCALED).apply(ft.fit_min_max(df, _SCALED).apply(df, "_minmax"), "_robust")
    made = [f"{c}_{k}" for c in _SCALED for k in ("minmax", "robust")]
    return _six(both.select(R.id, *made), *made)


@query("x5_transforms_and_limits", loans_sql("""SELECT app_id, round(ln(1e0 + person_income), 6) AS person_income_log,
  round(sqrt(CAST(loan_amnt AS DOUBLE)), 6) AS loan_amnt_sqrt, """ + ", ".join(
    f"round(CASE WHEN {c} IS NOT NULL THEN greatest(lo_{c}, least(CAST({c} AS DOUBLE), hi_{c})) END, 6) AS {c}, "
    f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN 1 ELSE 0 END AS {c}_outlier" for c in ("person_age", "loan_int_rate"))
    + " FROM loans, limits", "limits AS (SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi_{c}"
        for c in ("person_age", "loan_int_rate")) + " FROM loans)"))
def x5_limits(spark, sf):
    df = durable(loan_applications(spark, sf))
    cols = ["person_age", "loan_int_rate"]
    limits = ft.fit_percentiles(df, cols)
    made = ft.transform_skewed(ft.transform_skewed(limits.clip(limits.flag(df)), ["person_income"], "log"), ["loan_amnt"], "sqrt")
    return _six(made.select(R.id, "person_income_log", "loan_amnt_sqrt", *cols, *[f"{c}_outlier" for c in cols]),
                "person_income_log", "loan_amnt_sqrt", *cols)


_AGES, _AGE_NAMES = (25, 35, 45, 55), ("under 25", "25-34", "35-44", "45-54", "55 and over")


@query("x7_age_groups", loans_sql("""SELECT age_group, income_band, count(*) AS n, round(avg(CAST(loan_status AS DOUBLE)), 6) AS default_rate FROM (
  SELECT loan_status, CASE WHEN person_age < 25 THEN 'under 25' WHEN person_age < 35 THEN '25-34' WHEN person_age < 45 THEN '35-44'
      WHEN person_age < 55 THEN '45-54' WHEN person_age IS NOT NULL THEN '55 and over' END AS age_group,
    CAST(len(list_filter((SELECT quantile_cont(CAST(person_income AS DOUBLE), [0.25, 0.5, 0.75]) FROM loans),
      lambda q: q <= person_income)) AS VARCHAR) AS income_band FROM loans) GROUP BY ALL"""))
def x7(spark, sf):
    df = durable(loan_applications(spark, sf))
    income = ft.equal_frequency_edges(df, "person_income", 4)
    return df.groupBy(ft.binned("person_age", _AGES, _AGE_NAMES).alias("age_group"),
                      ft.binned("person_income", income).alias("income_band")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col(R.target).cast("double"))).alias("default_rate"))


@query("x8_redundant_features", loans_sql("""SELECT drop, keep, strength FROM (
  SELECT a, b, strength, CASE WHEN ta < tb THEN a ELSE b END AS drop, CASE WHEN ta < tb THEN b ELSE a END AS keep FROM pairs
  WHERE strength >= 0.35e0) p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.strength >= 0.35e0 AND q.strength > p.strength
    AND (CASE WHEN q.ta < q.tb THEN q.a ELSE q.b END) IN (p.a, p.b))""",
    "pairs AS (" + union_all(
        f"SELECT '{a}' AS a, '{b}' AS b, round(abs({corr_sql(a, b)}), 9) AS strength, "
        f"round(abs({corr_sql(a, 'loan_status')}), 9) AS ta, round(abs({corr_sql(b, 'loan_status')}), 9) AS tb FROM loans"
        for i, a in enumerate(sorted(NUM)) for b in sorted(NUM)[i + 1:]) + ")"))
def x8(spark, sf):
    rows = ft.redundant_features(durable(loan_applications(spark, sf)), R.numeric, R.target, 0.35)
    return spark.createDataFrame(rows, "drop string, keep string, strength double")


@query("x11_fairness", loans_sql("""
SELECT "group", n, round(a, 6) AS approval_rate, round(t, 6) AS tpr, round(f, 6) AS fpr, round(p, 6) AS "precision", ref.g0 AS reference,
  round(a / nullif(a0, 0), 6) AS approval_ratio, round(t - t0, 6) AS tpr_gap, round(f - f0, 6) AS fpr_gap, a / nullif(a0, 0) >= 0.8e0 AS fair
FROM rates, (SELECT "group" AS g0, a AS a0, t AS t0, f AS f0 FROM rates ORDER BY n DESC, "group" LIMIT 1) ref""",
    PREDICTIONS, """rates AS (SELECT coalesce(person_home_ownership, '(missing)') AS "group", count(*) AS n,
  count(*) FILTER (prediction = 0) / CAST(count(*) AS DOUBLE) AS a,
  count(*) FILTER (prediction = 1 AND label = 1) / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE), 0) AS t,
  count(*) FILTER (prediction = 1 AND label = 0) / nullif(CAST(count(*) FILTER (label = 0) AS DOUBLE), 0) AS f,
  count(*) FILTER (prediction = 1 AND label = 1) / nullif(CAST(count(*) FILTER (prediction = 1) AS DOUBLE), 0) AS p
  FROM preds JOIN loans ON id = app_id WHERE model_name = 'grade' GROUP BY 1)"""))
def x11(spark, sf):
    """Home ownership as the protected group, decisions by loan grade."""
    owners = loan_applications(spark, sf).select(F.col(R.id).alias("id"), "person_home_ownership")
    rows = scorecards(spark, sf).where("model_name = 'grade'").join(owners, "id")
    return _six(fair.fairness(rows, "person_home_ownership"), "approval_rate", "tpr", "fpr", "precision", "approval_ratio",
                "tpr_gap", "fpr_gap")


# ---------------------------------------------------------------- portfolio and retraining

@query("x12_portfolio_scores", "SELECT id, score, prediction, CASE WHEN score < 0.1e0 THEN 'low' WHEN score < 0.3e0 THEN 'moderate' "
       "WHEN score < 0.6e0 THEN 'high' ELSE 'very high' END AS band FROM ("
       + naive_bayes_sql(*prep_ctes(clip=False), *split_ctes("prep", "label")).replace(
           "smooth WHERE split = 'test' GROUP BY", "smooth GROUP BY") + ")")
def x12(spark, sf):
    """Every application scored by the stored fits, in one batch that may be run again."""
    df = durable(loan_applications(spark, sf))
    ready = prepare(df, R, outliers="none", imbalance="none")
    model = ml.fit_model("Naive Bayes", durable(ready.rows).where("split = 'train'").drop("split"), R.id)
    place = scratch_path(spark, "portfolio")
    save_preprocessor(spark, ready.model, f"{place}/preprocessor")
    write_model(spark, model, f"{place}/model")
    found = score_portfolio(spark, df.drop(R.target), f"{place}/preprocessor", f"{place}/model", f"{place}/scores")
    return found.withColumn("score", r6("score")).select("id", "score", "prediction", "band")


_YEARS = f"(SELECT *, CAST(year({TIME}) AS INTEGER) AS year FROM loans)"


@query("x18_retraining_trigger", loans_sql("""
SELECT year, period, round(auc.roc_auc, 6) AS roc_auc, round(psi, 6) AS psi, coalesce(auc.roc_auc < 0.85e0, FALSE) AS auc_low,
  coalesce(psi >= 0.25e0, FALSE) AS drifted, period >= 4 AS too_old,
  coalesce(auc.roc_auc < 0.85e0, FALSE) OR coalesce(psi >= 0.25e0, FALSE) OR period >= 4 AS retrain
FROM (SELECT year, year - 1998 AS period, max(psi) AS psi FROM psi WHERE year >= 1998 GROUP BY year)
LEFT JOIN auc ON auc.model_name = CAST(year AS VARCHAR)""",
    f"preds AS (SELECT CAST(year AS VARCHAR) AS model_name, app_id AS id, loan_status AS label, loan_percent_income AS score FROM {_YEARS})",
    CUMULATIVE, AUC,
    f"old AS (SELECT feature, bin, count(*) AS n FROM ({_cells_sql(f'''(SELECT * FROM loans WHERE {TIME} < TIMESTAMP '{REFERENCE_END}')''')}) GROUP BY ALL)",
    f"new AS (SELECT year, feature, bin, count(*) AS n FROM ({_cells_sql(_YEARS, 'year')}) GROUP BY ALL)", _psi_sql("year")))
def x18(spark, sf):
    """Year by year after the fit: largest drift, AUC, age of the model, and whether to fit anew."""
    df = durable(loan_applications(spark, sf)).withColumn("year", F.year(TIME))
    old = df.where(F.col("year") < 1998)
    bins = drift.fit_bins(old, R)
    psi = drift.stability_index(drift.bin_counts(old, bins), drift.bin_counts(df, bins, ["year"]), ["year"])
    rows = df.select(F.col("year").cast("string").alias("model_name"), F.col(R.id).alias("id"), F.col(R.target).alias("label"),
                     F.col("loan_percent_income").alias("score"))
    auc = ev.roc_auc(rows).select(F.col("model_name").cast("int").alias("year"), "roc_auc")
    history = psi.where("year >= 1998").groupBy("year").agg(F.max("psi").alias("psi")).join(auc, "year", "left")
    found = retraining_reasons(history.withColumn("period", F.col("year") - 1998))
    return _six(found, "roc_auc", "psi")
