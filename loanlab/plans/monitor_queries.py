"""Queries: drift monitoring and scoring of arriving rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import drift
from loanlab.operators import evaluate as ev
from loanlab.operators import learners as ml
from loanlab.plans.learn_queries import naive_bayes_sql
from loanlab.plans.prepare_job import prepare
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import CAT, NUM, prep_ctes, split_ctes, union_all
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import durable, scratch_path
from loanlab.sources.loan_applications import loan_applications
from loanlab.sources.results_store import write_model
from loanlab.streaming.drift_stream import closed_windows, drift_stream
from loanlab.streaming.scoring_stream import save_preprocessor, scoring_stream

TIME, REFERENCE_END = "application_ts", "1998-01-01"
WINDOW_DAYS = 91
ARRIVALS = ("1996-06-01", "1998-01-01", "1999-06-01")  # the table arrives in four parts

# ---------------------------------------------------------------- drift

_OLD = f"{TIME} < TIMESTAMP '{REFERENCE_END}'"


def _cells_sql(table: str, *keep: str) -> str:
    """One row per feature of each row, with its bin; cut points are exact deciles of the older rows."""
    keep = "".join(f"{k}, " for k in keep)
    numbers = [f"""SELECT {keep}'{c}' AS feature, CASE WHEN {c} IS NULL THEN 'missing' ELSE CAST(len(list_filter(
  list_distinct((SELECT quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
  FROM loans WHERE {_OLD})), lambda q: q <= {c})) AS VARCHAR) END AS bin FROM {table}""" for c in NUM]
    return union_all(numbers + [f"SELECT {keep}'{c}', coalesce({c}, 'missing') FROM {table}" for c in CAT])


def _psi_sql(group: str = "") -> str:
    """CTEs from ``old`` (feature, bin, n) and ``new`` (group, feature, bin, n) to ``psi``."""
    g, same = (f"{group}, ", f"AND x.{group} = y.{group}") if group else ("", "")
    return f"""tot_old AS (SELECT feature, sum(n) AS t FROM old GROUP BY feature),
tot_new AS (SELECT {g}feature, sum(n) AS t FROM new GROUP BY {g}feature),
bins AS (SELECT {g}feature, bin FROM new UNION SELECT {g}x.feature, y.bin FROM tot_new x JOIN old y ON x.feature = y.feature),
wide AS (SELECT x.*, coalesce(y.n, 0) AS n_new FROM bins x LEFT JOIN new y ON x.feature = y.feature AND x.bin = y.bin {same}),
both_n AS (SELECT x.*, coalesce(y.n, 0) AS n_old FROM wide x LEFT JOIN old y ON x.feature = y.feature AND x.bin = y.bin),
shares AS (SELECT x.*, y.t AS t_new, greatest(x.n_new / CAST(y.t AS DOUBLE), 1e-4) AS q
  FROM both_n x JOIN tot_new y ON x.feature = y.feature {same}),
psi AS (SELECT {g}x.feature, CAST(any_value(t_new) AS BIGINT) AS n,
  sum((q - greatest(n_old / CAST(z.t AS DOUBLE), 1e-4)) * ln(q / greatest(n_old / CAST(z.t AS DOUBLE), 1e-4))) AS psi
  FROM shares x JOIN tot_old z ON x.feature = z.feature GROUP BY {g}x.feature)"""


_STATE = "CASE WHEN psi < 0.1e0 THEN 'stable' WHEN psi < 0.25e0 THEN 'moved' ELSE 'drifted' END AS state"


def _old_and_new(spark, sf):
    df = durable(loan_applications(spark, sf))  # read once per quantile pass
    split = F.lit(REFERENCE_END).cast("timestamp_ntz")
    return df.where(F.col(TIME) < split), df.where(F.col(TIME) >= split)


@query("x14_drift_between_periods", loans_sql(
    f"SELECT feature, n, round(psi, 6) AS psi, {_STATE} FROM psi",
    f"old AS (SELECT feature, bin, count(*) AS n FROM ({_cells_sql(f'(SELECT * FROM loans WHERE {_OLD})')}) GROUP BY ALL)",
    f"new AS (SELECT feature, bin, count(*) AS n FROM ({_cells_sql(f'(SELECT * FROM loans WHERE NOT ({_OLD}))')}) GROUP BY ALL)",
    _psi_sql()))
def x14_periods(spark, sf):
    old, new = _old_and_new(spark, sf)
    bins = drift.fit_bins(old, R)
    found = drift.stability_index(drift.bin_counts(old, bins), drift.bin_counts(new, bins))
    return found.withColumn("psi", r6("psi"))


_WINDOWED = f"""(SELECT *, make_timestamp(CAST(floor(epoch({TIME}) / {WINDOW_DAYS * 86400}) AS BIGINT) * {WINDOW_DAYS * 86400}
  * 1000000) AS window_start FROM loans WHERE {TIME} IS NOT NULL)"""


@query("x14_drift_stream", loans_sql(f"""SELECT window_start, feature, n, round(psi, 6) AS psi, {_STATE} FROM psi
WHERE window_start + INTERVAL {WINDOW_DAYS} DAY <= (SELECT max({TIME}) - INTERVAL 1 DAY FROM loans)""",
    f"old AS (SELECT feature, bin, count(*) AS n FROM ({_cells_sql(f'(SELECT * FROM loans WHERE {_OLD})')}) GROUP BY ALL)",
    f"new AS (SELECT window_start, feature, bin, count(*) AS n FROM ({_cells_sql(_WINDOWED, 'window_start')}) GROUP BY ALL)",
    _psi_sql("window_start")))
def x14_stream(spark, sf):
    """The table arrives in four parts; the stream is started anew for each and counts 91-day windows."""
    df = durable(loan_applications(spark, sf))
    old = df.where(F.col(TIME) < F.lit(REFERENCE_END).cast("timestamp_ntz"))
    bins = drift.fit_bins(old, R)
    place = scratch_path(spark, "drift")
    edges = [F.lit(t).cast("timestamp_ntz") for t in ARRIVALS]
    parts = [df.where(F.col(TIME) < edges[0]),
             *[df.where((F.col(TIME) >= a) & (F.col(TIME) < b)) for a, b in zip(edges, edges[1:])],
             df.where(F.col(TIME) >= edges[-1])]
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
        drift_stream(spark, bins, f"{place}/in", df.schema, f"{place}/out", f"{place}/state", TIME,
                     f"{WINDOW_DAYS} days").awaitTermination()
    counts = closed_windows(spark, f"{place}/out").drop("window_end")
    found = drift.stability_index(drift.bin_counts(old, bins), counts, ["window_start"])
    return found.withColumn("psi", r6("psi"))


def _score_drift_sql():
    cum = """per_score AS (SELECT year, loan_percent_income AS score, count(*) FILTER (loan_status = 1) AS pos,
  count(*) FILTER (loan_status = 0) AS neg FROM years GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY year ORDER BY score DESC) AS cum_pos FROM per_score)"""
    return loans_sql("""SELECT year, n, round(default_rate, 6) AS default_rate, round(mean_score, 6) AS mean_score,
  round(auc, 6) AS roc_auc FROM (
  SELECT year, count(*) AS n, avg(CAST(loan_status AS DOUBLE)) AS default_rate, avg(loan_percent_income) AS mean_score
  FROM years GROUP BY year) JOIN (
  SELECT year, sum(1e0 * neg * (cum_pos - pos) + 0.5e0 * pos * neg) / nullif(sum(pos) * CAST(sum(neg) AS DOUBLE), 0) AS auc
  FROM cum GROUP BY year) USING (year)""",
                     f"years AS (SELECT *, CAST(year({TIME}) AS INTEGER) AS year FROM loans)", cum)


@query("x14_performance_by_year", _score_drift_sql())
def x14_performance(spark, sf):
    """Default rate and AUC of one scorecard, year by year."""
    rows = loan_applications(spark, sf).select(
        F.year(TIME).cast("string").alias("model_name"), F.col(R.id).alias("id"), F.col(R.target).alias("label"),
        F.col("loan_percent_income").alias("score"))
    facts = rows.groupBy("model_name").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("default_rate"),
                                           r6(F.avg("score")).alias("mean_score"))
    auc = ev.roc_auc(rows).select("model_name", r6("roc_auc").alias("roc_auc"))
    return facts.join(auc, "model_name").select(F.col("model_name").cast("int").alias("year"), "n", "default_rate",
                                                "mean_score", "roc_auc")


# ---------------------------------------------------------------- scoring

@query("x13_scoring_stream", naive_bayes_sql(*prep_ctes(clip=False), *split_ctes("prep", "label")))
def x13_stream(spark, sf):
    """The test rows arrive in two parts; each start of the stream reads the stored model again."""
    df = durable(loan_applications(spark, sf))
    ready = prepare(df, R, outliers="none", imbalance="none")
    rows = durable(ready.rows)
    model = ml.fit_model("Naive Bayes", rows.where("split = 'train'").drop("split"), R.id)
    place = scratch_path(spark, "scoring")
    save_preprocessor(spark, ready.model, f"{place}/preprocessor")
    write_model(spark, model, f"{place}/model")
    raw = df.join(rows.where("split = 'test'").select(R.id), R.id, "left_semi")
    half = F.pmod(F.xxhash64(R.id), F.lit(2)) == 0
    for part in (half, ~half):
        raw.where(part).write.mode("append").parquet(f"{place}/in")
        scoring_stream(spark, f"{place}/preprocessor", f"{place}/model", R, f"{place}/in", raw.schema, f"{place}/out",
                       f"{place}/state").awaitTermination()
    found = spark.read.schema("id bigint, score double, prediction int").parquet(f"{place}/out")
    labels = raw.select(F.col(R.id).alias("id"), F.col(R.target).cast("int").alias("label"))
    return found.join(labels, "id").select("id", "label", r6("score").alias("score"), "prediction")
