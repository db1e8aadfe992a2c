"""Queries: quality rules and dimensions, duplicates, target, ordinal and binary encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import encoders as enc
from loanlab.operators import quality as q
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import CAT, NUM, union_all
from loanlab.plans.warehouse_queries import _APPLICATIONS, applications
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import durable
from loanlab.sources.loan_applications import loan_applications

# ---------------------------------------------------------------- rules and dimensions

@query("x1_quality_rules", loans_sql(union_all(f"""SELECT '{r.name}' AS rule, '{r.column}' AS "column", count(*) AS n_rows,
  count({r.condition}) AS n_checked, count(*) FILTER (NOT ({r.condition})) AS n_violations,
  round(count(*) FILTER (NOT ({r.condition})) / CAST(count(*) AS DOUBLE), 6) AS violation_share FROM loans""" for r in q.LOAN_RULES)))
def x1_rules(spark, sf):
    return q.check_rules(loan_applications(spark, sf)).withColumn("violation_share", r6("violation_share"))


@query("x1_violations_by_row", loans_sql("SELECT app_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT ({r.condition}) THEN '{r.name}' END" for r in q.LOAN_RULES)
    + "], lambda x: x IS NOT NULL), ',') AS violations FROM loans"))
def x1_rows(spark, sf):
    return q.mark_violations(loan_applications(spark, sf)).select(R.id, F.array_join("violations", ",").alias("violations"))


_KEY = ("customer_id", "loan_intent")


@query("x2_quality_dimensions", loans_sql(union_all(
    [f"SELECT 'completeness' AS dimension, '{c}' AS subject, round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS score FROM apps"
     for c in (*NUM, *CAT)]
    + [f"SELECT 'validity', '{r.name}', round((count(*) - count(*) FILTER (NOT ({r.condition}))) / CAST(count(*) AS DOUBLE), 6) FROM apps"
       for r in q.LOAN_RULES]
    + ["SELECT 'uniqueness', 'customer_id,loan_intent', round(count(DISTINCT (customer_id, loan_intent)) / CAST(count(*) AS DOUBLE), 6) FROM apps"]),
    _APPLICATIONS))
def x2_dimensions(spark, sf):
    return q.dimensions(applications(spark, sf), R.features, _KEY).withColumn("score", r6("score"))


@query("x2_duplicate_groups", loans_sql(
    "SELECT customer_id, loan_intent, count(*) AS n FROM apps GROUP BY ALL HAVING count(*) > 1", _APPLICATIONS))
def x2_groups(spark, sf):
    return q.duplicate_groups(applications(spark, sf), _KEY)


@query("x2_latest_application", loans_sql("""SELECT customer_id, loan_intent, app_id, application_ts, loan_amnt, loan_status FROM apps
QUALIFY row_number() OVER (PARTITION BY customer_id, loan_intent ORDER BY application_ts DESC, app_id DESC) = 1""", _APPLICATIONS))
def x2_latest(spark, sf):
    """One application per customer and purpose: the latest."""
    rows = applications(spark, sf).select("customer_id", "loan_intent", "app_id", "application_ts", "loan_amnt", "loan_status")
    return q.drop_duplicates(rows, _KEY, ["application_ts", "app_id"])


# ---------------------------------------------------------------- encodings

FOLDS, SMOOTHING, LEAST = 5, 20.0, 200
_FOLD = "CAST(CAST('0x' || substr(md5('fold:' || CAST(app_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER)"


def _target_sql() -> str:
    cells = union_all(f"SELECT app_id, {_FOLD} AS fold, loan_status AS y, '{c}' AS feature, coalesce({c}, 'nan') AS value FROM loans"
                      for c in CAT)
    return loans_sql("SELECT app_id, " + ", ".join(
        f"round(any_value(code) FILTER (feature = '{c}'), 6) AS {c}_te" for c in CAT) + """ FROM (
  SELECT cells.app_id, cells.feature, (t.s - coalesce(p.s, 0) + 20e0 * o.prior) / (t.n - coalesce(p.n, 0) + 20e0) AS code
  FROM cells JOIN total t ON t.feature = cells.feature AND t.value = cells.value
  LEFT JOIN part p ON p.feature = cells.feature AND p.value = cells.value AND p.fold = cells.fold
  JOIN other o ON o.fold = cells.fold) GROUP BY app_id""",
        f"cells AS ({cells})",
        "part AS (SELECT feature, value, fold, count(*) AS n, sum(y) AS s FROM cells GROUP BY ALL)",
        "total AS (SELECT feature, value, sum(n) AS n, sum(s) AS s FROM part GROUP BY ALL)",
        f"""other AS (SELECT f AS fold, (SELECT CAST(sum(loan_status) AS DOUBLE) / count(*) FROM loans WHERE {_FOLD} <> f) AS prior
  FROM range(5) r(f))""")


@query("x6_target_encoding", _target_sql())
def x6_target(spark, sf):
    """Every row's smoothed default rates by category, from rows of other folds."""
    df = durable(loan_applications(spark, sf))
    fitted = enc.fit_target_encoding(df, R.categorical, R.target, R.id, FOLDS, SMOOTHING)
    return fitted.apply(df, R.categorical).select(R.id, *[r6(f"{c}_te").alias(f"{c}_te") for c in R.categorical])


_MERGED = "merged AS (SELECT app_id, " + ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY coalesce({c}, 'nan')) >= {LEAST} THEN coalesce({c}, 'nan') ELSE '(rare)' END AS {c}"
    for c in CAT) + " FROM loans)"


@query("x6_rare_categories", loans_sql("SELECT * FROM merged", _MERGED))
def x6_rare(spark, sf):
    return enc.merge_rare(loan_applications(spark, sf), R.categorical, LEAST).select(R.id, *R.categorical)


@query("x6_ordinal_encoding", loans_sql("SELECT app_id, " + ", ".join(
    f"""CAST((SELECT count(*) FROM freq x WHERE x.feature = '{c}' AND (x.n > g{i}.n OR (x.n = g{i}.n AND x.value < g{i}.value))) AS BIGINT) AS {c}_code"""
    for i, c in enumerate(CAT)) + " FROM merged " + " ".join(
    f"JOIN freq g{i} ON g{i}.feature = '{c}' AND g{i}.value = merged.{c}" for i, c in enumerate(CAT)), _MERGED,
    "freq AS (" + union_all(f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM merged GROUP BY {c}" for c in CAT) + ")"))
def x6_ordinal(spark, sf):
    """Codes by falling frequency, after rare categories are merged."""
    df = durable(enc.merge_rare(loan_applications(spark, sf), R.categorical, LEAST).select(R.id, *R.categorical))
    codes = enc.ordinal_codes(enc.category_counts(df, R.categorical), "frequency")
    return enc.apply_codes(df, codes, R.categorical).select(R.id, *[f"{c}_code" for c in R.categorical])


_BITS = {"person_home_ownership": 3, "loan_intent": 3}


@query("x6_binary_encoding", loans_sql("SELECT app_id, " + ", ".join(
    f"CAST(((dense_rank() OVER (ORDER BY coalesce({c}, 'nan'))) >> {b}) & 1 AS INTEGER) AS {c}_bit{b}"
    for c, n in _BITS.items() for b in range(n)) + " FROM loans"))
def x6_binary(spark, sf):
    df = durable(loan_applications(spark, sf).select(R.id, *_BITS))
    codes = enc.ordinal_codes(enc.category_counts(df, list(_BITS)))
    return enc.binary_columns(df, codes, list(_BITS)).drop(*_BITS)
