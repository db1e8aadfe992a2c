"""Queries: versioned customers, facts as of their time, star schema and rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import history, star
from loanlab.plans.registry import loans_sql, query
from loanlab.session import durable
from loanlab.sources.loan_applications import loan_applications, read_table

ATTRIBUTES = ("person_home_ownership", "cb_person_default_on_file")


def applications(spark, sf):
    """Loan applications with the customer who made them."""
    who = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_custkey").alias("customer_id"))
    return loan_applications(spark, sf).join(who, "app_id")


_APPLICATIONS = "apps AS (SELECT loans.*, o_custkey AS customer_id FROM loans JOIN orders ON app_id = o_orderkey)"

# ---------------------------------------------------------------- versions

_VERSIONS = """at_once AS (
  SELECT * FROM apps QUALIFY row_number() OVER (PARTITION BY customer_id, application_ts ORDER BY app_id DESC) = 1),
seen AS (
  SELECT customer_id, application_ts AS t, person_home_ownership AS h, cb_person_default_on_file AS d,
    row_number() OVER w AS i, lag(person_home_ownership) OVER w AS h0, lag(cb_person_default_on_file) OVER w AS d0
  FROM at_once WINDOW w AS (PARTITION BY customer_id ORDER BY application_ts)),
versions AS (
  SELECT customer_id, h AS person_home_ownership, d AS cb_person_default_on_file, t AS valid_from,
    lead(t) OVER (PARTITION BY customer_id ORDER BY t) AS valid_to
  FROM seen WHERE i = 1 OR h IS DISTINCT FROM h0 OR d IS DISTINCT FROM d0)"""


def customer_versions(spark, sf):
    return history.versions(applications(spark, sf), "customer_id", "application_ts", ATTRIBUTES, tie="app_id")


@query("x17_customer_versions", loans_sql("SELECT *, valid_to IS NULL AS is_current FROM versions", _APPLICATIONS, _VERSIONS))
def x17_versions(spark, sf):
    return customer_versions(spark, sf)


@query("x17_shipments_as_of", loans_sql("""
SELECT l_orderkey, l_linenumber, o_custkey AS customer_id, l_shipdate, valid_from, person_home_ownership, cb_person_default_on_file
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN versions
  ON customer_id = o_custkey AND valid_from <= l_shipdate AND (valid_to IS NULL OR l_shipdate < valid_to)""",
    _APPLICATIONS, _VERSIONS))
def x17_facts(spark, sf):
    """Every order line with what was known of its customer on the day it was shipped."""
    owner = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                   F.col("o_custkey").alias("customer_id"))
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(owner, "l_orderkey")
    return history.as_of(lines, customer_versions(spark, sf), "customer_id", "l_shipdate", ATTRIBUTES,
                         keep=("l_orderkey", "l_linenumber"))


# ---------------------------------------------------------------- star schema

KEYS = {"customer_key": ["customer_id"], "product_key": ["loan_intent", "loan_grade"],
        "profile_key": ["person_home_ownership", "cb_person_default_on_file", "history_band"],
        "date_key": ["application_date"]}
MEASURES = ("app_id", "loan_amnt", "loan_int_rate", "loan_status")


def staged(spark, sf):
    """Applications with the columns that the natural keys need."""
    years = F.col("cb_person_cred_hist_length")
    band = F.when(years < 5, "short").when(years < 10, "medium").otherwise("long")
    return applications(spark, sf).withColumn("history_band", F.when(years.isNotNull(), band)).withColumn(
        "application_date", F.to_date("application_ts").cast("string"))


def _key_sql(*columns: str) -> str:
    parts = " || chr(31) || ".join(f"coalesce('+' || CAST({c} AS VARCHAR), '-')" for c in columns)
    empty = " AND ".join(f"{c} IS NULL" for c in columns)
    return f"CASE WHEN {empty} THEN 0 ELSE CAST('0x' || substr(md5({parts}), 1, 15) AS BIGINT) END"


_STAGED = """staged AS (SELECT *, CASE WHEN cb_person_cred_hist_length < 5 THEN 'short'
  WHEN cb_person_cred_hist_length < 10 THEN 'medium' WHEN cb_person_cred_hist_length IS NOT NULL THEN 'long' END AS history_band,
  CAST(CAST(application_ts AS DATE) AS VARCHAR) AS application_date FROM apps)"""


def _dimension_sql(key: str, source: str, derived: str = "", attributes: tuple = ()) -> str:
    natural = KEYS[key]
    columns = ", ".join([*natural, *attributes])
    nulls = ", ".join(f"NULL AS {c}" for c in [*natural, *attributes])
    return loans_sql(f"""SELECT *{derived} FROM (SELECT DISTINCT {_key_sql(*natural)} AS {key}, {columns} FROM {source}
WHERE {_key_sql(*natural)} <> 0 UNION ALL SELECT 0, {nulls})""", _APPLICATIONS, _STAGED)


@query("x16_dim_product", _dimension_sql("product_key", "staged", ", CASE WHEN loan_grade IN ('A', 'B') THEN 'low' "
                                         "WHEN loan_grade = 'C' THEN 'middle' WHEN loan_grade IS NOT NULL THEN 'high' END AS risk_band"))
def x16_product(spark, sf, rows=None):
    grade = F.col("loan_grade")
    risk = F.when(grade.isin("A", "B"), "low").when(grade == "C", "middle").when(grade.isNotNull(), "high")
    return star.dimension(rows or staged(spark, sf), "product_key", KEYS["product_key"], {"risk_band": risk})


@query("x16_dim_credit_profile", _dimension_sql("profile_key", "staged"))
def x16_profile(spark, sf, rows=None):
    return star.dimension(rows or staged(spark, sf), "profile_key", KEYS["profile_key"])


@query("x16_dim_date", _dimension_sql("date_key", "staged", ", CAST(year(CAST(application_date AS DATE)) AS INTEGER) AS year, "
                                      "CAST(quarter(CAST(application_date AS DATE)) AS INTEGER) AS quarter, "
                                      "CAST(month(CAST(application_date AS DATE)) AS INTEGER) AS month, "
                                      "isodow(CAST(application_date AS DATE)) >= 6 AS is_weekend"))
def x16_date(spark, sf, rows=None):
    d = F.to_date("application_date")
    return star.dimension(rows or staged(spark, sf), "date_key", KEYS["date_key"], {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "is_weekend": F.weekday(d) >= 5})


@query("x16_dim_customer", _dimension_sql(
    "customer_key", "(SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_nationkey AS nation FROM customer)",
    attributes=("segment", "nation")))
def x16_customer(spark, sf):
    members = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return star.dimension(members, "customer_key", KEYS["customer_key"], attributes=("segment", "nation"))


@query("x16_fact_applications", loans_sql("SELECT " + ", ".join(
    [f"{_key_sql(*n)} AS {k}" for k, n in KEYS.items()] + list(MEASURES)) + " FROM staged", _APPLICATIONS, _STAGED))
def x16_fact(spark, sf, rows=None):
    return star.fact(rows or staged(spark, sf), KEYS, MEASURES)


@query("x16_rollup", loans_sql("""SELECT CAST(year(application_ts) AS INTEGER) AS year, segment, loan_intent,
  CAST(3 - grouping(year(application_ts)) - grouping(segment) - grouping(loan_intent) AS INTEGER) AS level,
  count(*) AS n, CAST(sum(loan_amnt) AS BIGINT) AS amount, CAST(sum(loan_status) AS BIGINT) AS defaults,
  round(avg(CAST(loan_status AS DOUBLE)), 6) AS default_rate
FROM staged LEFT JOIN (SELECT c_custkey, c_mktsegment AS segment FROM customer) ON customer_id = c_custkey
GROUP BY ROLLUP (year(application_ts), segment, loan_intent)""", _APPLICATIONS, _STAGED))
def x16_rollup(spark, sf):
    """Year, customer segment, purpose of the loan: from the fact table and three dimensions."""
    rows = (x16_fact(spark, sf).join(x16_date(spark, sf), "date_key").join(x16_customer(spark, sf), "customer_key")
            .join(x16_product(spark, sf), "product_key"))
    measures = {"n": F.count(F.lit(1)), "amount": F.sum("loan_amnt"), "defaults": F.sum("loan_status"),
                "default_rate": r6(F.avg(F.col("loan_status").cast("double")))}
    return star.rollup(rows, ["year", "segment", "loan_intent"], measures)


@query("x16_orphan_keys", "SELECT 'customer_key' AS key, CAST(count(*) AS BIGINT) AS n FROM orders "
                          "WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0")
def x16_orphans(spark, sf):
    """Fact rows without a member in one of the four dimensions: none, if the schema is whole."""
    # two joins lie behind the rows: stored once, as the facts and three dimensions start from them
    rows = durable(staged(spark, sf).select(*dict.fromkeys(c for natural in KEYS.values() for c in natural), *MEASURES))
    dimensions = {"customer_key": x16_customer(spark, sf), "product_key": x16_product(spark, sf, rows),
                  "profile_key": x16_profile(spark, sf, rows), "date_key": x16_date(spark, sf, rows)}
    return star.orphans(x16_fact(spark, sf, rows), dimensions)
