"""The `loan_applications` table, derived from `orders` and `customer`.

The SQL text is portable: Spark and DuckDB give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOANS_CTE = """
k AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS price, o_orderdate AS ts, c_acctbal AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey
), u AS (
  SELECT k, ck, price, ts, bal,
    CAST(((k % 9973) * (k % 9967) * 48271 + k * 16807 + 101) % 2147483647 AS DOUBLE) / 2147483647e0 AS u1,
    CAST(((k % 9949) * (k % 9941) * 69621 + k * 16807 + 202) % 2147483647 AS DOUBLE) / 2147483647e0 AS u2,
    CAST(((k % 9931) * (k % 9929) * 39373 + k * 16807 + 303) % 2147483647 AS DOUBLE) / 2147483647e0 AS u3,
    CAST(((k % 9923) * (k % 9907) * 40692 + k * 16807 + 404) % 2147483647 AS DOUBLE) / 2147483647e0 AS u4,
    CAST(((k % 9901) * (k % 9887) * 45991 + k * 16807 + 505) % 2147483647 AS DOUBLE) / 2147483647e0 AS u5
  FROM k
), f AS (
  SELECT k, ts, u5,
    CASE WHEN k % 997 = 0 THEN 144 ELSE CAST(FLOOR(20e0 + 45e0 * u1 * u1) AS INT) END AS person_age,
    CAST(FLOOR(12000e0 + (ABS(bal) + 2000e0) * (2e0 + 12e0 * u2 * u2)) AS BIGINT) AS person_income,
    CASE WHEN k % 211 = 0 THEN NULL WHEN k % 89 = 0 THEN 'OTHER' WHEN u3 < 0.5e0 THEN 'RENT'
         WHEN u3 < 0.9e0 THEN 'MORTGAGE' ELSE 'OWN' END AS person_home_ownership,
    CASE WHEN k % 37 = 0 THEN NULL ELSE CAST(FLOOR(14e0 * u2 * u4) AS DOUBLE) END AS person_emp_length,
    CASE (k * 7 + ck) % 6 WHEN 0 THEN 'PERSONAL' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'MEDICAL'
         WHEN 3 THEN 'VENTURE' WHEN 4 THEN 'DEBTCONSOLIDATION' ELSE 'HOMEIMPROVEMENT' END AS loan_intent,
    CASE WHEN u4 < 0.33e0 THEN 0 WHEN u4 < 0.65e0 THEN 1 WHEN u4 < 0.85e0 THEN 2 WHEN u4 < 0.95e0 THEN 3
         WHEN u4 < 0.98e0 THEN 4 WHEN u4 < 0.995e0 THEN 5 ELSE 6 END AS g,
    CAST(FLOOR(500e0 + price * 0.07e0) AS BIGINT) AS loan_amnt,
    CASE WHEN u1 * u3 > 0.45e0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
    CAST(FLOOR(2e0 + 15e0 * u1 * u2) AS INT) AS cb_person_cred_hist_length
  FROM u
), loans AS (
SELECT k AS app_id, ts AS application_ts, person_age, person_income, person_home_ownership, person_emp_length, loan_intent,
  CASE g WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'F' ELSE 'G' END AS loan_grade,
  loan_amnt,
  CASE WHEN k % 11 = 0 THEN NULL ELSE FLOOR((6e0 + 2.2e0 * g + 2e0 * u5) * 100e0) / 100e0 END AS loan_int_rate,
  CASE WHEN 0.35e0 * g + 1.6e0 * LEAST(CAST(loan_amnt AS DOUBLE) / person_income, 1e0)
       + CASE WHEN cb_person_default_on_file = 'Y' THEN 0.4e0 ELSE 0e0 END
       + CASE WHEN person_home_ownership = 'RENT' THEN 0.25e0 ELSE 0e0 END + 0.9e0 * u5 > 2.25e0 THEN 1 ELSE 0 END AS loan_status,
  FLOOR(CAST(loan_amnt AS DOUBLE) / person_income * 100e0) / 100e0 AS loan_percent_income,
  cb_person_default_on_file, cb_person_cred_hist_length
FROM f
)"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loan_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. The join strategy is left to Spark, which checks the side sizes."""
    text = f"WITH {LOANS_CTE} SELECT * FROM loans"
    text = text.replace("FROM orders JOIN customer ON", "FROM {orders} JOIN {customer} ON")
    return spark.sql(text, orders=read_table(spark, sf_dir, "orders"),
                     customer=read_table(spark, sf_dir, "customer"))
