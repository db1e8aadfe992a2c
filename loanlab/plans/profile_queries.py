"""Queries: scans, filters, profile aggregates, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.fixed_values import FEATURE_DICTIONARY, STRATEGY_MEAN, STRATEGY_MEDIAN, STRATEGY_MODE
from loanlab.functions.scalars import r6
from loanlab.operators import outliers as out
from loanlab.operators import preprocess as pp
from loanlab.operators import profile as prof
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import (
    CAT, FENCES, LOAN_COLUMNS, MODES, NUM, TARGET, const, corr_sql, long_cat, long_num, union_all,
)
from loanlab.roles import LOAN_ROLES as R
from loanlab.roles import LOAN_SCHEMA
from loanlab.session import durable, scratch_path
from loanlab.sources.loan_applications import loan_applications, read_table
from loanlab.sources.readers import load_table, read_csv, validate_schema, validate_values

# ---------------------------------------------------------------- scans

_CSV_COLUMNS = [f.name for f in LOAN_SCHEMA]


@query("s1_csv_scan", loans_sql(f"SELECT {', '.join(_CSV_COLUMNS)} FROM loans"))
def s1(spark, sf):
    """Write the table as CSV with a missing token, scan it back with the declared schema."""
    path = scratch_path(spark, "loans-csv")
    (loan_applications(spark, sf).select(*_CSV_COLUMNS)
     .write.option("header", True).option("nullValue", "NA").csv(path))
    return load_table(spark, path).df


@query("s2_load_loans_inferred", loans_sql(
    f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c in ('person_age', 'loan_status', 'cb_person_cred_hist_length') else c for c in _CSV_COLUMNS)} FROM loans"))
def s2(spark, sf):
    """The same scan without a declared schema: types are inferred in one pass."""
    path = scratch_path(spark, "loans-csv")
    (loan_applications(spark, sf).select(*_CSV_COLUMNS)
     .write.option("header", True).option("nullValue", "NaN").csv(path))
    return load_table(spark, path, schema=None).df


_TYPES = {f.name: f.dataType.simpleString() for f in LOAN_SCHEMA}


def _validated_sql():
    rows = []
    for c in dict.fromkeys([*R.expected, *_CSV_COLUMNS]):
        n, bad = f"count({c})", "0"
        if c == "loan_grade":
            n = bad = "max(CAST(NULL AS BIGINT))"
        elif c == "person_age":
            bad = "count(*) FILTER (person_age > 100)"
        rows.append(f"SELECT '{c}' AS \"column\", {'TRUE' if c in R.expected else 'FALSE'} AS expected, "
                    f"{'FALSE' if c == 'loan_grade' else 'TRUE'} AS present, '{_TYPES[c]}' AS type, "
                    f"CAST({n} AS BIGINT) AS n_values, CAST({bad} AS BIGINT) AS n_unreadable FROM loans")
    return loans_sql(union_all(rows))


@query("s3_schema_validation", _validated_sql())
def s3(spark, sf):
    """A CSV without one expected column and with unreadable ages, checked text by text."""
    path = scratch_path(spark, "loans-csv")
    age = F.when(F.col("person_age") > 100, F.lit("over 100")).otherwise(F.col("person_age").cast("string"))
    (loan_applications(spark, sf).select(*_CSV_COLUMNS).drop("loan_grade").withColumn("person_age", age)
     .write.option("header", True).option("nullValue", "NA").csv(path))
    raw = read_csv(spark, path, T.StructType([]))
    validate_schema(raw, R)  # names only: warns
    return validate_values(raw, LOAN_SCHEMA, R)


@query("j4_loan_applications", loans_sql("SELECT * FROM loans"))
def j4(spark, sf):
    return loan_applications(spark, sf)


# ---------------------------------------------------------------- projections and filters

@query("f1_role_projection", loans_sql(f"SELECT app_id, {', '.join(NUM + CAT)}, loan_status FROM loans"))
def f1(spark, sf):
    return loan_applications(spark, sf).select(R.id, *R.features, R.target)


@query("f2_class_filter", loans_sql(
    "SELECT app_id, loan_int_rate FROM loans WHERE loan_status = 1 AND loan_int_rate IS NOT NULL"))
def f2(spark, sf):
    df = loan_applications(spark, sf)
    return df.filter((F.col(R.target) == 1) & F.col("loan_int_rate").isNotNull()).select(R.id, "loan_int_rate")


def _remove_ctes():
    """One filtered table per numeric column, each with fences of the table before it."""
    ctes, last = [], "loans"
    for i, c in enumerate(NUM):
        ctes.append(f"q{i} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {last})")
        ctes.append(f"t{i} AS (SELECT {last}.* FROM {last}, q{i} WHERE {c} >= a - 1.5e0 * (b - a) "
                    f"AND {c} <= b + 1.5e0 * (b - a))")
        last = f"t{i}"
    return ctes, last


@query("f3_remove_outliers", loans_sql(
    f"SELECT app_id, {', '.join(NUM)} FROM {_remove_ctes()[1]}", *_remove_ctes()[0]))
def f3(spark, sf):
    # the table is a join: stored once, as the search for every column's fences starts from it
    rows = durable(loan_applications(spark, sf).select(R.id, *R.numeric))
    return out.handle_outliers(rows, R, "remove").select(R.id, *R.numeric)


@query("f4_clip_outliers", loans_sql(
    "SELECT app_id, " + ", ".join(
        f"round(CASE WHEN {c} IS NULL THEN NULL ELSE greatest({const('fences', 'lo', c)}, "
        f"least(CAST({c} AS DOUBLE), {const('fences', 'hi', c)})) END, 6) AS {c}" for c in NUM) + " FROM loans",
    long_num(), FENCES))
def f4(spark, sf):
    df = out.handle_outliers(loan_applications(spark, sf), R, "clip")
    return df.select(R.id, *[r6(c).alias(c) for c in R.numeric])


@query("f5_outliers_untouched", loans_sql(f"SELECT app_id, {', '.join(NUM)} FROM loans"))
def f5(spark, sf):
    return out.handle_outliers(loan_applications(spark, sf), R, "none").select(R.id, *R.numeric)


@query("f7_preview", loans_sql(f"SELECT {', '.join(_CSV_COLUMNS)} FROM loans ORDER BY app_id LIMIT 100"))
def f7(spark, sf):
    """The preview page: the first 100 rows by id."""
    return loan_applications(spark, sf).select(*_CSV_COLUMNS).orderBy(R.id).limit(100)


# ---------------------------------------------------------------- profile aggregates

_MISSING_CELLS = " + ".join(f"(count(*) - count({c}))" for c in LOAN_COLUMNS)


@query("a1_table_summary", loans_sql(union_all([
    "SELECT 'size' AS section, 'total_records' AS key, count(*) AS value FROM loans",
    f"SELECT 'size', 'total_features', {len(LOAN_COLUMNS)}",
    f"SELECT 'size', 'numerical_features', {len(NUM)}",
    f"SELECT 'size', 'categorical_features', {len(CAT)}",
    f"SELECT 'target_column', '{TARGET}', NULL",
    "SELECT 'target_distribution', CAST(loan_status AS VARCHAR), count(*) FROM loans GROUP BY loan_status",
    *[f"SELECT 'missing_values', '{c}', count(*) - count({c}) FROM loans" for c in LOAN_COLUMNS]])))
def a1(spark, sf):
    return prof.table_summary(loan_applications(spark, sf), R)


def _quote(s):
    return "'" + s.replace("'", "''") + "'"


_WORDS = "words AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_quote(v) for v in row) + ")" for row in FEATURE_DICTIONARY
) + ") AS t(feature, description, type, source, business_relevance))"
_PER_COLUMN = "per_column AS (" + union_all(
    f"SELECT '{c}' AS feature, '{t}' AS dtype, (count(*) - count({c})) * 100e0 / count(*) AS missing_pct, "
    f"count(DISTINCT {c}) AS unique_values FROM loans"
    for c, t in (("app_id", "bigint"), ("application_ts", "timestamp_ntz"), *[(c, "") for c in LOAN_COLUMNS[2:]])
) + ")"
_FEATURE_INFO = """SELECT feature, coalesce(description, 'N/A') AS description, coalesce(type, dtype) AS type,
  coalesce(source, 'N/A') AS source, coalesce(business_relevance, 'N/A') AS business_relevance,
  round(missing_pct, 6) AS missing_pct, unique_values FROM per_column LEFT JOIN words USING (feature)"""


@query("a2_feature_info", loans_sql(_FEATURE_INFO, _WORDS, _PER_COLUMN))
def a2(spark, sf):
    info = prof.feature_info(loan_applications(spark, sf))
    return info.withColumn("missing_pct", r6("missing_pct"))


@query("j2_feature_dictionary", loans_sql(
    "SELECT feature, coalesce(description, 'N/A') AS description, round(missing_pct, 6) AS missing_pct, unique_values "
    "FROM per_column LEFT JOIN words USING (feature)", _WORDS, _PER_COLUMN))
def j2(spark, sf):
    """Dictionary lookup with a default, next to what was counted in the rows."""
    info = prof.feature_info(loan_applications(spark, sf))
    return info.select("feature", "description", r6("missing_pct").alias("missing_pct"), "unique_values")


_DESCRIBE = """SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM num GROUP BY feature"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


@query("a3_describe_numeric", loans_sql(_DESCRIBE, long_num()))
def a3(spark, sf):
    return _rounded(prof.describe_numeric(loan_applications(spark, sf), R.numeric), "mean", "std", "p25", "p50", "p75")


_LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a3_describe_lineitem", "WITH num AS (" + union_all(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in _LINEITEM) + ") " + _DESCRIBE)
def a3_lineitem(spark, sf):
    """Any table works; at this limit the columns are narrowed by bins before values are counted."""
    df = prof.describe_numeric(read_table(spark, sf, "lineitem"), _LINEITEM, row_limit=2_000)
    return _rounded(df, "mean", "std", "p25", "p50", "p75")


@query("a4_value_counts", loans_sql(
    "SELECT feature, value, count(*) AS n FROM cat WHERE value IS NOT NULL GROUP BY feature, value", long_cat()))
def a4(spark, sf):
    return prof.value_counts(loan_applications(spark, sf), R.categorical)


_TARGET_SQL = loans_sql("""
SELECT "class", CASE "class" WHEN 0 THEN 'No Default (Good)' WHEN 1 THEN 'Default (Bad)' END AS label, n,
  round(n * 100e0 / sum(n) OVER (), 6) AS percent,
  round(min(n) OVER () * 1e0 / max(n) OVER (), 6) AS imbalance_ratio,
  min(n) OVER () * 1e0 / max(n) OVER () < 0.5e0 AS is_imbalanced, CAST(sum(n) OVER () AS BIGINT) AS total_samples
FROM (SELECT loan_status AS "class", count(*) AS n FROM loans GROUP BY loan_status)""")


@query("a5_target_analysis", _TARGET_SQL)
def a5(spark, sf):
    return _rounded(prof.target_analysis(loan_applications(spark, sf), R.target), "percent", "imbalance_ratio")


@query("a6_target_overview", loans_sql(
    "SELECT CAST(loan_status AS INT) AS \"class\", count(*) AS n, "
    "round(count(*) * 100e0 / (SELECT count(*) FROM loans), 6) AS percent FROM loans GROUP BY loan_status"))
def a6(spark, sf):
    df = prof.target_analysis(loan_applications(spark, sf), R.target)
    return df.select("class", "n", r6("percent").alias("percent"))


@query("a7_headline_metrics", loans_sql(
    f"SELECT count(*) AS total_records, CAST({len(LOAN_COLUMNS) - 1} AS INT) AS total_features, "
    f"round(avg(loan_status) * 100e0, 6) AS default_rate_pct, "
    f"round(({_MISSING_CELLS}) * 100e0 / (count(*) * {len(LOAN_COLUMNS)}), 6) AS missing_pct FROM loans"))
def a7(spark, sf):
    return _rounded(prof.headline_metrics(loan_applications(spark, sf), R), "default_rate_pct", "missing_pct")


@query("a8_type_histogram", loans_sql(
    "SELECT type, count(*) AS n_columns FROM kinds GROUP BY type",
    "kinds AS (" + union_all(f"""SELECT CASE WHEN any_value(typeof({c})) IN ('INTEGER', 'BIGINT') AND count({c}) = count(*) THEN 'bigint'
  WHEN any_value(typeof({c})) IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'double' ELSE 'string' END AS type FROM loans"""
                             for c in _CSV_COLUMNS) + ")"))
def a8(spark, sf):
    """Types as the values of a CSV show them: a missing number or a fraction makes its column a double."""
    path = scratch_path(spark, "loans-csv")
    (loan_applications(spark, sf).select(*_CSV_COLUMNS)
     .write.option("header", True).option("nullValue", "NA").csv(path))
    return prof.type_histogram(read_csv(spark, path))


def _missing_rows():
    kinds = {"person_home_ownership": "string", "person_emp_length": "double", "loan_int_rate": "double"}
    parts = []
    for c in LOAN_COLUMNS:
        advice = (f"CASE WHEN skewness({c}) > 1 THEN '{STRATEGY_MEDIAN}' ELSE '{STRATEGY_MEAN}' END" if c in NUM
                  else f"'{STRATEGY_MODE}'")
        parts.append(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, "
                     f"round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_pct, "
                     f"'{kinds.get(c, '?')}' AS data_type, {advice} AS imputation_strategy FROM loans")
    return "gaps AS (" + union_all(parts) + ")"


@query("a9_missing_report", loans_sql("SELECT * FROM gaps WHERE missing_count > 0", _missing_rows()))
def a9(spark, sf):
    return prof.missing_report(loan_applications(spark, sf), R)


@query("a10_missing_chart", loans_sql(
    "SELECT feature, missing_count, missing_pct FROM gaps WHERE missing_count > 0 ORDER BY missing_count, feature",
    _missing_rows()))
def a10(spark, sf):
    return prof.missing_chart(loan_applications(spark, sf), R)


def _report_sql(outside):
    return f"""SELECT feature, outlier_count, round(pct, 2) AS outlier_pct, round(lo_v, 2) AS min, round(hi_v, 2) AS max,
  round(mean_v, 2) AS mean, CASE WHEN pct > 5 THEN 'Cap/Floor' ELSE 'Keep' END AS recommendation FROM (
  SELECT feature, count(*) FILTER ({outside}) AS outlier_count,
    count(*) FILTER ({outside}) * 100e0 / nullif(count(value), 0) AS pct,
    min(value) AS lo_v, max(value) AS hi_v, avg(value) AS mean_v
  FROM num JOIN k_ USING (feature) GROUP BY feature)"""


@query("a11_outlier_report_iqr", loans_sql(
    _report_sql("value < lo OR value > hi"), long_num(), FENCES, "k_ AS (SELECT * FROM fences)"))
def a11(spark, sf):
    return out.outlier_report(loan_applications(spark, sf), R, "iqr")


@query("a12_outlier_report_zscore", loans_sql(
    _report_sql("abs((value - mean) / nullif(sd, 0)) > 3"), long_num(),
    "k_ AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd FROM num GROUP BY feature)"))
def a12(spark, sf):
    return out.outlier_report(loan_applications(spark, sf), R, "zscore")


@query("a13_default_rate_by_category", loans_sql("""
SELECT feature, value, CAST(sum(loan_status) AS BIGINT) AS defaults, count(loan_status) AS n,
  round(sum(loan_status) * 100e0 / count(loan_status), 6) AS default_rate
FROM cat WHERE value IS NOT NULL GROUP BY feature, value""", long_cat()))
def a13(spark, sf):
    return _rounded(prof.default_rate_by_category(loan_applications(spark, sf), R), "default_rate")


_CORR = tuple(NUM) + (TARGET,)


@query("a14_correlation_matrix", loans_sql(union_all(
    f"SELECT '{a}' AS x, '{b}' AS y, round({corr_sql(a, b)}, 6) AS corr FROM loans" for a in _CORR for b in _CORR)))
def a14(spark, sf):
    return _rounded(prof.correlation_matrix(loan_applications(spark, sf), _CORR), "corr")


@query("a15_histogram_by_class", loans_sql("""
SELECT feature, loan_status AS "class", bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_lo,
  round(lo + (bin + 1) * (hi - lo) / 20, 6) AS bin_hi, count(*) AS n FROM (
  SELECT *, CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS INT) AS bin FROM num JOIN span USING (feature)
  WHERE value IS NOT NULL)
GROUP BY feature, loan_status, bin, lo, hi""", long_num(),
    "span AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM num GROUP BY feature)"))
def a15(spark, sf):
    return _rounded(prof.histogram_by_class(loan_applications(spark, sf), R), "bin_lo", "bin_hi")


@query("a16_box_plot_stats", loans_sql("""
SELECT feature, min(value) AS min, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
  round(any_value(q3), 6) AS q3, max(value) AS max,
  min(value) FILTER (value >= lo AND value <= hi) AS whisker_lo, max(value) FILTER (value >= lo AND value <= hi) AS whisker_hi,
  count(*) FILTER (value < lo OR value > hi) AS n_outliers
FROM num JOIN fences USING (feature) GROUP BY feature""", long_num(), FENCES))
def a16(spark, sf):
    return _rounded(out.box_plot_stats(loan_applications(spark, sf), R.numeric), "q1", "median", "q3")


@query("a17_target_pie", loans_sql(
    "SELECT loan_status AS \"class\", CASE loan_status WHEN 0 THEN 'No Default (Good)' WHEN 1 THEN 'Default (Bad)' END "
    "AS label, count(*) AS n FROM loans GROUP BY loan_status"))
def a17(spark, sf):
    return prof.target_analysis(loan_applications(spark, sf), R.target).select("class", "label", "n")


# ---------------------------------------------------------------- fitted medians and modes

@query("a19_medians", loans_sql(
    "SELECT feature, round(median(value), 6) AS median FROM num GROUP BY feature", long_num()))
def a19(spark, sf):
    found = pp.medians(loan_applications(spark, sf), R.numeric)
    return _rounded(spark.createDataFrame(list(found.items()), "feature string, median double"), "median")


@query("a20_modes", loans_sql("SELECT feature, value AS mode FROM modes", long_cat(), MODES))
def a20(spark, sf):
    found = pp.modes(loan_applications(spark, sf), R.categorical)
    return spark.createDataFrame(list(found.items()), "feature string, mode string")


@query("h3_adjusted_skewness", loans_sql(
    "SELECT feature, round(skewness(value), 6) AS skewness, skewness(value) > 1 AS is_skewed FROM num GROUP BY feature",
    long_num()))
def h3(spark, sf):
    from loanlab.functions.scalars import adjusted_skewness, rows_from_one
    wide = loan_applications(spark, sf).agg(*[adjusted_skewness(c).alias(c) for c in R.numeric])
    rows = [F.struct(F.lit(c).alias("feature"), r6(c).alias("skewness"), (F.col(c) > 1).alias("is_skewed"))
            for c in R.numeric]
    return rows_from_one(wide, rows)
