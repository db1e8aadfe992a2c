"""SQL fragments shared by the oracle strings (DuckDB dialect)."""

from __future__ import annotations

from loanlab.roles import LOAN_ROLES as R

NUM, CAT, TARGET, ID = R.numeric, R.categorical, R.target, R.id
LOAN_COLUMNS = (
    "app_id", "application_ts", "person_age", "person_income", "person_home_ownership", "person_emp_length",
    "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate", "loan_status", "loan_percent_income",
    "cb_person_default_on_file", "cb_person_cred_hist_length",
)


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


def long_num(table="loans", cols=NUM, name="num") -> str:
    return f"{name} AS (" + union_all(
        f"SELECT app_id, loan_status, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table}" for c in cols) + ")"


def long_cat(table="loans", cols=CAT, name="cat") -> str:
    return f"{name} AS (" + union_all(
        f"SELECT app_id, loan_status, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {table}"
        for c in cols) + ")"


FENCES = """fences AS (
  SELECT feature, q1, med, q3, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM (
    SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
           quantile_cont(value, 0.75) AS q3
    FROM num WHERE value IS NOT NULL GROUP BY feature))"""

MODES = """modes AS (
  SELECT feature, value FROM (
    SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r
    FROM (SELECT feature, value, count(*) AS n FROM cat WHERE value IS NOT NULL GROUP BY feature, value))
  WHERE r = 1)"""

GRADES = "ABCDEFG"
CATEGORIES = {
    "person_home_ownership": ("MORTGAGE", "OTHER", "OWN", "RENT"),
    "loan_intent": ("DEBTCONSOLIDATION", "EDUCATION", "HOMEIMPROVEMENT", "MEDICAL", "PERSONAL", "VENTURE"),
    "loan_grade": tuple(GRADES),
    "cb_person_default_on_file": ("N", "Y"),
}
ONE_HOT = [(c, v, f"{c}_{v}") for c in CAT for v in CATEGORIES[c][1:]]
FEATURE_NAMES = list(NUM) + [n for _, _, n in ONE_HOT]


def const(table, column, feature) -> str:
    return f"(SELECT {column} FROM {table} WHERE feature = '{feature}')"


def prep_ctes(clip: bool = True) -> list[str]:
    """loans -> clipped -> imputed -> scaled + one-hot, as `prep(app_id, label, <22 columns>)`."""
    def clipped(c):
        x = f"CAST({c} AS DOUBLE)"
        if not clip:
            return f"{x} AS {c}"
        return (f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest({const('fences', 'lo', c)}, "
                f"least({x}, {const('fences', 'hi', c)})) END AS {c}")
    cl = "clipped AS (SELECT app_id, loan_status, " + ", ".join(clipped(c) for c in NUM) + ", " + ", ".join(CAT) + \
         " FROM loans)"
    med = "medians AS (" + union_all(f"SELECT '{c}' AS feature, median({c}) AS m FROM clipped" for c in NUM) + ")"
    imp = "imputed AS (SELECT app_id, loan_status, " + ", ".join(
        [f"coalesce({c}, {const('medians', 'm', c)}) AS {c}" for c in NUM]
        + [f"coalesce({c}, {const('modes', 'value', c)}) AS {c}" for c in CAT]) + " FROM clipped)"
    mom = "moments AS (" + union_all(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS sd FROM imputed" for c in NUM) + ")"
    prep = "prep AS (SELECT app_id, CAST(loan_status AS DOUBLE) AS label, " + ", ".join(
        [f"({c} - {const('moments', 'mean', c)}) / coalesce(nullif({const('moments', 'sd', c)}, 0), 1) AS {c}"
         for c in NUM]
        + [f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS {n}" for c, v, n in ONE_HOT]) + " FROM imputed)"
    return [long_num(), long_cat(), FENCES, MODES, cl, med, imp, mom, prep]


def split_ctes(table: str, label: str, test_size: str = "0.2e0", key: str = "app_id") -> list[str]:
    """Exact stratified split of ``table``: `parted(<key>, <label>, h, split)`."""
    return [f"""cls AS (SELECT {label} AS c, count(*) AS n FROM {table} GROUP BY 1)""",
            f"""tot AS (SELECT sum(n) AS n, sum(n) - CAST(ceil(sum(n) * {test_size}) AS BIGINT) AS n_train FROM cls)""",
            """shares AS (
  SELECT c, cls.n AS n, floor(1e0 * tot.n_train * cls.n / tot.n) AS base,
         row_number() OVER (ORDER BY 1e0 * tot.n_train * cls.n / tot.n - floor(1e0 * tot.n_train * cls.n / tot.n) DESC,
                            CAST(c AS VARCHAR)) AS ord,
         tot.n_train - sum(floor(1e0 * tot.n_train * cls.n / tot.n)) OVER () AS spare
  FROM cls, tot)""",
            """quota AS (SELECT c, n - CAST(base AS BIGINT) - CASE WHEN ord <= spare THEN 1 ELSE 0 END AS n_test
  FROM shares)""",
            f"""hashed AS (SELECT *, md5('42:' || CAST({key} AS VARCHAR)) AS h FROM {table})""",
            f"""parted AS (SELECT hashed.*, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY h) <= n_test
  THEN 'test' ELSE 'train' END AS split FROM hashed JOIN quota ON {label} = c)"""]


PREDICTIONS = """preds AS (
  SELECT 'pct_income' AS model_name, app_id AS id, loan_status AS label, loan_percent_income AS score,
         CASE WHEN loan_percent_income > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM loans
  UNION ALL SELECT 'grade', app_id, loan_status, (ascii(loan_grade) - 65) / 6e0,
         CASE WHEN (ascii(loan_grade) - 65) / 6e0 > 0.5e0 THEN 1 ELSE 0 END FROM loans
  UNION ALL SELECT 'constant', app_id, loan_status, 0.5e0, 0 FROM loans)"""

CONFUSION = """conf AS (
  SELECT model_name,
    count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
  FROM preds GROUP BY model_name)"""

CUMULATIVE = """per_score AS (
  SELECT model_name, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM preds GROUP BY model_name, score
), cum AS (
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg,
    CAST(sum(pos) OVER (PARTITION BY model_name) AS BIGINT) AS total_pos,
    CAST(sum(neg) OVER (PARTITION BY model_name) AS BIGINT) AS total_neg,
    lead(pos) OVER (PARTITION BY model_name ORDER BY score DESC) AS next_pos,
    lead(neg) OVER (PARTITION BY model_name ORDER BY score DESC) AS next_neg
  FROM per_score WINDOW w AS (PARTITION BY model_name ORDER BY score DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

AUC = """auc AS (
  SELECT model_name, sum((1e0 * neg * (cum_pos - pos) + 0.5e0 * pos * neg)
                         / nullif(1e0 * total_pos * total_neg, 0)) AS roc_auc
  FROM cum GROUP BY model_name)"""

METRICS = """metrics AS (
  SELECT conf.model_name, (tp + tn) / nullif(1e0 * (tn + fp + fn + tp), 0) AS accuracy,
    coalesce(tp / nullif(1e0 * (tp + fp), 0), 0) AS "precision", coalesce(tp / nullif(1e0 * (tp + fn), 0), 0) AS recall,
    coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0) AS f1, roc_auc
  FROM conf JOIN auc USING (model_name))"""

METRIC_CTES = (PREDICTIONS, CONFUSION, CUMULATIVE, AUC, METRICS)


def corr_sql(a: str, b: str, table: str = "loans") -> str:
    """Pairwise-complete correlation in the same formula as the operator."""
    xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"
