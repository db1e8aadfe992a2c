"""Queries: imputation, encoding, scaling, splitting, resampling, prepared-table storage."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlab.functions.scalars import r6
from loanlab.operators import outliers as out
from loanlab.operators import preprocess as pp
from loanlab.operators import resample as rs
from loanlab.operators.neighbors import nearest_neighbors
from loanlab.plans.prepare_job import Preprocessor, prepare
from loanlab.plans.registry import loans_sql, query
from loanlab.plans.sql_parts import (
    CAT, FEATURE_NAMES, FENCES, MODES, NUM, ONE_HOT, const, long_cat, long_num, prep_ctes, split_ctes, union_all,
)
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import durable, scratch_path
from loanlab.sources.loan_applications import loan_applications, read_table
from loanlab.sources.prepared_store import load_prepared, prepared_exists, save_prepared


def labelled(spark, sf):
    """(app_id, label) of the table."""
    return loan_applications(spark, sf).select(R.id, F.col(R.target).cast("double").alias("label"))


def fitted(spark, sf):
    """Clip, then fit the preprocessor: (clipped table, model)."""
    df = durable(loan_applications(spark, sf))  # a join: stored once, as every pass of the fit reads it
    fences = out.fence_constants(df, R.numeric)
    clipped = out.clip(df, fences)
    return clipped, pp.fit_preprocessor(clipped, R, {c: f["median"] for c, f in fences.items()})


_LABELLED = "labelled AS (SELECT app_id, CAST(loan_status AS DOUBLE) AS label FROM loans)"

# ---------------------------------------------------------------- preprocessing


@query("p1_impute_missing", loans_sql(
    "SELECT app_id, " + ", ".join(
        [f"round(coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM loans)), 6) AS {c}" for c in NUM]
        + [f"coalesce({c}, {const('modes', 'value', c)}) AS {c}" for c in CAT]) + " FROM loans", long_cat(), MODES))
def p1(spark, sf):
    df = pp.impute_missing(loan_applications(spark, sf), R)
    return df.select(R.id, *[r6(c).alias(c) for c in R.numeric], *R.categorical)


@query("p2_label_encode", loans_sql(
    "SELECT app_id, " + ", ".join(
        f"(SELECT CAST(i AS INT) FROM codes WHERE feature = '{c}' AND value = coalesce(CAST({c} AS VARCHAR), 'nan')) AS {c}"
        for c in CAT) + " FROM loans", long_cat(),
    "codes AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i FROM "
    "(SELECT DISTINCT feature, coalesce(value, 'nan') AS value FROM cat))"))
def p2(spark, sf):
    df, _ = pp.encode_categorical(loan_applications(spark, sf), R, "label")
    return df.select(R.id, *R.categorical)


@query("p4_one_hot_drop_first", loans_sql(
    "SELECT app_id, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END AS {n}" for c, v, n in ONE_HOT)
    + " FROM filled",
    long_cat(), MODES,
    "filled AS (SELECT app_id, " + ", ".join(f"coalesce({c}, {const('modes', 'value', c)}) AS {c}" for c in CAT)
    + " FROM loans)"))
def p4(spark, sf):
    df = loan_applications(spark, sf)
    flat = pp.fit_preprocessor(df, R).transform(df, flat=True)
    return flat.select(R.id, *[n for _, _, n in ONE_HOT])


_FLAT_SQL = "SELECT app_id, label, " + ", ".join(f"round({n}, 6) AS {n}" for n in FEATURE_NAMES) + " FROM prep"


@query("p5_standard_scale", loans_sql(
    "SELECT app_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUM) + " FROM prep", *prep_ctes(clip=False)))
def p5(spark, sf):
    df = loan_applications(spark, sf)
    flat = pp.fit_preprocessor(df, R).transform(df, flat=True)
    return flat.select(R.id, *[r6(c).alias(c) for c in R.numeric])


@query("p6_fit_transform", loans_sql(_FLAT_SQL, *prep_ctes()))
def p6(spark, sf):
    clipped, model = fitted(spark, sf)
    return model.transform(clipped, flat=True).select(R.id, "label", *[r6(n).alias(n) for n in model.names])


@query("p7_transform_with_saved_constants", loans_sql(
    "SELECT app_id, " + ", ".join(f"round({n}, 6) AS f{i}" for i, n in enumerate(FEATURE_NAMES)) + " FROM prep",
    *prep_ctes()))
def p7(spark, sf):
    """The fitted constants go through their table form; new rows get the feature vector."""
    clipped, model = fitted(spark, sf)
    restored = pp.PreprocessModel.from_frame(model.to_frame(spark), R)
    rows = restored.transform(clipped.drop(R.target)).withColumn("a", vector_to_array("features"))
    return rows.select(R.id, *[r6(F.col("a")[i]).alias(f"f{i}") for i in range(len(restored.names))])


@query("p8_feature_names", loans_sql(
    "SELECT CAST(row_number() OVER (ORDER BY kind, col, value) - 1 AS INT) AS pos, name FROM (" + union_all(
        [f"SELECT 0 AS kind, {i} AS col, '' AS value, '{c}' AS name" for i, c in enumerate(NUM)]
        + [f"SELECT 1, {i}, v, '{c}_' || v FROM (SELECT DISTINCT {c} AS v FROM loans WHERE {c} IS NOT NULL) "
           f"WHERE v > (SELECT min({c}) FROM loans)" for i, c in enumerate(CAT)]) + ")"))
def p8(spark, sf):
    names = pp.fit_preprocessor(loan_applications(spark, sf), R).names
    return spark.createDataFrame(list(enumerate(names)), "pos int, name string")


@query("p9_step_log", loans_sql(union_all(
    [f"SELECT CAST({i} AS INT) AS seq, 'Clipped outliers in {c}' AS step, "
     f"round({const('fences', 'lo', c)}, 6) AS lower_bound, round({const('fences', 'hi', c)}, 6) AS upper_bound, "
     f"CAST(NULL AS VARCHAR) AS value" for i, c in enumerate(NUM)]
    + [f"SELECT {7 + i}, 'Imputed {c} with median', NULL, NULL, "
       f"CAST({const('fences', 'med', c)} AS VARCHAR)" for i, c in enumerate(("person_emp_length", "loan_int_rate"))]
    + [f"SELECT 9, 'Imputed person_home_ownership with mode', NULL, NULL, "
       f"{const('modes', 'value', 'person_home_ownership')}"]), long_num(), long_cat(), FENCES, MODES))
def p9(spark, sf):
    pre = Preprocessor(R)
    pre.impute_missing(pre.handle_outliers(loan_applications(spark, sf)))
    d = F.col("details")
    return pre.log.to_frame(spark).select(
        "seq", "step", r6(F.try_element_at(d, F.lit("lower_bound"))).alias("lower_bound"),
        r6(F.try_element_at(d, F.lit("upper_bound"))).alias("upper_bound"),
        F.try_element_at(d, F.lit("value")).alias("value"))


_COUNTS = split_ctes("labelled", "label")
_BALANCED = """SELECT split, label, CASE WHEN split = 'train' THEN max(n) OVER (PARTITION BY split) ELSE n END AS n, 22 AS n_features
FROM (SELECT split, label, count(*) AS n FROM parted GROUP BY split, label)"""


@query("p10_prepare_job", loans_sql(
    _BALANCED.replace("22 AS", "CAST(22 AS INT) AS"), _LABELLED, *_COUNTS))
def p10(spark, sf):
    """Clip, impute, encode, split, oversample train: rows per split and class, vector size."""
    ready = prepare(durable(loan_applications(spark, sf)), R)
    return ready.rows.groupBy("split", "label").agg(
        F.count("*").alias("n"), F.max(F.size(vector_to_array("features"))).alias("n_features"))


# ---------------------------------------------------------------- split and resample

@query("r1_stratified_split", loans_sql("SELECT app_id, label, split FROM parted", _LABELLED, *_COUNTS))
def r1(spark, sf):
    return rs.split(labelled(spark, sf), R.id)


@query("r2_plain_split", loans_sql(
    """SELECT app_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(app_id AS VARCHAR)))
  <= CAST(ceil((SELECT count(*) FROM loans) * 0.3e0) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM loans"""))
def r2(spark, sf):
    return rs.split(labelled(spark, sf), R.id, test_size=0.3, stratify=False).select(R.id, "split")


@query("r3_undersample", loans_sql(
    """SELECT app_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(app_id AS VARCHAR))) AS r
  FROM labelled) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))""", _LABELLED))
def r3(spark, sf):
    return rs.undersample(labelled(spark, sf), R.id)


@query("r4_smote", loans_sql(
    """SELECT label, CAST(max(n) OVER () AS BIGINT) AS n, CAST(max(n) OVER () AS BIGINT) - n AS n_synthetic, TRUE AS inside_class_range,
  count(*) OVER () = 2 AND min(n) OVER () > 5 AS ids_unique
FROM (SELECT label, count(*) AS n FROM labelled GROUP BY label)""", _LABELLED))
def r4(spark, sf):
    """Oversample the whole prepared table; synthetic rows must lie inside their class's ranges."""
    clipped, model = fitted(spark, sf)
    grown = rs.smote(model.transform(clipped), R.id).withColumn("a", vector_to_array("features"))
    width = len(model.names)
    lo = [F.min(F.when(~F.col("synthetic"), F.col("a")[i])) for i in range(width)]
    hi = [F.max(F.when(~F.col("synthetic"), F.col("a")[i])) for i in range(width)]
    slo = [F.min(F.when(F.col("synthetic"), F.col("a")[i])) for i in range(width)]
    shi = [F.max(F.when(F.col("synthetic"), F.col("a")[i])) for i in range(width)]
    inside = F.lit(True)
    for i in range(width):
        inside = inside & (slo[i] >= lo[i] - 1e-9) & (shi[i] <= hi[i] + 1e-9)
    return grown.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"),
        F.coalesce(inside, F.lit(True)).alias("inside_class_range"),
        (F.count_distinct(R.id) == F.count("*")).alias("ids_unique"))


@query("r5_no_resampling", loans_sql("SELECT app_id, label FROM labelled", _LABELLED))
def r5(spark, sf):
    return rs.rebalance(labelled(spark, sf), R.id, method="none")


@query("r6_stratified_kfold", loans_sql("""
SELECT app_id, label, CAST(count(s.fold) AS INT) AS fold
FROM ranked LEFT JOIN sizes s ON s.c = ranked.label AND ranked.r > s.upto
GROUP BY app_id, label""", _LABELLED,
    "cls AS (SELECT label AS c, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND 1 PRECEDING), 0) AS start FROM labelled GROUP BY label)",
    "dealt AS (SELECT c, (start + p) % 5 AS fold, count(*) AS k FROM cls, LATERAL (SELECT unnest(range(n)) AS p) GROUP BY 1, 2)",
    "sizes AS (SELECT c, fold, sum(k) OVER (PARTITION BY c ORDER BY fold) AS upto FROM dealt)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(app_id AS VARCHAR))) AS r FROM labelled)"))
def r6_folds(spark, sf):
    return rs.kfold(labelled(spark, sf), R.id)


@query("r7_balanced_weights", loans_sql(
    """SELECT app_id, label, round((SELECT count(*) FROM labelled) / (2e0 * count(*) OVER (PARTITION BY label)), 6) AS weight
FROM labelled""", _LABELLED))
def r7(spark, sf):
    return rs.balanced_weights(labelled(spark, sf)).withColumn("weight", r6("weight"))


@query("a18_class_counts_before_after", loans_sql("""
SELECT 'before' AS stage, label AS "class", count(*) AS n FROM labelled GROUP BY label
UNION ALL SELECT 'after', label, (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label)) FROM labelled GROUP BY label""",
    _LABELLED))
def a18(spark, sf):
    rows = labelled(spark, sf)
    before = rs.class_count_table(rows).withColumn("stage", F.lit("before"))
    after = rs.class_count_table(rs.rebalance(rows, R.id, method="undersample")).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


# ---------------------------------------------------------------- prepared-table storage

@query("s5_prepared_round_trip", loans_sql(
    "SELECT app_id, label, split, " + ", ".join(f"round({n}, 6) AS {n}" for n in FEATURE_NAMES)
    + " FROM parted", *prep_ctes(), *split_ctes("prep", "label")))
def s5(spark, sf):
    """Save the split table, load it, and read the vectors back by feature name."""
    ready = prepare(loan_applications(spark, sf), R, imbalance="none")
    path = save_prepared(ready.rows, ready.names, scratch_path(spark, "prepared"))
    rows, names = load_prepared(spark, path)
    rows = rows.withColumn("a", vector_to_array("features"))
    return rows.select(R.id, "label", "split", *[r6(F.col("a")[i]).alias(n) for i, n in enumerate(names)])


@query("s6_prepared_exists", loans_sql(
    "SELECT FALSE AS before, TRUE AS after, count(*) AS n FROM loans"))
def s6(spark, sf):
    path = scratch_path(spark, "prepared")
    before = prepared_exists(spark, path)
    rows = labelled(spark, sf).withColumn("split", F.lit("train"))
    save_prepared(rows, ["none"], path)
    after = prepared_exists(spark, path)
    return load_prepared(spark, path)[0].agg(F.count("*").alias("n")).select(
        F.lit(before).alias("before"), F.lit(after).alias("after"), "n")


# ---------------------------------------------------------------- nearest neighbours

@query("j3_nearest_neighbours", """
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(sqrt(list_sum(list_transform(
    list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))
      * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INT) AS rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS r FROM pairs) WHERE r <= 5""")
def j3(spark, sf):
    pts = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return nearest_neighbors(pts, pts, 5, exclude_self=True).drop("label")
