"""Readers, and checks on the physical plans."""

import pytest
from pyspark.sql import functions as F

from loanlab.operators import evaluate as ev
from loanlab.operators import preprocess as pp
from loanlab.operators import profile as prof
from loanlab.operators import resample as rs
from loanlab.plans.evaluate_queries import scorecards
from loanlab.roles import LOAN_ROLES as R
from loanlab.session import scratch_path
from loanlab.sources.loan_applications import loan_applications
from loanlab.sources.readers import SchemaError, load_loans, load_table, read_csv, validate_schema


def _text(spark, lines):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_missing_tokens_and_inference(spark):
    path = _text(spark, ["a,b,c,d", "1,2.5,x,1", "NA,n/a,null,2", "3,nan,#N/A,3", ",None,y,4"])
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "double", "b": "double", "c": "string", "d": "bigint"}
    rows = df.orderBy("d").collect()
    assert [r["a"] for r in rows] == [1.0, None, 3.0, None]
    assert [r["b"] for r in rows] == [2.5, None, None, None]
    assert [r["c"] for r in rows] == ["x", None, None, "y"]


def test_absent_path(spark):
    with pytest.raises(FileNotFoundError):
        load_loans(spark, scratch_path(spark, "nothing"))


def test_strict_schema(loans):
    validate_schema(loans, R, strict=True)
    with pytest.raises(SchemaError):
        validate_schema(loans.drop("loan_amnt"), R, strict=True)


def test_parquet_load(spark, loans):
    path = scratch_path(spark, "t") + ".parquet"
    loans.write.parquet(path)
    loaded = load_table(spark, path)
    assert loaded.df.count() == loans.count() and loaded.loaded_at
    stamps = loaded.summary().filter("section = 'load_timestamp'").collect()
    assert [r["key"] for r in stamps] == [loaded.loaded_at]
    assert loaded.numeric_stats().count() == 7 and loaded.target_analysis().count() == 2
    assert loaded.categorical_stats().count() > 10 and loaded.feature_info().count() == len(loans.columns)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark, sf):
    return loan_applications(spark, sf)


def test_default_rate_reads_only_its_columns(spark, sf):
    plan = _plan(prof.default_rate_by_category(spark.read.parquet(f"{sf}/lineitem.parquet").withColumn(
        "y", (F.col("l_quantity") > 25).cast("int")), R.__class__("l_orderkey", "y", (), ("l_returnflag",))))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_returnflag" in schema and "l_quantity" in schema and "l_extendedprice" not in schema


def test_no_python_and_no_cross_join_in_expression_operators(raw):
    for df in (prof.table_summary(raw, R), prof.missing_report(raw, R), prof.default_rate_by_category(raw, R),
               prof.correlation_matrix(raw, R.numeric), prof.value_counts(raw, R.categorical),
               pp.fit_preprocessor(raw, R).transform(raw, flat=True)):
        plan = _plan(df)
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_split_and_weights_are_narrow(raw):
    rows = raw.select(R.id, F.col(R.target).cast("double").alias("label"))
    base = _plan(rows).count("Exchange")
    for df in (rs.split(rows, R.id), rs.kfold(rows, R.id), rs.undersample(rows, R.id), rs.balanced_weights(rows)):
        assert _plan(df).count("Exchange") == base and "Window" not in _plan(df)


def test_curves_have_no_single_partition_window(spark, sf):
    plan = _plan(ev.cumulative_counts(scorecards(spark, sf)))
    assert "SinglePartition" not in plan


def test_describe_works_on_any_table(spark, sf):
    got = prof.describe_numeric(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_tax"])
    assert {r["feature"] for r in got.collect()} == {"l_quantity", "l_tax"}


def test_sketched_distinct_counts_are_close(raw):
    exact = {r["feature"]: r["unique_values"] for r in prof.feature_info(raw).collect()}
    near = {r["feature"]: r["unique_values"] for r in prof.feature_info(raw, exact=False).collect()}
    assert all(abs(near[c] - n) <= 0.2 * n + 1 for c, n in exact.items())
