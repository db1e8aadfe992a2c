"""Answers must not depend on the table's size or width."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlab.functions.quantiles import exact_quantiles
from loanlab.operators import profile as prof
from loanlab.plans.prepare_job import Preprocessor, prepare
from loanlab.roles import LOAN_ROLES, Roles
from loanlab.session import path_exists, shared_dir
from loanlab.sources.prepared_store import load_prepared, prepared_exists, save_prepared
from loanlab.sources.readers import read_csv

INF = float("inf")


@pytest.mark.parametrize("limit,bins", [(1_000_000, 4096), (5, 16), (1, 2)])
@pytest.mark.parametrize("values,expected", [
    ([float(v) for v in range(51)] + [INF], [12.75, 25.5, 38.25, INF]),
    ([-INF, -INF] + [float(v) for v in range(50)] + [INF], [11.0, 24.0, 37.0, INF]),
    ([INF] * 30 + [1.0] * 10, [INF, INF, INF, INF]),
    ([-1e308, 0.0, 5e-324, 1.0, 1e308], [0.0, 5e-324, 1.0, 1e308]),
])
def test_quantiles_on_both_paths(spark, values, expected, limit, bins):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(frame, ["x"], [0.25, 0.5, 0.75, 1.0], row_limit=limit, bins=bins)["x"]
    small = exact_quantiles(frame, ["x"], [0.25, 0.5, 0.75, 1.0], at_most=100)["x"]
    assert got == small == expected or all(math.isnan(a) == math.isnan(b) for a, b in zip(got, small)) and got == small


@pytest.mark.parametrize("width,gaps", [(33, [32]), (40, [0, 31, 39]), (70, [5, 64, 69]), (20, range(20))])
def test_correlation_of_wide_tables(spark, width, gaps):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(60, width)) + rng.normal(size=(60, 1))
    for g in gaps:
        x[rng.random(60) < 0.2, g] = np.nan
    names = [f"c{i}" for i in range(width)]
    frame = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x],
                                  ", ".join(f"{n} double" for n in names))
    got = prof.correlation_matrix(frame, names).toPandas().pivot(index="x", columns="y", values="corr")
    expected = pd.DataFrame(x, columns=names).corr()
    assert np.allclose(got.loc[names, names], expected, atol=1e-9)


def test_target_of_many_values(spark):
    frame = spark.range(20_000).select(F.col("id"), F.col("id").alias("y"), F.lit(1.0).alias("x"))
    got = prof.target_analysis(frame, "y")
    assert got.count() == 20_000 and got.select("total_samples").distinct().first()[0] == 20_000
    summary = prof.table_summary(frame, Roles("id", "y", ("x",), ()))
    assert summary.where("section = 'target_distribution'").count() == 20_000
    plans = got._jdf.queryExecution().toString() + summary._jdf.queryExecution().toString()
    assert "collect_list" not in plans


def test_csv_files_with_other_header_orders(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "t" / "b.csv").write_text("y,x\n20,10\n")
    (tmp_path / "t" / "c.csv").write_text("x\n7\n")
    rows = {(r.x, r.y) for r in read_csv(spark, str(tmp_path / "t")).collect()}
    assert rows == {(1.0, 2.0), (10.0, 20.0), (7.0, None)} or rows == {(1, 2.0), (10, 20.0), (7, None)}
    (tmp_path / "q.csv").write_text('x,y\n"a\nb",1\n')
    assert read_csv(spark, str(tmp_path / "q.csv"), multi_line=True).first().x == "a\nb"


def test_train_fit_and_removal_exclude_each_other(loans):
    with pytest.raises(ValueError, match="leak"):
        prepare(loans, LOAN_ROLES, outliers="remove", fit_on="train")


def test_overwriting_takes_the_mark_away_first(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 0.0, [1.0], "train")], "id int, label double, features array<double>, split string")
    save_prepared(rows, ["f"], path)
    assert prepared_exists(spark, path)
    broken = rows.withColumn("id", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        save_prepared(broken, ["f"], path)
    assert not prepared_exists(spark, path) and load_prepared(spark, path) is None
    assert path_exists(spark, shared_dir(spark))


def test_label_log_names_columns_of_many_classes(spark):
    n = 10_050
    df = spark.range(n).select("id", F.lit(0).alias("y"), F.concat(F.lit("v"), "id").alias("wide"),
                               F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("narrow"))
    pre = Preprocessor(Roles("id", "y", (), ("wide", "narrow")))
    pre.encode_categorical(df, "label")
    (wide, details), (narrow, few) = pre.log.steps
    assert (wide, narrow) == ("Label encoded wide", "Label encoded narrow")
    assert details["n_classes"] == n and details["classes"].count() == n
    assert few == {"classes": ["a", "b"]}
    assert pre.log.to_frame(spark).count() == 2
