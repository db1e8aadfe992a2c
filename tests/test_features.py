import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlab.operators import fairness as fair
from loanlab.operators import features as ft
from loanlab.operators import selection
from loanlab.plans.portfolio_job import retraining_reasons
from loanlab.roles import Roles
from loanlab.sources.readers import read_csv, validate_values


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 4.0, None, "a"), (2, None, 5, None), (3, float("nan"), 5, "b"), (4, -9.0, 5, "a"), (5, 100.0, None, "a")]
    return spark.createDataFrame(rows, "id int, x double, flat int, c string")


def test_derived_columns_survive_zeros_and_nulls(spark):
    df = spark.createDataFrame([(30, 0, 10, 5, 1.0), (40, 100, 50, 6, None), (None, 100, 50, 6, 0.0)],
                               "person_age int, person_income long, loan_amnt long, cb_person_cred_hist_length int, person_emp_length double")
    got = [(r.debt_to_income, r.age_at_first_credit, r.income_per_employment_year) for r in ft.derive(df).collect()]
    assert got == [(None, 25, 0.0), (0.5, 34, None), (0.5, None, 100.0)]


def test_missing_flags_and_unknown(odd):
    got = {r.id: (r.x_missing, r.c_missing, r.c) for r in ft.fill_unknown(ft.flag_missing(odd, ["x", "c"]), ["c"]).collect()}
    assert got == {1: (0, 0, "a"), 2: (1, 1, "Unknown"), 3: (1, 0, "b"), 4: (0, 0, "a"), 5: (0, 0, "a")}


def test_scalings(odd):
    values = [4.0, -9.0, 100.0]
    low = {r.id: (r.x, r.flat) for r in ft.fit_min_max(odd, ["x", "flat"]).apply(odd).collect()}
    assert low[1][0] == pytest.approx(13 / 109) and low[4][0] == 0 and low[5][0] == 1 and low[2] == (None, 0.0) and low[1][1] is None
    q = np.quantile(values, [0.25, 0.5, 0.75])
    mid = {r.id: r.x_r for r in ft.fit_robust(odd, ["x"]).apply(odd, "_r").collect()}
    assert mid[5] == pytest.approx((100 - q[1]) / (q[2] - q[0])) and mid[3] is None
    none = ft.fit_min_max(odd.limit(0), ["x"])
    assert [r.x for r in none.apply(odd).collect()] == [0.0, None, None, 0.0, 0.0]
    assert ft.fit_robust(odd.limit(0), ["x"]).apply(odd.limit(0)).count() == 0


def test_transforms_and_limits(odd):
    made = {r.id: (r.x_log, r.x_sqrt) for r in ft.transform_skewed(ft.transform_skewed(odd, ["x"]), ["x"], "sqrt").collect()}
    assert made[4] == (pytest.approx(-math.log(10)), -3.0) and made[5][1] == 10.0 and made[3] == (None, None)
    limits = ft.fit_percentiles(odd, ["x"], 0.25, 0.75)
    got = {r.id: (r.x, r.x_outlier) for r in limits.clip(limits.flag(odd)).collect()}
    assert got[4] == (-2.5, 1) and got[5] == (52.0, 1) and got[1] == (4.0, 0) and got[2] == (None, 0) == got[3]
    empty = ft.fit_percentiles(odd.limit(0), ["x"])
    assert empty.clip(odd).where("x = 100").count() == 1 and empty.flag(odd).where("x_outlier = 1").count() == 0
    for wrong in (lambda: ft.transform_skewed(odd, ["x"], "cube"), lambda: ft.fit_percentiles(odd, ["x"], 0.9, 0.1)):
        with pytest.raises(ValueError):
            wrong()


def test_bins(odd):
    got = {r.id: r.b for r in odd.select("id", ft.binned("x", [0, 4], ["low", "mid", "top"]).alias("b")).collect()}
    assert got == {1: "top", 2: None, 3: None, 4: "low", 5: "top"}
    assert ft.equal_width_edges(odd, "x", 2) == [45.5] and ft.equal_width_edges(odd, "flat", 3) == []
    assert ft.equal_frequency_edges(odd, "x", 2) == [4.0] and ft.equal_frequency_edges(odd.limit(0), "x", 2) == []
    assert odd.select(ft.binned("x", []).alias("b")).where("b = '0'").count() == 3
    for edges, labels in (([2, 1], None), ([1], ["one"])):
        with pytest.raises(ValueError):
            ft.binned("x", edges, labels)


def test_redundant_features_follow_the_target(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    good = y + rng.normal(0, 0.3, 500)
    rows = [(int(t), float(g), float(g + e), float(n)) for t, g, e, n in zip(y, good, rng.normal(0, 0.2, 500), rng.normal(0, 1, 500))]
    df = spark.createDataFrame(rows, "y int, good double, worse double, noise double")
    (drop, keep, strength), = ft.redundant_features(df, ["noise", "worse", "good"], "y", 0.8)
    assert (drop, keep) == ("worse", "good") and strength == pytest.approx(abs(np.corrcoef(good, [r[2] for r in rows])[0, 1]))
    assert ft.redundant_features(df, ["noise", "good"], "y", 0.8) == []


def test_fairness_by_group(spark):
    rows = [("a", 0, 0)] * 6 + [("a", 1, 1)] * 2 + [("b", 0, 1)] * 3 + [("b", 0, 0), ("b", 1, 0)] + [(None, 0, 0)]
    got = {r.group: r for r in fair.fairness(spark.createDataFrame(rows, "g string, label int, prediction int"), "g").collect()}
    assert got["a"].approval_rate == 0.75 and got["a"].approval_ratio == 1.0 and got["a"].fair and got["a"].reference == "a"
    assert got["b"].approval_rate == 0.4 and not got["b"].fair and got["b"].tpr_gap == -1.0 and got["b"].fpr == 0.75
    assert got["(missing)"].tpr is None and got["(missing)"].precision is None and got["(missing)"].fair
    named = fair.fairness(spark.createDataFrame(rows, "g string, label int, prediction int"), "g", "b")
    assert named.where("`group` = 'a'").first().approval_ratio == pytest.approx(0.75 / 0.4)
    assert fair.fairness(spark.createDataFrame([], "g string, label int, prediction int"), "g").count() == 0


def test_retraining_reasons(spark):
    rows = [(0, 0.9, 0.1), (1, 0.7, 0.1), (2, None, 0.3), (3, 0.9, None), (4, 0.9, 0.0)]
    got = {r.period: (r.auc_low, r.drifted, r.too_old, r.retrain) for r in retraining_reasons(
        spark.createDataFrame(rows, "period int, roc_auc double, psi double")).collect()}
    assert got == {0: (False, False, False, False), 1: (True, False, False, True), 2: (False, True, False, True),
                   3: (False, False, False, False), 4: (False, False, True, True)}


def test_values_are_checked_against_their_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,age,rate,extra\n1,30,1.5,x\n2,old,NA,y\n3,4.5, 2 ,z\n4,,1e3,\n")
    raw = read_csv(spark, str(tmp_path / "t.csv"), T.StructType([]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("age", T.IntegerType()),
                           T.StructField("rate", T.DoubleType()), T.StructField("gone", T.StringType())])
    got = {r.column: tuple(r)[1:] for r in validate_values(raw, schema, Roles("id", "gone", ("age", "rate"), ())).collect()}
    assert got["age"] == (True, True, "int", 3, 2) and got["rate"] == (True, True, "double", 3, 0)
    assert got["gone"] == (True, False, "string", None, None) and got["id"][3:] == (4, 0) and got["extra"][0] is False
    none = validate_values(raw.limit(0), schema, Roles("id", "gone", ("age", "rate"), ())).collect()
    assert all(r.n_values in (0, None) for r in none)


def test_repeated_ids_are_not_collected(spark, monkeypatch):
    monkeypatch.setattr(selection, "_KEYS_ON_DRIVER", 1)
    rows = spark.range(2000).select(F.lit(7).cast("long").alias("id"))
    counts, cuts = selection.hash_cutoffs(rows, "id", None, 42, lambda c: {s: [5] for s in c})
    assert counts == {None: 2000} and len(cuts[None][0]) == 32


SCRIPT = """
import sys
sys.modules["xxhash"] = None
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
names = entry.queries()
assert not any(n.startswith("op") or n == "pipeline" for n in names), "xxhash cannot be imported here"
assert set(entry.oracle_sql()) <= set(names)
print(len(names))
"""


def test_an_absent_library_leaves_the_other_queries(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr[-1500:]
