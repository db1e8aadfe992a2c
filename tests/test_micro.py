"""Small inputs with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loanlab.functions.quantiles import exact_quantiles
from loanlab.functions.scalars import adjusted_skewness, nan_to_null
from loanlab.operators import evaluate as ev
from loanlab.operators import outliers as out
from loanlab.operators import preprocess as pp
from loanlab.operators import profile as prof
from loanlab.operators import resample as rs
from loanlab.operators.ranking import running_totals
from loanlab.roles import Roles

SIX = [1.0, 2.0, 2.5, 7.0, 11.0, 50.0, None]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(SIX)], "id int, x double")


ROLES = Roles("id", "y", ("x",), ())


def test_quantiles_std_skew(six):
    row = prof.describe_numeric(six, ["x"]).first()
    assert (row["p25"], row["p50"], row["p75"], row["count"]) == (2.125, 4.75, 10.0, 6)
    assert row["std"] == pytest.approx(18.872599, abs=1e-6)
    skew = six.agg(adjusted_skewness("x").alias("s")).first()["s"]
    assert skew == pytest.approx(2.241398, abs=1e-6)


@pytest.mark.parametrize("limit,bins", [(1_000_000, 4096), (2, 2), (1, 3)])
def test_quantiles_by_narrowing(six, limit, bins):
    q = exact_quantiles(six, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], row_limit=limit, bins=bins)
    assert q["x"] == [1.0, 2.125, 4.75, 10.0, 50.0]


def test_quantiles_in_one_pass(six, spark):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    wide = six.withColumn("empty", F.lit(None).cast("double")).withColumn("one", F.lit(4))
    q = exact_quantiles(wide, ["x", "empty", "one"], probs, at_most=7)
    assert q == {"x": [1.0, 2.125, 4.75, 10.0, 50.0], "empty": [None] * 5, "one": [4.0] * 5}


def test_quantiles_of_a_column_that_is_mostly_one_value(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 1000).cast("double")).alias("x"))
    want = sorted(r["x"] for r in df.collect())
    got = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], row_limit=10, bins=7)["x"]
    for p, v in zip((0.1, 0.5, 0.9), got):
        at = p * (len(want) - 1)
        lo = math.floor(at)
        assert v == pytest.approx(want[lo] + (at - lo) * (want[lo + 1] - want[lo]))


def test_quantiles_span_magnitudes(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1e200, -3.0, 0.0, 1e-9, 2.0, 1e12, 1e300)], "x double")
    got = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], row_limit=1, bins=4)["x"]
    assert got == [-1e200, 1e-9, 1e300]


def test_iqr_outliers_and_clip(six):
    row = out.outlier_report(six, ROLES).first()
    assert (row["outlier_count"], row["outlier_pct"], row["recommendation"]) == (1, 16.67, "Cap/Floor")
    fences = out.fence_constants(six, ["x"])["x"]
    assert (fences["lower"], fences["upper"]) == (-9.6875, 21.8125)
    clipped = {r["id"]: r["x"] for r in out.handle_outliers(six, ROLES).collect()}
    assert clipped[5] == 21.8125 and clipped[6] is None and clipped[0] == 1.0


def test_clip_is_idempotent_at_fixed_fences(six):
    fences = out.fence_constants(six, ["x"])
    once = out.clip(six, fences)
    assert out.clip(once, fences).collect() == once.collect()


def test_remove_drops_missing_and_refits_fences(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 3.0, 3.0), (3, None, 2.0), (4, 500.0, 90.0), (5, 2.0, 2.5), (6, 1.5, 40.0)],
        "id int, a double, b double")
    roles = Roles("id", "y", ("a", "b"), ())
    assert {r["id"] for r in out.handle_outliers(df, roles, "remove").collect()} == {0, 1, 2, 5}


def test_unknown_methods_raise(six):
    with pytest.raises(ValueError):
        out.handle_outliers(six, ROLES, "bogus")
    with pytest.raises(ValueError):
        out.outlier_report(six, ROLES, "bogus")
    with pytest.raises(ValueError):
        rs.rebalance(six, "id", method="bogus")
    with pytest.raises(ValueError):
        pp.encode_categorical(six, ROLES, "bogus")


def test_zscore_of_a_constant_column_finds_nothing(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "id int, x double")
    row = out.outlier_report(df, ROLES, "zscore").first()
    assert (row["outlier_count"], row["outlier_pct"]) == (0, 0.0)


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert pp.modes(df, ["c"]) == {"c": "a"}


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 1.0, None, float(i), i % 2) for i in range(3)],
                               "id int, c double, e double, v double, y int")
    roles = Roles("id", "y", ("c", "e", "v"), ())
    corr = {(r["x"], r["y"]): r["corr"] for r in prof.correlation_matrix(df, ["c", "e", "v"]).collect()}
    assert corr[("v", "v")] == 1.0 and len(corr) == 9
    assert all(corr[k] is None for k in corr if k != ("v", "v"))
    stats = {r["feature"]: r for r in prof.describe_numeric(df, ["c", "e", "v"]).collect()}
    assert stats["e"]["count"] == 0 and stats["e"]["p50"] is None
    missing = {r["feature"]: r for r in prof.missing_report(df, roles).collect()}
    assert missing["e"]["missing_pct"] == 100.0 and set(missing) == {"e"}
    scaled = pp.fit_preprocessor(df, roles).transform(df, flat=True).collect()
    assert {r["c"] for r in scaled} == {0.0} and {r["e"] for r in scaled} == {0.0}
    assert out.outlier_report(df, roles).count() == 3
    assert prof.histogram_by_class(df, roles, bins=2).filter("feature = 'c'").count() == 2


def test_correlation_with_a_side_that_is_constant_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0), (9.0, None), (4.0, None)], "a double, b double")
    corr = {(r["x"], r["y"]): r["corr"] for r in prof.correlation_matrix(df, ["a", "b"]).collect()}
    assert corr[("a", "b")] is None and corr[("a", "a")] == 1.0


def test_population_scaling(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 4.0, 0.5])), "id int, x double")
    got = [r["x"] for r in pp.fit_preprocessor(df, ROLES).transform(df, flat=True).orderBy("id").collect()]
    # (x - 1.875) / sqrt(1.796875)
    assert got == pytest.approx([-0.652753, 0.093250, 1.585258, -1.025755], abs=1e-6)


def test_one_hot_drops_the_first_and_ignores_unknown(spark):
    roles = Roles("id", "y", (), ("c",))
    fit = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id int, c string")
    new = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "z")], "id int, c string")
    model = pp.fit_preprocessor(fit, roles)
    assert model.names == ("c_b", "c_c")
    got = [(r["c_b"], r["c_c"]) for r in model.transform(new, flat=True).orderBy("id").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]


def test_one_hot_refuses_too_many_categories(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(pp.CardinalityError):
        pp.fit_preprocessor(df, Roles("id", "y", (), ("c",)), category_limit=10)


@pytest.mark.parametrize("limit", [10_000, 1])
def test_label_encode_with_missing(spark, limit):
    df = spark.createDataFrame([(0, "x"), (1, None), (2, "a")], "id int, c string")
    got = pp.fit_labels(df, ["c"], limit).apply(df).orderBy("id").collect()
    assert [r["c"] for r in got] == [2, 1, 0]


def test_preprocess_constants_survive_their_table_form(spark, loans):
    from loanlab.roles import LOAN_ROLES
    model = pp.fit_preprocessor(loans, LOAN_ROLES)
    again = pp.PreprocessModel.from_frame(model.to_frame(spark), LOAN_ROLES)
    assert again.numeric == model.numeric and again.categorical == model.categorical


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, x double"))
    assert [r["x"] for r in df.orderBy("id").collect()] == [None, 3.0] and dict(df.dtypes)["x"] == "double"


# ---------------------------------------------------------------- sampling

def _labelled(spark, zeros, ones):
    return spark.createDataFrame([(i, float(i >= zeros)) for i in range(zeros + ones)], "id int, label double")


def _sizes(df, *by):
    return {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


def test_stratified_split_sizes(spark):
    got = _sizes(rs.split(_labelled(spark, 7, 3), "id"), "split", "label")
    assert got == {("test", 0.0): 1, ("test", 1.0): 1, ("train", 0.0): 6, ("train", 1.0): 2}


def test_split_does_not_depend_on_partitioning(spark):
    rows = _labelled(spark, 700, 300)
    a = {tuple(r) for r in rs.split(rows.repartition(1), "id").collect()}
    b = {tuple(r) for r in rs.split(rows.repartition(13), "id").collect()}
    assert a == b


def test_cutoffs_descend_into_crowded_prefixes(spark, monkeypatch):
    from loanlab.operators import selection
    monkeypatch.setattr(selection, "_KEYS_ON_DRIVER", 1)
    got = _sizes(rs.split(_labelled(spark, 900, 100), "id", test_size=0.33), "split")
    assert got == {("test",): 330, ("train",): 670}


def test_undersample(spark):
    small = rs.undersample(_labelled(spark, 6, 2), "id")
    assert _sizes(small, "label") == {(0.0,): 2, (1.0,): 2}
    assert small.select("id").distinct().count() == 4


def test_folds_cover_and_are_level(spark):
    folded = rs.kfold(_labelled(spark, 23, 9), "id", k=5)
    assert folded.count() == 32
    totals = _sizes(folded, "fold")
    assert max(totals.values()) - min(totals.values()) <= 1
    per_class = _sizes(folded, "label", "fold")
    for label in (0.0, 1.0):
        sizes = [per_class.get((label, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_balanced_weights(spark):
    got = {r["label"]: r["weight"] for r in rs.balanced_weights(_labelled(spark, 6, 2)).distinct().collect()}
    assert got == {0.0: pytest.approx(8 / 12), 1.0: pytest.approx(2.0)}


# ---------------------------------------------------------------- evaluation

def _scored(spark, rows, name="m"):
    return spark.createDataFrame(
        [(name, i, y, s, int(s > 0.5)) for i, (y, s) in enumerate(rows)],
        "model_name string, id int, label int, score double, prediction int")


@pytest.mark.parametrize("rows,auc,ap", [
    ([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], 0.75, 0.833333),
    ([(0, 0.5), (1, 0.5), (0, 0.2), (1, 0.9)], 0.875, 0.833333),
])
def test_auc_and_average_precision(spark, rows, auc, ap):
    p = _scored(spark, rows)
    assert ev.roc_auc(p).first()["roc_auc"] == pytest.approx(auc)
    assert ev.average_precision(p).first()["average_precision"] == pytest.approx(ap, abs=1e-6)


def test_auc_is_unchanged_by_monotone_transforms(spark):
    p = _scored(spark, [(int(i % 3 == 0), ((i * 7919) % 101) / 101) for i in range(300)])
    a = ev.roc_auc(p).first()["roc_auc"]
    assert ev.roc_auc(p.withColumn("score", F.exp(5 * F.col("score")))).first()["roc_auc"] == pytest.approx(a)


def test_single_class(spark):
    p = _scored(spark, [(1, 0.3), (1, 0.9)])
    assert ev.roc_auc(p).first()["roc_auc"] is None
    c = ev.confusion(p).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (0, 0, 1, 1)


def test_no_positive_predictions(spark):
    row = ev.classification_metrics(_scored(spark, [(0, 0.1), (1, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_roc_curve_points(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (1, 0.5)]
    pts = [(r["threshold"], r["fpr"], r["tpr"]) for r in ev.roc_curve(_scored(spark, rows)).orderBy(
        F.desc("threshold")).collect()]
    assert [p[0] for p in pts] == [math.inf, 0.9, 0.8, 0.6, 0.5]  # 0.7 lies on a straight line
    assert pts[-1][1:] == (1.0, 1.0)


def test_model_without_scores_counts_as_zero_auc(spark):
    p = _scored(spark, [(0, 0.1), (1, 0.9)]).withColumn("score", F.lit(None).cast("double"))
    assert ev.evaluate(p).first()["roc_auc"] == 0.0


def test_best_model_and_rank_ties_go_by_name(spark):
    m = spark.createDataFrame([("b", .1, .1, .1, .1, .9), ("a", .1, .1, .1, .1, .9), ("c", .1, .1, .1, .1, .2)],
                              "model_name string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    assert ev.best_model(m).first()["model_name"] == "a"
    assert [r["model_name"] for r in ev.sorted_comparison(m).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("ascending", [True, False])
def test_running_totals_over_many_partitions(spark, ascending):
    rows = [(g, i, (i * 31) % 17) for g in ("a", "b") for i in range(500)] + [("lone", 1, 4)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(7)
    got = {(r["g"], r["k"]): r for r in running_totals(df, ["g"], "k", ["v"], ascending, following=True).collect()}
    for g in ("a", "b", "lone"):
        run, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=not ascending)
        for at, (_, k, v) in enumerate(mine):
            run += v
            nxt = mine[at + 1][2] if at + 1 < len(mine) else None
            r = got[(g, k)]
            assert (r["cum_v"], r["next_v"], r["total_v"]) == (run, nxt, sum(m[2] for m in mine))
