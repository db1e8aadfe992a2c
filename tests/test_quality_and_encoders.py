import random

import pytest
from pyspark.sql import functions as F

from loanlab.operators import encoders as enc
from loanlab.operators import quality as q

LOANS = "id long, person_age int, person_income long, loan_amnt long, cb_person_cred_hist_length int, violations string"


def loans_of(spark, *rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], LOANS)


def test_rules_count_and_mark(spark):
    df = loans_of(spark, (30, 100, 1000, 12), (17, 0, 1, 3), (None, None, 5, None), (144, 1, 11, 2), (30, 100, 1001, 13))
    got = {r.rule: r for r in q.check_rules(df).collect()}
    assert {k: (r.n_rows, r.n_checked, r.n_violations) for k, r in got.items()} == {
        "age_range": (5, 4, 2), "income_positive": (5, 4, 1), "loan_within_income": (5, 4, 3), "history_within_age": (5, 4, 2)}
    assert got["age_range"].violation_share == pytest.approx(0.4)
    marked = {r.id: r.violations for r in q.mark_violations(df).collect()}
    assert marked[0] == [] == marked[2] and marked[4] == ["loan_within_income", "history_within_age"]
    good, bad = q.split_by_rules(df)
    assert good.count() == 2 and bad.count() == 3
    none = q.check_rules(df.limit(0)).collect()
    assert len(none) == 4 and all(r.n_rows == 0 and r.violation_share is None for r in none)


def test_dimensions(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, float("nan"), None), (2, None, "b"), (None, 2.0, "c")], "k int, x double, c string")
    got = {(r.dimension, r.subject): r.score for r in q.dimensions(df, ["x", "c"], ["k"], [q.Rule("x_low", "x < 2", "x")]).collect()}
    assert got["completeness", "x"] == 0.5 and got["completeness", "c"] == 0.75 and got["uniqueness", "k"] == 0.75
    assert got["validity", "x_low"] == 0.5  # NaN is not below 2
    assert all(r.score is None for r in q.dimensions(df.limit(0), ["x"], ["k"], []).collect())


def test_duplicates_keep_by_rule(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "k1", None]), rng.choice([None, *range(50)]), i % 7, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int, id int")
    assert {r.k: r.n for r in q.duplicate_groups(df, ["k"]).collect()} == {
        k: sum(r[0] == k for r in rows) for k in ("hot", "k1", None)}
    for descending in (True, False):
        got = {r.k: (r.t, r.id) for r in q.drop_duplicates(df, ["k"], ["t", "id"], descending).collect()}
        pick = max if descending else min
        assert got == {k: pick((r[1], r[3]) for r in rows if r[0] == k and r[1] is not None) for k in ("hot", "k1", None)}
    assert q.drop_duplicates(df, ["k"], ["t"]).columns == df.columns
    assert q.drop_duplicates(df.limit(0), ["k"], ["t"]).count() == 0
    assert q.drop_duplicates(df.unionByName(df), ["k", "t", "v", "id"], ["id"]).count() == 400


# ---------------------------------------------------------------- encodings

def cats(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None, f"u{i}"]), rng.choice("xy"), rng.choice([0, 1, 1, None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, c string, d string, y int")


def test_target_codes_leave_their_own_fold_out(spark):
    rows, df = cats(spark)
    fit = enc.fit_target_encoding(df, ["c", "d"], "y", "id", 4, 3.0)
    folds = {r.id: r.f for r in df.select("id", enc.fold_of("id", 4).alias("f")).collect()}
    assert set(folds.values()) == {0, 1, 2, 3}
    got = {r.id: r for r in fit.apply(df, ["c", "d"]).collect()}
    assert len(got) == 300
    for i, c, d, y in rows:
        rest = [r for r in rows if folds[r[0]] != folds[i] and r[3] is not None]
        prior = sum(r[3] for r in rest) / len(rest)
        for code, at, value in ((got[i].c_te, 1, c), (got[i].d_te, 2, d)):
            mine = [r[3] for r in rest if r[at] == value]
            assert code == pytest.approx((sum(mine) + 3.0 * prior) / (len(mine) + 3.0))
    # a changed label changes no code of its own row
    flipped = spark.createDataFrame([(i, c, d, 1 - y if i == 5 and y is not None else y) for i, c, d, y in rows],
                                    "id long, c string, d string, y int")
    again = enc.fit_target_encoding(flipped, ["c", "d"], "y", "id", 4, 3.0).apply(flipped, ["c", "d"])
    assert again.where("id = 5").first().c_te == pytest.approx(got[5].c_te)


def test_new_rows_and_empty_fits(spark):
    rows, df = cats(spark)
    fit = enc.fit_target_encoding(df, ["c"], "y", "id", 4, 3.0)
    labelled = [r for r in rows if r[3] is not None]
    prior = sum(r[3] for r in labelled) / len(labelled)
    new = spark.createDataFrame([(1, "hot"), (2, "never seen"), (3, None)], "id long, c string")
    got = {r.id: r.c_te for r in fit.apply(new, ["c"], new_rows=True).collect()}
    hot = [r[3] for r in labelled if r[1] == "hot"]
    assert got[1] == pytest.approx((sum(hot) + 3.0 * prior) / (len(hot) + 3.0)) and got[2] == pytest.approx(prior)
    empty = enc.fit_target_encoding(df.limit(0), ["c"], "y", "id")
    assert empty.table.count() == 0 and empty.apply(new, ["c"]).where("c_te <> 0").count() == 0
    with pytest.raises(ValueError):
        enc.fit_target_encoding(df, ["c"], "y", "id", folds=1)


def test_rare_ordinal_and_binary(spark):
    rows, df = cats(spark)
    merged = enc.merge_rare(df, ["c"], 5)
    names = {r.c for r in merged.select("c").distinct().collect()}
    assert names == {"hot", "b", "c", "nan", "(rare)"} and merged.count() == 300 and merged.columns[0] == "id"
    counts = enc.category_counts(merged, ["c", "d"])
    by_value = {(r.feature, r.value): r.code for r in enc.ordinal_codes(counts).collect()}
    assert [v for (f, v), _ in sorted(by_value.items(), key=lambda e: e[1]) if f == "c"] == ["(rare)", "b", "c", "hot", "nan"]
    often = {r.value: r.code for r in enc.ordinal_codes(counts, "frequency").where("feature = 'c'").collect()}
    assert often["hot"] == 0 and sorted(often.values()) == [0, 1, 2, 3, 4]
    codes = enc.ordinal_codes(counts)
    odd = spark.createDataFrame([("hot",), ("unseen",), (None,)], "c string")
    assert {r.c: r.c_code for r in enc.apply_codes(odd, codes, ["c"]).collect()} == {"hot": 3, "unseen": 5, None: 4}
    bits = {r.c: (r.c_bit0, r.c_bit1, r.c_bit2) for r in enc.binary_columns(odd, codes, ["c"]).collect()}
    assert bits == {"hot": (0, 0, 1), "unseen": (0, 0, 0), None: (1, 0, 1)}
    with pytest.raises(ValueError):
        enc.ordinal_codes(counts, "colour")


def test_a_very_large_column_stays_out_of_the_driver(spark):
    df = spark.range(60_000).select("id", F.concat(F.lit("v"), F.col("id") % 30_000).alias("c"), (F.col("id") % 2).alias("y"))
    codes = enc.ordinal_codes(enc.category_counts(df, ["c"]))
    coded = enc.apply_codes(df, codes, ["c"])
    assert coded.select("c_code").distinct().count() == 30_000 and coded.agg(F.max("c_code")).first()[0] == 29_999
