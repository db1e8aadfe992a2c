import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loanlab.operators import drift, learners
from loanlab.plans.prepare_job import prepare
from loanlab.roles import LOAN_ROLES as R
from loanlab.roles import Roles
from loanlab.sources.results_store import write_model
from loanlab.streaming.drift_stream import closed_windows, drift_stream
from loanlab.streaming.scoring_stream import load_preprocessor, save_preprocessor, scoring_stream

SMALL = Roles("id", "y", ("x",), ("c",))
SCHEMA = "id long, t timestamp_ntz, x double, c string, y int"


def day(n, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=hour)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def old(spark):
    rows = [(i, day(i % 10), float(i % 20), "ab"[i % 2], 0) for i in range(200)]
    return rows_of(spark, rows + [(500, None, None, None, 0), (501, day(1), float("nan"), "a", 0)])


def test_bins_survive_storage_and_hold_every_row(spark, old):
    bins = drift.fit_bins(old, SMALL, 5)
    assert drift.DriftBins.from_frame(bins.to_frame(spark)) == bins
    counts = {(r.feature, r.bin): r.n for r in drift.bin_counts(old, bins).collect()}
    assert sum(n for (f, _), n in counts.items() if f == "x") == 202 and counts["x", "missing"] == 2
    assert counts["c", "missing"] == 1 and counts["c", "a"] == 101
    assert len(bins.cuts["x"]) == 4 and all(counts["x", str(i)] == 40 for i in range(5))


def test_index_equals_plain_loop(spark, old):
    bins = drift.fit_bins(old, SMALL, 5)
    new = rows_of(spark, [(i, day(1), float(i % 7) - 3, "az"[i % 2], 0) for i in range(50)])
    a, b = (drift.bin_counts(t, bins) for t in (old, new))
    got = {r.feature: r for r in drift.stability_index(a, b).collect()}
    for feature in ("x", "c"):
        p, q = ({r.bin: r.n for r in t.where(F.col("feature") == feature).collect()} for t in (a, b))
        want = 0.0
        for k in {*p, *q}:
            e, n = max(p.get(k, 0) / 202, 1e-4), max(q.get(k, 0) / 50, 1e-4)
            want += (n - e) * math.log(n / e)
        assert got[feature].psi == pytest.approx(want) and got[feature].n == 50 and got[feature].state == "drifted"
    same = drift.stability_index(a, a).collect()
    assert all(r.psi == 0 and r.state == "stable" for r in same)


def test_empty_and_constant_columns(spark, old):
    none = old.limit(0)
    bins = drift.fit_bins(none, SMALL)
    assert bins.cuts == {"x": ()} and drift.bin_counts(none, bins).count() == 0
    flat = drift.fit_bins(rows_of(spark, [(1, None, 3.0, "a", 0)] * 4), SMALL)
    assert flat.cuts == {"x": (3.0,)}
    counts = drift.bin_counts(old, flat)
    assert drift.stability_index(counts, drift.bin_counts(none, flat)).count() == 0
    assert drift.DriftBins.from_frame(bins.to_frame(spark)) == bins
    with pytest.raises(ValueError):
        drift.fit_bins(old, SMALL, 1)


def test_stream_drops_late_rows_and_goes_on_after_a_restart(spark, old, tmp_path):
    bins = drift.fit_bins(old, SMALL, 5)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = old.schema

    def arrive(rows):
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(source)
        drift_stream(spark, bins, source, schema, sink, state, "t", "10 days", "2 days").awaitTermination()

    first = [(i, day(d), 1.0, "a", 0) for i, d in enumerate([0, 3, 9, 11, 15])] + [(9, None, 1.0, "a", 0)]
    arrive(first)
    total = {r.window_start: r.n for r in closed_windows(spark, sink).where("feature = 'x'").groupBy("window_start")
             .agg(F.sum("n").alias("n")).collect()}
    starts = sorted(total)
    late, open_rows = (50, day(2), 1.0, "a", 0), [(51, day(16), 1.0, "a", 0), (52, day(40), 1.0, "a", 0)]
    arrive([late, *open_rows])  # the first window was closed by the row of day 15
    after = closed_windows(spark, sink).where("feature = 'x'")
    again = {r.window_start: r.n for r in after.groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert all(again[s] == total[s] for s in starts)          # what was written stays as it was
    counted = rows_of(spark, first + open_rows).withColumn("i", drift.instant_of("t")).where("i IS NOT NULL")
    batch = {r.window_start: r.n for r in drift.window_counts(counted, bins, "i", "10 days").where("feature = 'x'").select(
        drift.clock_of("window.start").alias("window_start"), drift.clock_of("window.end").alias("e"), "n").where(
        F.col("e") <= F.lit(day(38)).cast("timestamp_ntz")).collect()}
    assert again == batch and sum(batch.values()) == 6        # the late row is not in


def test_scoring_stream_equals_batch(spark, loans, tmp_path):
    ready = prepare(loans, R, outliers="none", imbalance="none")
    train = ready.rows.where("split = 'train'").drop("split")
    place = str(tmp_path)
    save_preprocessor(spark, ready.model, f"{place}/pre")
    again = load_preprocessor(spark, f"{place}/pre", R)
    assert again.numeric == ready.model.numeric and again.categorical == ready.model.categorical
    for name in ("Logistic Regression", "Naive Bayes"):
        model, slug = learners.fit_model(name, train, R.id), name[:2]
        write_model(spark, model, f"{place}/{slug}")
        for part in (0, 1):
            loans.where(F.col(R.id) % 2 == part).write.mode("append").parquet(f"{place}/{slug}-in")
            for _ in range(2):  # the second start finds nothing new
                scoring_stream(spark, f"{place}/pre", f"{place}/{slug}", R, f"{place}/{slug}-in", loans.schema,
                               f"{place}/{slug}-out", f"{place}/{slug}-state").awaitTermination()
        got = {r.id: (r.score, r.prediction) for r in spark.read.parquet(f"{place}/{slug}-out").collect()}
        want = {r.id: (r.score, r.prediction) for r in learners.predict(
            name, model, ready.model.transform(loans), R.id).collect()}
        assert len(got) == loans.count() and got.keys() == want.keys()
        assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)


def test_models_that_join_are_refused(spark, loans, tmp_path):
    ready = prepare(loans, R, outliers="none", imbalance="none")
    save_preprocessor(spark, ready.model, f"{tmp_path}/pre")
    model = learners.fit_model("K-Nearest Neighbors", ready.rows.where("split = 'train'").limit(50).drop("split"), R.id)
    write_model(spark, model, f"{tmp_path}/knn")
    with pytest.raises(ValueError):
        scoring_stream(spark, f"{tmp_path}/pre", f"{tmp_path}/knn", R, f"{tmp_path}/in", loans.schema, f"{tmp_path}/out",
                       f"{tmp_path}/state")
