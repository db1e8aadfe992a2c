"""Time operators on the loan table and on ten shifted copies of it.

    python tools/scale_check.py [sf_dir]

The copies have their own ids; every other column repeats, so group sizes grow with the
table while the number of distinct values stays, and copies of one point are common. For
the neighbour join and oversampling the copies are jittered to keep points distinct.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from loanlab.operators import evaluate, learners, outliers, preprocess, profile, resample
    from loanlab.plans.prepare_job import prepare
    from loanlab.roles import LOAN_ROLES as R
    from loanlab.session import scratch_path
    from loanlab.sources.loan_applications import loan_applications

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loanlab-"))
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    one = loan_applications(spark, argv[0] if argv else "/root/testdata/sf0.1")
    sizes = {}
    for times in (1, 10):
        copies = one.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        jitter = 1 + F.col("_c") / 1e5
        rows = (copies.withColumn(R.id, F.col(R.id) * 10 + F.col("_c"))
                .withColumn("person_income", (F.col("person_income") * jitter).cast("bigint"))
                .withColumn("loan_int_rate", F.col("loan_int_rate") * jitter).drop("_c"))
        path = scratch_path(spark, f"scale{times}") + ".parquet"
        rows.repartition(16).write.parquet(path)
        sizes[times] = spark.read.parquet(path)

    def cards(df):
        score = F.col("loan_int_rate") / 25
        return df.filter("loan_int_rate IS NOT NULL").select(
            F.lit("rate").alias("model_name"), F.col(R.id).alias("id"), F.col(R.target).alias("label"),
            score.alias("score"), evaluate.decide(score).alias("prediction"))

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def labelled(df):
        return df.select(R.id, F.col(R.target).cast("double").alias("label"))

    steps = {
        "default rate by category": lambda d: run(profile.default_rate_by_category(d, R)),
        "correlation matrix": lambda d: run(profile.correlation_matrix(d, [*R.numeric, R.target])),
        "describe (exact quantiles)": lambda d: run(profile.describe_numeric(d, R.numeric)),
        "feature info (exact distinct)": lambda d: run(profile.feature_info(d)),
        "clip outliers": lambda d: run(outliers.handle_outliers(d, R)),
        "fit and transform": lambda d: run(preprocess.fit_preprocessor(d, R).transform(d)),
        "stratified split": lambda d: run(resample.split(labelled(d), R.id)),
        "five folds": lambda d: run(resample.kfold(labelled(d), R.id)),
        "ROC-AUC": lambda d: run(evaluate.roc_auc(cards(d))),
        "naive Bayes fit": lambda d: learners.fit_naive_bayes(
            preprocess.fit_preprocessor(d, R).transform(d), R.id),
        "prepare with oversampling": lambda d: run(prepare(d, R).rows),
    }
    picks = argv[1:]
    print(f"{'step':32s}{'1x':>9s}{'10x':>9s}{'ratio':>8s}")
    for name, step in steps.items():
        if picks and not any(p in name for p in picks):
            continue
        step(sizes[1])
        spent = {}
        for times, df in sizes.items():
            start = time.monotonic()
            step(df)
            spent[times] = time.monotonic() - start
            spark.catalog.clearCache()
        print(f"{name:32s}{spent[1]:9.2f}{spent[10]:9.2f}{spent[10] / spent[1]:8.1f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
