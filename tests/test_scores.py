"""Learners without probabilities, or without any score."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanlab.operators import evaluate as ev
from loanlab.operators import learners as ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    frame = spark.createDataFrame([(i, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))],
                                  "id long, label double, x array<double>")
    return frame.select("id", "label", array_to_vector("x").alias("features"))


class NoScores:
    """A fitted model that only decides."""

    def transform(self, df):
        return df.withColumn("prediction", F.lit(1.0))


def test_area_from_raw_scores(rows):
    model = ml.SparkModel(LinearSVC(maxIter=20).fit(rows))
    got = ml.predict("Margin", model, rows, "id")
    m = ev.evaluate(got).first()
    assert m["roc_auc"] > 0.85 and m["accuracy"] > 0.75
    assert got.filter((F.col("score") > 0) != (F.col("prediction") == 1)).count() == 0
    both = ev.classification_metrics(got).first()
    assert (both["f1"], ev.roc_auc(got).first()["roc_auc"]) == pytest.approx((m["f1"], m["roc_auc"]))


def test_no_scores_give_an_area_of_zero(rows):
    got = ml.predict("Decider", ml.SparkModel(NoScores()), rows, "id")
    m = ev.evaluate(got).first()
    assert m["roc_auc"] == 0.0 and m["recall"] == 1.0


def test_unlimited_depth_is_said_so():
    assert "max_depth=unlimited (30)" in ml.setting_text({"max_depth": ml.DEEPEST, "num_trees": 100})
