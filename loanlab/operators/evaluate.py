"""Evaluation of scored rows: ``predictions(model_name, id, label, score, prediction)``.

Everything starts from one shuffle of partial counts per (model, score): ties are merged
before any ordering, and the ordered step runs on distinct scores only.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.functions.scalars import percent, r2, r4, ratio
from loanlab.operators.ranking import running_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def decide(score, threshold: float = 0.5):
    """Class 1 when the score is above the threshold."""
    return (score > F.lit(threshold)).cast("int")


def _cells():
    y, p = F.col("label"), F.col("prediction")
    return [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]


def confusion(predictions: DataFrame) -> DataFrame:
    """The four cells (always all four) and their share of all rows, per model."""
    c = predictions.groupBy("model_name").agg(*_cells())
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("*", *[percent(F.col(k), n).alias(f"{k}_pct") for k in ("tn", "fp", "fn", "tp")])


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; undefined ratios count as 0."""
    return _metrics(predictions).drop("n_scored")


def _metrics(predictions: DataFrame) -> DataFrame:
    return _ratios(predictions.groupBy("model_name").agg(*_cells(), F.count("score").alias("n_scored")))


def _ratios(cells: DataFrame, *keep: str) -> DataFrame:
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    return cells.select(
        "model_name",
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"), "n_scored", *keep)


def score_counts(predictions: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return (predictions.filter(F.col("score").isNotNull()).groupBy("model_name", "score")
            .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")))


def cumulative_counts(predictions: DataFrame) -> DataFrame:
    """True and false positives when everything down to each score is called positive."""
    return running_totals(score_counts(predictions), ["model_name"], "score", ["pos", "neg"],
                          ascending=False, following=True)


def _auc_from(cum: DataFrame) -> DataFrame:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = neg * (F.col("cum_pos") - F.col("pos")).cast("double") + 0.5 * pos * neg
    total = F.col("total_pos").cast("double") * F.col("total_neg").cast("double")
    # shares are summed, not the areas: those grow with the square of the table
    return cum.groupBy("model_name").agg(F.sum(F.try_divide(area, total)).alias("roc_auc"))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Tie-exact area under the ROC curve; NULL when only one class is present."""
    return _auc_from(cumulative_counts(predictions))


def roc_curve(predictions: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(model_name, threshold, fpr, tpr), from (0, 0) at an infinite threshold downwards.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours:
    those whose step equals the next one.
    """
    cum = cumulative_counts(predictions)
    if drop_intermediate:
        top = F.col("cum_pos") + F.col("cum_neg") == F.col("pos") + F.col("neg")
        last = F.col("next_pos").isNull()
        bends = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        cum = cum.filter(top | last | bends)
    points = cum.select("model_name", F.col("score").alias("threshold"),
                        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
                        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    start = cum.select("model_name").distinct().select(
        "model_name", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def _precision_recall():
    hits = F.col("cum_pos")
    return ratio(hits, hits + F.col("cum_neg")), ratio(hits, F.col("total_pos"))


def pr_curve(predictions: DataFrame) -> DataFrame:
    """(model_name, threshold, precision, recall) plus the closing point (1, 0)."""
    cum = cumulative_counts(predictions)
    precision, recall = _precision_recall()
    points = cum.select("model_name", F.col("score").alias("threshold"),
                        precision.alias("precision"), recall.alias("recall"))
    end = cum.select("model_name").distinct().select(
        "model_name", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(predictions: DataFrame) -> DataFrame:
    """Sum of precision x recall step (not the trapezoid)."""
    precision, _ = _precision_recall()
    step = ratio(F.col("pos"), F.col("total_pos"))
    return cumulative_counts(predictions).groupBy("model_name").agg(
        F.sum(step * precision).alias("average_precision"))


def evaluate(predictions: DataFrame) -> DataFrame:
    """The five metrics per model; ROC-AUC is 0 for a model without scores.

    The predictions are read once: their labels, counted by score and decision, are sorted by score, and
    one pass over each range of them gives its cells and its own area under the curve. A range's negatives
    also count the positives of the ranges before it.
    """
    tally = predictions.groupBy("model_name", "score", "prediction").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    kind = tally.schema["model_name"].dataType.simpleString()
    pieces = tally.select("model_name", F.col("score").cast("double").alias("score"), F.col("prediction").cast("int"),
                          "pos", "neg").orderBy("model_name", F.desc("score")).mapInArrow(
        _pieces, f"model_name {kind}, part int, pos double, neg double, area double, n_scored bigint, "
                 "tn bigint, fp bigint, fn bigint, tp bigint")
    # (model, range) pairs: at most ranges + models rows
    ordered = W.partitionBy("model_name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = pieces.withColumn("area", F.col("area") + F.col("neg") * F.coalesce(F.sum("pos").over(ordered), F.lit(0.0)))
    cells = whole.groupBy("model_name").agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp", "n_scored")],
        F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("_auc"))
    auc = F.when(F.col("n_scored") == 0, 0.0).otherwise(F.col("_auc"))
    return _ratios(cells, "_auc").withColumn("roc_auc", auc).drop("n_scored", "_auc")


def _pieces(batches):
    """Counts and area of each model's rows in one range, sorted by descending score; ties are merged."""
    sums = {}  # by model: positives, negatives, area, scored rows, tn, fp, fn, tp
    open_ties = {}  # by model: last score so far, its positives and negatives

    def close(model):
        _, p, n = open_ties.pop(model)
        s = sums[model]
        s[2] += n * s[0] + 0.5 * p * n
        s[0] += p
        s[1] += n

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).dictionary_encode("encode")
        kind, ids = batch.column(0).type, names.indices.to_numpy()
        score = batch.column(1).to_numpy(zero_copy_only=False)
        said = batch.column(2).fill_null(-1).to_numpy()
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        pos, neg = (batch.column(c).to_numpy() for c in (3, 4))
        for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
            model = names.dictionary[int(ids[run[0]])].as_py()
            s = sums.setdefault(model, [0.0, 0.0, 0.0, 0, 0, 0, 0, 0])
            for at, (side, d) in enumerate(((neg, 0), (neg, 1), (pos, 0), (pos, 1)), 4):
                s[at] += int(side[run][said[run] == d].sum())
            run = run[known[run]]
            if not len(run):
                continue
            s[3] += int(pos[run].sum() + neg[run].sum())
            bits = score[run].view(np.int64)  # equal scores are equal bits after grouping, NaN too
            first = np.concatenate(([0], np.flatnonzero(np.diff(bits)) + 1))
            p, n = (np.add.reduceat(v[run], first).astype(float) for v in (pos, neg))
            if model in open_ties and open_ties[model][0] == bits[0]:
                p[0] += open_ties[model][1]
                n[0] += open_ties[model][2]
            elif model in open_ties:
                close(model)
            open_ties[model] = (bits[-1], p[-1], n[-1])
            p, n = p[:-1], n[:-1]
            s[2] += float((n * (s[0] + p.cumsum() - 0.5 * p)).sum())
            s[0] += float(p.sum())
            s[1] += float(n.sum())
    for model in list(open_ties):
        close(model)
    if sums:
        part = TaskContext.get().partitionId()
        pos, neg, area, n, tn, fp, fn, tp = zip(*sums.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), kind), pa.array([part] * len(sums), pa.int32()), *map(pa.array, (pos, neg, area)),
             *[pa.array(v, pa.int64()) for v in (n, tn, fp, fn, tp)]],
            names=["model_name", "part", "pos", "neg", "area", "n_scored", "tn", "fp", "fn", "tp"])


# ---------------------------------------------------------------- comparison of models
# The inputs below hold one row per model (or per model and feature).

def comparison_table(metrics: DataFrame) -> DataFrame:
    """Rounded metrics and the rank by ROC-AUC (ties by name)."""
    out = metrics.select("model_name", *[r4(F.col(m)).alias(m) for m in METRICS],
                         *([r2(F.col("train_seconds")).alias("train_seconds")]
                           if "train_seconds" in metrics.columns else []))
    # one row per model: the single-partition window is over a handful of rows
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("roc_auc"), "model_name")))


def sorted_comparison(metrics: DataFrame) -> DataFrame:
    return comparison_table(metrics).orderBy("rank")


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest ROC-AUC; the first name wins ties."""
    best = F.min(F.struct((-F.coalesce(F.col("roc_auc"), F.lit(-1.0))).alias("neg"), "model_name", "roc_auc"))
    return metrics.agg(best.alias("b")).select("b.model_name", "b.roc_auc")


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(model_name, metric, score) for grouped bars."""
    return metrics.unpivot(["model_name"], list(METRICS), "metric", "score")


def top_models(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Metrics of the n best-ranked models, unpivoted for a radar chart."""
    return comparison_table(metrics).filter(F.col("rank") <= n).unpivot(
        ["model_name", "rank"], list(METRICS), "metric", "score")


def by_train_time(metrics: DataFrame) -> DataFrame:
    return metrics.select("model_name", "train_seconds").orderBy("train_seconds", "model_name")


def ranked_importance(importance: DataFrame) -> DataFrame:
    """Rank and cumulative share of each model's feature importances."""
    w = W.partitionBy("model_name")
    o = w.orderBy(F.desc("importance"), "feature")
    total = F.sum("importance").over(w)
    upto = F.sum("importance").over(o.rowsBetween(W.unboundedPreceding, W.currentRow))
    return importance.select(
        "model_name", "feature", "importance", F.row_number().over(o).alias("rank"),
        r2(percent(upto, total)).alias("cumulative_pct"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return ranked_importance(importance).filter(F.col("rank") <= n).select(
        "model_name", "feature", "importance", "rank")


def models_with_importance(metrics: DataFrame, importance: DataFrame) -> DataFrame:
    return metrics.select("model_name").join(importance.select("model_name").distinct(), "model_name", "left_semi")
