"""Separation and calibration of scores, and decisions by threshold, from counts per distinct score.

Input is ``predictions(model_name, id, label, score, ...)``. Rows are folded to one count per
(model, score) before any ordering; ordered steps run on range partitions of distinct scores
(``ranking.running_totals``), and no curve is collected.

Defined results: rows without a score or a label take no part; a model with one class only
gets null where a rate of the other class is needed; ties at one score stay together; an
empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.functions.scalars import ratio
from loanlab.operators.evaluate import cumulative_counts, score_counts
from loanlab.operators.ranking import running_totals
from loanlab.session import durable


def _scored(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isin(0, 1))


def separation(predictions: DataFrame) -> DataFrame:
    """(model_name, gini, ks, ks_threshold, brier); ``ks_threshold`` is the highest score that reaches ks."""
    rows = _scored(predictions)
    cum = cumulative_counts(rows)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tpr, fpr = ratio(F.col("cum_pos"), F.col("total_pos")), ratio(F.col("cum_neg"), F.col("total_neg"))
    total = F.col("total_pos").cast("double") * F.col("total_neg").cast("double")
    area = neg * (F.col("cum_pos") - F.col("pos")).cast("double") + 0.5 * pos * neg
    # rounded, so that equal gaps compare equal whatever the order of the divisions
    gap = F.round(F.abs(tpr - fpr), 12)
    curve = cum.groupBy("model_name").agg(F.sum(F.try_divide(area, total)).alias("auc"),
                                          F.max(F.when(gap.isNotNull(), F.struct(gap.alias("g"), "score"))).alias("m"))
    brier = rows.groupBy("model_name").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2.0)).alias("brier"))
    return brier.join(curve, "model_name").select("model_name", (2.0 * F.col("auc") - 1.0).alias("gini"),
                                                  F.col("m.g").alias("ks"), F.col("m.score").alias("ks_threshold"), "brier")


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(model_name, bin, n, low, high, mean_score, rate, gap) of equal-frequency bins of the score.

    A score's bin follows from the rows below it, so rows of one score are never parted; bins
    that a frequent score swallows are absent. The expected calibration error is
    the mean of ``gap`` weighted by ``n``.
    """
    counts = score_counts(_scored(predictions)).withColumn("n", F.col("pos") + F.col("neg"))
    cum = running_totals(counts, ["model_name"], "score", ["n", "pos"])
    place = F.floor((F.col("cum_n") - F.col("n")) * F.lit(bins) / F.col("total_n")).cast("int")
    n, pos = F.sum("n"), F.sum("pos")
    mean = F.sum(F.col("score") * F.col("n")) / n
    return cum.withColumn("bin", place).groupBy("model_name", "bin").agg(
        n.alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), mean.alias("mean_score"),
        (pos / n).alias("rate"), F.abs(mean - pos / n).alias("gap"))


# ---------------------------------------------------------------- isotonic fit

_BLOCKS = "model_name string, part long, low double, high double, pos long, n long"


def _pooling():
    """A function from the blocks of one group to its pooled blocks, by ascending score."""
    def pool(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("low"), []
        for low, high, pos, n in zip(rows["low"], rows["high"], rows["pos"], rows["n"]):
            out.append([low, high, int(pos), int(n)])
            # rates are compared as products of whole numbers: no rounding
            while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
                _, top, hits, size = out.pop()
                out[-1][1:] = [top, out[-1][2] + hits, out[-1][3] + size]
        return pd.DataFrame([(*key, *b) for b in out], columns=["model_name", "part", "low", "high", "pos", "n"])
    return pool


def isotonic(predictions: DataFrame) -> DataFrame:
    """(model_name, low, high, n, rate): the rising step function of the score nearest to the labels.

    Neighbours are pooled inside each range partition of the distinct scores. Where the
    last block of a partition and the first of the next one still fall, the partitions in
    touch are put together and pooled again, until none does. Blocks after pooling are few (for a smooth
    rate, about the cube root of the rows); only those of partitions in touch meet in one task.
    """
    counts = score_counts(_scored(predictions))
    placed = durable(counts.orderBy("model_name", "score")).withColumn("part", F.spark_partition_id().cast("long"))
    blocks = placed.select("model_name", "part", F.col("score").alias("low"), F.col("score").alias("high"), "pos",
                           (F.col("pos") + F.col("neg")).alias("n"))

    pool = _pooling()
    while True:
        blocks = durable(blocks.groupBy("model_name", "part").applyInPandas(pool, _BLOCKS))
        edges = blocks.groupBy("model_name", "part").agg(
            F.min(F.struct("low", "pos", "n")).alias("first"), F.max(F.struct("low", "pos", "n")).alias("last"))
        in_order = W.partitionBy("model_name").orderBy("part")  # one row per range partition
        before = F.lag("last").over(in_order)
        falls = (before["pos"] * F.col("first.n") >= F.col("first.pos") * before["n"])
        edges = edges.withColumn("falls", F.coalesce(falls, F.lit(False)))
        joined = edges.withColumn("head", F.last(F.when(~F.col("falls"), F.col("part")), ignorenulls=True).over(in_order))
        if joined.where("falls").limit(1).count() == 0:
            break
        heads = joined.select("model_name", "part", "head")
        blocks = blocks.join(F.broadcast(heads), ["model_name", "part"]).select(
            "model_name", F.col("head").alias("part"), "low", "high", "pos", "n")
    return blocks.select("model_name", "low", "high", "n", (F.col("pos") / F.col("n")).alias("rate"))


# ---------------------------------------------------------------- thresholds

def threshold_values(tp: float, fp: float, fn: float, tn: float) -> Column:
    """Worth of calling all rows from a score upwards positive, by the worth of one row in each cell."""
    missed, passed = F.col("total_pos") - F.col("cum_pos"), F.col("total_neg") - F.col("cum_neg")
    return (F.col("cum_pos") * F.lit(tp) + F.col("cum_neg") * F.lit(fp) + missed * F.lit(fn) + passed * F.lit(tn))


def best_thresholds(predictions: DataFrame, tp: float = 0.0, fp: float = -1.0, fn: float = -5.0,
                    tn: float = 1.0) -> DataFrame:
    """(model_name, objective, threshold, value, positive_rate, approval_rate) for profit, F1 and Youden's J.

    A row is called positive (and declined) if its score is the threshold or more. All distinct scores
    and "nobody" (an infinite threshold) compete; of equal values the highest threshold wins.
    """
    cum = cumulative_counts(_scored(predictions))
    nobody = cum.groupBy("model_name").agg(F.max("total_pos").alias("total_pos"), F.max("total_neg").alias("total_neg")).select(
        "model_name", F.lit(float("inf")).alias("score"), F.lit(0).cast("bigint").alias("cum_pos"),
        F.lit(0).cast("bigint").alias("cum_neg"), "total_pos", "total_neg")
    points = cum.select(*nobody.columns).unionByName(nobody)
    hits, called = F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")
    goals = {"profit": threshold_values(tp, fp, fn, tn),
             "f1": F.coalesce(ratio(2 * hits, called + F.col("total_pos")), F.lit(0.0)),
             "youden": ratio(hits, F.col("total_pos")) - ratio(F.col("cum_neg"), F.col("total_neg"))}
    share = ratio(called, F.col("total_pos") + F.col("total_neg"))
    best = [F.max(F.when(v.isNotNull(), F.struct(F.round(v, 12).alias("value"), F.col("score").alias("threshold"),
                                                 share.alias("share")))).alias(g) for g, v in goals.items()]
    wide = points.groupBy("model_name").agg(*best)
    long = F.explode(F.array(*[F.struct(F.lit(g).alias("objective"), F.col(g).alias("b")) for g in goals])).alias("o")
    return wide.select("model_name", long).where("o.b IS NOT NULL").select(
        "model_name", "o.objective", "o.b.threshold", "o.b.value", F.col("o.b.share").alias("positive_rate"),
        (1.0 - F.col("o.b.share")).alias("approval_rate"))


def expected_loss(rows: DataFrame, by, exposure: str, loss_share: float = 0.45, threshold: float = 0.5,
                  score: str = "score") -> DataFrame:
    """(by..., n, n_approved, approval_rate, exposure, expected_loss, realised_loss) of the rows approved.

    Expected loss is score x ``loss_share`` x exposure, summed over rows with a score below the
    threshold; the realised one counts the exposure of the defaults among them (``label`` 1).
    """
    approved = F.col(score) < F.lit(threshold)
    amount = F.col(exposure).cast("double")
    over = lambda x: F.coalesce(F.sum(F.when(approved, x)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(approved).alias("n_approved"),
        (F.count_if(approved) / F.count(F.lit(1))).alias("approval_rate"), over(amount).alias("exposure"),
        over(F.col(score) * F.lit(loss_share) * amount).alias("expected_loss"),
        over(F.when(F.col("label") == 1, F.lit(loss_share) * amount)).alias("realised_loss"))
