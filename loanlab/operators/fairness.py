"""Fairness by group: approval, error rates and their ratios, from one grouped count.

Input is ``predictions(..., label, prediction)`` with a group column; prediction 1 declines. A
missing group is a group of its own.

Defined results: a rate without rows to divide by is null, so is its ratio; the reference is the
group with the most rows (ties: the first name) unless one is named; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.functions.scalars import ratio

MISSING = "(missing)"
LEAST_RATIO = 0.8  # the four-fifths rule


def group_rates(predictions: DataFrame, group: str) -> DataFrame:
    """(group, n, approval_rate, tpr, fpr, precision): one row per group."""
    y, p = F.col("label"), F.col("prediction")
    cells = predictions.groupBy(F.coalesce(F.col(group).cast("string"), F.lit(MISSING)).alias("group")).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select("group", (tn + fp + fn + tp).alias("n"), ratio(tn + fn, tn + fp + fn + tp).alias("approval_rate"),
                        ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"))


def fairness(predictions: DataFrame, group: str, reference: str | None = None) -> DataFrame:
    """``group_rates`` with ``approval_ratio``, ``tpr_gap`` and ``fpr_gap`` to the reference group, and
    ``fair``: the approval ratio is four fifths or more."""
    rates = group_rates(predictions, group)
    chosen = rates.where(F.col("group") == reference) if reference is not None else rates.orderBy(F.desc("n"), "group").limit(1)
    base = chosen.select(F.col("group").alias("reference"), F.col("approval_rate").alias("a0"), F.col("tpr").alias("t0"),
                         F.col("fpr").alias("f0"))
    share = ratio(F.col("approval_rate"), F.nullif(F.col("a0"), F.lit(0.0)))
    # one row on the right side: the reference group
    return rates.join(F.broadcast(base), F.lit(True)).select(
        "group", "n", "approval_rate", "tpr", "fpr", "precision", "reference", share.alias("approval_ratio"),
        (F.col("tpr") - F.col("t0")).alias("tpr_gap"), (F.col("fpr") - F.col("f0")).alias("fpr_gap"),
        (share >= LEAST_RATIO).alias("fair"))
