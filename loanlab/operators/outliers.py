"""Outlier fences, reports, clipping and removal.

Fences are fitted once as constants (O(columns) values on the driver) and enter the row
plan as literals: clipping and filtering stay narrow, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.functions.quantiles import ROW_LIMIT, exact_quantiles
from loanlab.functions.scalars import percent, r2, rows_from_one
from loanlab.roles import Roles

METHODS = ("clip", "remove", "none")


def fence_constants(df: DataFrame, cols, threshold: float = 1.5, row_limit: int = ROW_LIMIT,
                    at_most: int | None = None) -> dict:
    """``{column: {q1, median, q3, lower, upper}}``; columns without values are left out."""
    out = {}
    found = exact_quantiles(df, cols, [0.25, 0.5, 0.75], row_limit, at_most=at_most)
    for c, (q1, med, q3) in found.items():
        if q1 is not None:
            iqr = q3 - q1
            out[c] = {"q1": q1, "median": med, "q3": q3,
                      "lower": q1 - threshold * iqr, "upper": q3 + threshold * iqr}
    return out


def _report(df: DataFrame, cols, outside: dict[str, Column]) -> DataFrame:
    x = {c: F.col(c).cast("double") for c in cols}
    wide = df.agg(*[F.struct(F.count(c).alias("n"), F.count_if(outside[c]).alias("k"), F.min(x[c]).alias("lo"),
                             F.max(x[c]).alias("hi"), F.avg(x[c]).alias("mean")).alias(f"s{i}")
                    for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        s = F.col(f"s{i}")
        pct = percent(s["k"], s["n"])
        rows.append(F.struct(
            F.lit(c).alias("feature"), s["k"].alias("outlier_count"), r2(pct).alias("outlier_pct"),
            r2(s["lo"]).alias("min"), r2(s["hi"]).alias("max"), r2(s["mean"]).alias("mean"),
            F.when(pct > 5, "Cap/Floor").otherwise("Keep").alias("recommendation")))
    return rows_from_one(wide, rows)


def outlier_report(df: DataFrame, roles: Roles, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Outlier count, share of non-missing values and advice per numeric column."""
    cols = roles.present(df, roles.numeric)
    if method == "iqr":
        f = fence_constants(df, cols, threshold)
        outside = {c: ((F.col(c) < f[c]["lower"]) | (F.col(c) > f[c]["upper"])) if c in f else F.lit(False)
                   for c in cols}
    elif method == "zscore":
        x = {c: F.col(c).cast("double") for c in cols}
        m = df.agg(*[F.struct(F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std")).alias(c)
                     for c in cols]).first()
        outside = {c: (F.abs((x[c] - F.lit(m[c]["mean"])) / F.lit(m[c]["std"])) > 3.0) if m[c]["std"] else F.lit(False)
                   for c in cols}
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return _report(df, cols, outside)


def clip(df: DataFrame, fences: dict) -> DataFrame:
    """Pull values to the fences; a missing value stays missing. Clipped columns are DOUBLE."""
    def one(c):
        if c not in fences:
            return F.col(c)
        x, f = F.col(c).cast("double"), fences[c]
        return F.when(x.isNotNull(), F.greatest(F.lit(f["lower"]), F.least(x, F.lit(f["upper"])))).alias(c)
    return df.select(*[one(c) for c in df.columns])


def handle_outliers(df: DataFrame, roles: Roles, method: str = "clip", threshold: float = 1.5,
                    on_step=None) -> DataFrame:
    """Clip, remove or leave outliers.

    'remove' works column after column on the already filtered table, so later fences see
    fewer rows, and drops rows where the column is missing. The fences are literals, so
    the stacked filters collapse into one narrow predicate over the scan.
    """
    if method not in METHODS:
        raise ValueError(f"unknown outlier method: {method}")
    if method == "none":
        return df
    cols = roles.present(df, roles.numeric)
    note = on_step or (lambda step, details: None)
    if method == "clip":
        fences = fence_constants(df, cols, threshold)
        for c, f in fences.items():
            note(f"Clipped outliers in {c}", {"lower_bound": f["lower"], "upper_bound": f["upper"]})
        return clip(df, fences)
    rows = df.count()  # filters only make this smaller
    for c in cols:
        f = fence_constants(df, [c], threshold, at_most=rows).get(c)
        if f is None:
            return df.filter(F.lit(False))
        df = df.filter(F.col(c).cast("double").between(f["lower"], f["upper"]))
        note(f"Removed outliers in {c}", {"lower_bound": f["lower"], "upper_bound": f["upper"]})
    return df


def box_plot_stats(df: DataFrame, cols) -> DataFrame:
    """Five numbers, whiskers (most extreme points inside the fences) and outlier count."""
    cols = list(cols)
    f = fence_constants(df, cols)
    kept = [c for c in cols if c in f]
    x = {c: F.col(c).cast("double") for c in kept}
    inside = {c: F.when(x[c].between(f[c]["lower"], f[c]["upper"]), x[c]) for c in kept}
    wide = df.agg(*[F.struct(
        F.lit(c).alias("feature"), F.min(x[c]).alias("min"), F.lit(f[c]["q1"]).alias("q1"),
        F.lit(f[c]["median"]).alias("median"), F.lit(f[c]["q3"]).alias("q3"), F.max(x[c]).alias("max"),
        F.min(inside[c]).alias("whisker_lo"), F.max(inside[c]).alias("whisker_hi"),
        (F.count(x[c]) - F.count(inside[c])).alias("n_outliers")).alias(f"s{i}") for i, c in enumerate(kept)])
    return rows_from_one(wide, [F.col(f"s{i}") for i in range(len(kept))])
