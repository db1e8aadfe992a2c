"""Reason codes: what speaks most for the decision on each row.

A linear or naive Bayes score is the logistic of a sum with one term per feature. The terms are
one array expression per row; the largest are found by a sort of that short array, so no row
is exploded and nothing is shuffled. The terms and the base add up to the margin.

Defined results: features of equal weight come in feature order; fewer features than ``top``
give as many as there are; an empty table gives no rows; a model without such terms raises.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.operators.learners import NaiveBayesModel, SparkModel


def contributions(model, features: str = "features") -> tuple[float, Column]:
    """(base, array of one term per feature): the log odds of class 1 are base plus the terms."""
    x = vector_to_array(F.col(features))
    if isinstance(model, NaiveBayesModel):
        if len(model.classes) != 2:
            raise ValueError("one class only: there is nothing to explain")
        (p0, m0, v0), (p1, m1, v1) = model.classes[0], model.classes[1]
        terms = [F.lit(0.5 * math.log(b / d)) + F.pow(x[i] - F.lit(a), 2.0) * F.lit(0.5 / b)
                 - F.pow(x[i] - F.lit(c), 2.0) * F.lit(0.5 / d) for i, (a, b, c, d) in enumerate(zip(m0, v0, m1, v1))]
        return math.log(p1) - math.log(p0), F.array(*terms)
    if isinstance(model, SparkModel) and hasattr(model.model, "coefficients"):
        terms = [x[i] * F.lit(float(w)) for i, w in enumerate(model.model.coefficients.toArray())]
        return float(model.model.intercept), F.array(*terms)
    raise ValueError("only linear and naive Bayes scores are sums over features")


def reason_codes(model, rows: DataFrame, id_col: str, names, top: int = 3, toward: int = 1) -> DataFrame:
    """(id, margin, score, reasons): the ``top`` terms toward class ``toward``, largest first.

    ``reasons`` is an array of (feature, contribution). Terms that speak against the class are not listed.
    """
    base, terms = contributions(model)
    sign = 1.0 if toward == 1 else -1.0
    listed = F.array(*[F.lit(n) for n in names])
    cells = F.transform(terms, lambda t, i: F.struct((t * F.lit(-sign)).alias("less"), i.alias("i")))
    best = F.slice(F.sort_array(F.filter(cells, lambda c: c["less"] < 0)), 1, top)
    reasons = F.transform(best, lambda c: F.struct(F.get(listed, c["i"]).alias("feature"),
                                                   (c["less"] * F.lit(-sign)).alias("contribution")))
    margin = F.aggregate(terms, F.lit(base), lambda a, t: a + t)
    return rows.select(F.col(id_col).alias("id"), margin.alias("margin"), reasons.alias("reasons")).withColumn(
        "score", 1.0 / (1.0 + F.exp(F.least(-F.col("margin"), F.lit(700.0)))))
