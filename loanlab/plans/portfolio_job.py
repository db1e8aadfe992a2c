"""Score a whole portfolio with stored fits, and decide when to fit anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.functions.scalars import nan_to_null
from loanlab.operators.features import binned
from loanlab.roles import LOAN_ROLES, Roles
from loanlab.sources.results_store import load_model
from loanlab.streaming.scoring_stream import load_preprocessor

BAND_EDGES, BANDS = (0.1, 0.3, 0.6), ("low", "moderate", "high", "very high")


def score_portfolio(spark: SparkSession, df: DataFrame, preprocessor: str, model: str, out: str,
                    roles: Roles = LOAN_ROLES, batch: str = "batch") -> DataFrame:
    """Writes (id, score, prediction, band) of every row to ``out/run=<batch>`` and reads it back.

    A run that is repeated replaces its own folder only, so a job that failed half way can
    be started again. Labels are not needed.
    """
    prepared, scorer = load_preprocessor(spark, preprocessor, roles), load_model(spark, model)
    rows = prepared.transform(nan_to_null(df))
    scored = scorer.score(rows).select(F.col(roles.id).alias("id"), "score", "prediction",
                                       binned("score", BAND_EDGES, BANDS).alias("band"))
    scored.write.mode("overwrite").parquet(f"{out}/run={batch}")
    return spark.read.parquet(f"{out}/run={batch}")


def retraining_reasons(history: DataFrame, auc_floor: float = 0.85, psi_limit: float = 0.25,
                       most_periods: int = 4) -> DataFrame:
    """Adds to ``history(period, roc_auc, psi, ...)``: ``auc_low``, ``drifted``, ``too_old`` and ``retrain``.

    ``period`` counts periods since the fit. Unknown figures are no reason.
    """
    low = F.coalesce(F.col("roc_auc") < auc_floor, F.lit(False))
    moved = F.coalesce(F.col("psi") >= psi_limit, F.lit(False))
    old = F.coalesce(F.col("period") >= most_periods, F.lit(False))
    return history.withColumns({"auc_low": low, "drifted": moved, "too_old": old, "retrain": low | moved | old})
