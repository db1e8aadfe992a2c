"""Champion against challenger: stable random arms, metrics by arm, two-sample tests from sums.

The arm is a function of (salt, id): the same row gets the same arm in every run and on every
machine, and when the challenger's share grows no row leaves it. Tests need counts, sums and
sums of squares only, so rows are read once and never shuffled.

Defined results: a null id goes to the champion; an arm with fewer than two rows has a null
statistic; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAMPION, CHALLENGER = "champion", "challenger"
CRITICAL = 1.959963984540054  # 5 %, two-sided


def arm(id_col: str, share: float = 0.1, salt: str = "arm") -> Column:
    """``challenger`` for about ``share`` of the ids, else ``champion``."""
    if not 0.0 <= share <= 1.0:
        raise ValueError("the share must lie between 0 and 1")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double")
    return F.when(place / F.lit(4294967296.0) < F.lit(share), CHALLENGER).otherwise(CHAMPION)


def served(scored: DataFrame, id_col: str, share: float = 0.1, salt: str = "arm") -> DataFrame:
    """Of a row's predictions by both models (``model_name`` as arm), the one of the arm it belongs to."""
    return scored.where(F.col("model_name") == arm(id_col, share, salt))


def compare(rows: DataFrame, values: dict[str, Column], arm_col: str = "model_name") -> DataFrame:
    """(measure, n and mean by arm, difference, statistic, significant): Welch's test on each measure."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("v"))
                                for m, v in values.items()])).alias("c")
    x = F.col("c.v")

    def side(name):
        mine = F.when(F.col(arm_col) == name, x)
        return [F.count(mine).alias(f"n_{name}"), F.avg(mine).alias(f"mean_{name}"), F.var_samp(mine).alias(f"v_{name}")]
    sums = rows.select(arm_col, cells).groupBy("c.measure").agg(*side(CHAMPION), *side(CHALLENGER))
    gap = F.col(f"mean_{CHALLENGER}") - F.col(f"mean_{CHAMPION}")
    error = F.sqrt(F.try_divide(F.col(f"v_{CHAMPION}"), F.col(f"n_{CHAMPION}"))
                   + F.try_divide(F.col(f"v_{CHALLENGER}"), F.col(f"n_{CHALLENGER}")))
    statistic = F.try_divide(gap, error)
    return sums.select("measure", f"n_{CHAMPION}", f"mean_{CHAMPION}", f"n_{CHALLENGER}", f"mean_{CHALLENGER}",
                       gap.alias("difference"), statistic.alias("statistic"),
                       (F.abs(statistic) > F.lit(CRITICAL)).alias("significant"))
