"""Column helpers shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r2(c) -> Column:
    return F.round(c, 2)


def r4(c) -> Column:
    return F.round(c, 4)


def r6(c) -> Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), 6)


def percent(part, total) -> Column:
    """Share in percent; NULL on an empty total instead of an ANSI division error."""
    return F.try_divide(part.cast("double"), total.cast("double")) * 100.0


def ratio(a, b) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def adjusted_skewness(c: str) -> Column:
    """Bias-adjusted sample skewness; Spark's own ``skewness`` is the population form."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing marker, Spark two: turn NaN into NULL once, at the scan."""
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None)).cast(df.schema[c].dataType).alias(c) if is_float(df, c) else F.col(c)
        for c in df.columns
    ])


def as_key_text(df: DataFrame, c: str) -> Column:
    """Text form that keeps distinct values distinct (and -0.0 equal to 0.0)."""
    col = F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if is_float(df, c) else F.col(c)
    return col.cast("string")


def long_text(df: DataFrame, cols, keep=()) -> DataFrame:
    """Unpivot to (keep..., feature, value STRING)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), as_key_text(df, c).alias("value")) for c in cols
    ])).alias("cell")
    return df.select(*keep, cells).select(*keep, "cell.feature", "cell.value")


def long_numeric(df: DataFrame, cols, keep=()) -> DataFrame:
    """Unpivot to (keep..., feature, value DOUBLE)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("cell")
    return df.select(*keep, cells).select(*keep, "cell.feature", "cell.value")


def rows_from_one(wide: DataFrame, structs) -> DataFrame:
    """Turn the one-row result of a wide aggregate into one row per struct."""
    return wide.select(F.inline(F.array(*structs)))
