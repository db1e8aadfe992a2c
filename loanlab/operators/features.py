"""Feature engineering: derived columns, missing flags, scalings, transforms, bins, correlated features.

Everything that is fitted is a handful of constants per column and enters the rows as literals, so
each step is a narrow projection: no join, no shuffle of rows, and it runs the same on a stream.

Defined results: nulls stay null (except where a step fills them), NaN counts as null; division by
zero gives null; a column without spread scales to 0; a column without values keeps its nulls;
an empty table gives no rows; a result column replaces one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.functions.quantiles import exact_quantiles
from loanlab.functions.scalars import nan_to_null, ratio
from loanlab.operators.profile import correlation_matrix

UNKNOWN = "Unknown"


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


# ---------------------------------------------------------------- derived columns and missing values

def derive(df: DataFrame) -> DataFrame:
    """Debt to income, age at first credit, income per year of employment (years count from one)."""
    return df.withColumns({
        "debt_to_income": ratio(F.col("loan_amnt"), F.nullif(F.col("person_income"), F.lit(0))),
        "age_at_first_credit": F.col("person_age") - F.col("cb_person_cred_hist_length"),
        "income_per_employment_year": ratio(F.col("person_income"), _number("person_emp_length") + 1.0)})


def flag_missing(df: DataFrame, cols, suffix: str = "_missing") -> DataFrame:
    """Adds 1 where a value is missing, else 0."""
    return df.withColumns({f"{c}{suffix}": (F.isnan(c) | F.col(c).isNull()).cast("int")
                           if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull().cast("int") for c in cols})


def fill_unknown(df: DataFrame, cols, word: str = UNKNOWN) -> DataFrame:
    """Missing categories become a category of their own."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(word)) for c in cols})


# ---------------------------------------------------------------- scalings

@dataclass(frozen=True)
class Scaling:
    """(shift, spread) by column: x becomes (x - shift) / spread."""

    constants: dict[str, tuple[float | None, float]]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {}
        for c, (shift, spread) in self.constants.items():
            x = _number(c)
            centred = x - F.lit(shift).cast("double")
            out[c + suffix] = centred / F.lit(spread) if spread else F.when(x.isNotNull(), F.lit(0.0))
        return df.withColumns(out)


def fit_min_max(df: DataFrame, cols) -> Scaling:
    """To the range from 0 to 1, from one aggregate."""
    cols = list(cols)
    row = df.agg(*[F.struct(F.min(_number(c)).alias("lo"), F.max(_number(c)).alias("hi")).alias(c) for c in cols]).first()
    return Scaling({c: (row[c]["lo"], (row[c]["hi"] or 0.0) - (row[c]["lo"] or 0.0)) for c in cols})


def fit_robust(df: DataFrame, cols) -> Scaling:
    """By median and distance of the quartiles, from exact quantiles."""
    found = exact_quantiles(nan_to_null(df), list(cols), [0.25, 0.5, 0.75])
    return Scaling({c: (q[1], (q[2] or 0.0) - (q[0] or 0.0)) for c, q in found.items()})


# ---------------------------------------------------------------- transforms and limits

def transform_skewed(df: DataFrame, cols, how: str = "log", suffix: str | None = None) -> DataFrame:
    """``log`` (of 1 + x) or ``sqrt``, mirrored for negative values."""
    if how not in ("log", "sqrt"):
        raise ValueError(f"unknown transform: {how}")
    size = {c: F.abs(_number(c)) for c in cols}
    return df.withColumns({c + (f"_{how}" if suffix is None else suffix):
                           F.signum(_number(c)) * (F.log1p(size[c]) if how == "log" else F.sqrt(size[c])) for c in cols})


@dataclass(frozen=True)
class Limits:
    """(low, high) by column."""

    bounds: dict[str, tuple[float | None, float | None]]

    def clip(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(_number(c).isNotNull(), F.greatest(F.lit(lo), F.least(_number(c), F.lit(hi))))
                               for c, (lo, hi) in self.bounds.items() if lo is not None})

    def flag(self, df: DataFrame, suffix: str = "_outlier") -> DataFrame:
        """Adds 1 outside the limits, 0 inside; missing values are inside."""
        return df.withColumns({c + suffix: F.coalesce(~_number(c).between(F.lit(lo).cast("double"), F.lit(hi).cast("double")),
                                                      F.lit(False)).cast("int") for c, (lo, hi) in self.bounds.items()})


def fit_percentiles(df: DataFrame, cols, low: float = 0.01, high: float = 0.99) -> Limits:
    """Limits for winsorising: exact percentiles."""
    if not 0.0 <= low < high <= 1.0:
        raise ValueError("low must be below high, both between 0 and 1")
    found = exact_quantiles(nan_to_null(df), list(cols), [low, high])
    return Limits({c: (q[0], q[1]) for c, q in found.items()})


# ---------------------------------------------------------------- bins

def binned(c: str, edges, labels=None) -> Column:
    """The bin of a value: ``edges`` are the inner borders, a value on a border is in the upper bin."""
    edges = list(edges)
    if edges != sorted(set(edges)):
        raise ValueError("edges must rise")
    names = list(labels) if labels is not None else [str(i) for i in range(len(edges) + 1)]
    if len(names) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    x = _number(c)
    out = F.when(x.isNull(), None)
    for edge, name in zip(edges, names):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def equal_width_edges(df: DataFrame, c: str, bins: int) -> list[float]:
    row = df.agg(F.min(_number(c)).alias("lo"), F.max(_number(c)).alias("hi")).first()
    if row["lo"] is None or row["lo"] == row["hi"]:
        return []
    return [row["lo"] + (row["hi"] - row["lo"]) * i / bins for i in range(1, bins)]


def equal_frequency_edges(df: DataFrame, c: str, bins: int) -> list[float]:
    found = exact_quantiles(nan_to_null(df), [c], [i / bins for i in range(1, bins)])[c]
    return sorted({q for q in found if q is not None})


# ---------------------------------------------------------------- correlated features

def redundant_features(df: DataFrame, cols, target: str, limit: float = 0.8) -> list[tuple[str, str, float]]:
    """(feature to drop, feature it follows, correlation), by falling strength.

    Of two features that correlate by ``limit`` or more the one with the weaker link to the
    target goes (ties: the later name), unless its partner has gone before. Works on the
    matrix: features x features numbers, whatever the rows.
    """
    cols = list(cols)
    corr = {(r["x"], r["y"]): r["corr"] for r in correlation_matrix(df, [*cols, target]).collect()}
    near = {c: round(abs(corr.get((c, target)) or 0.0), 9) for c in cols}
    pairs = sorted(((round(abs(corr.get((a, b)) or 0.0), 9), a, b) for i, a in enumerate(sorted(cols)) for b in sorted(cols)[i + 1:]),
                   key=lambda p: (-p[0], p[1], p[2]))
    gone, out = set(), []
    for strength, a, b in pairs:
        if strength < limit or a in gone or b in gone:
            continue
        drop, keep = (a, b) if near[a] < near[b] else (b, a)
        gone.add(drop)
        out.append((drop, keep, strength))
    return out
