"""Imputation, encoding, scaling: fitted constants plus a narrow projection.

Fitting costs a few scans that return O(columns + categories) constants; applying them is
a stateless select (no join, no shuffle), so it runs on batch and streaming frames alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from loanlab.functions.quantiles import ROW_LIMIT, exact_quantiles
from loanlab.functions.scalars import as_key_text, long_text
from loanlab.operators.ranking import running_totals
from loanlab.roles import Roles

CATEGORY_LIMIT = 10_000


class CardinalityError(ValueError):
    """A categorical column has too many values for a dense one-hot encoding."""


# ---------------------------------------------------------------- fitted statistics

def medians(df: DataFrame, cols, row_limit: int = ROW_LIMIT) -> dict:
    return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5], row_limit).items()}


def _category_counts(df: DataFrame, cols) -> DataFrame:
    return (long_text(df, cols).filter(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count("*").alias("n")))


def modes(df: DataFrame, cols) -> dict:
    """Most frequent value; the smallest wins ties."""
    cols = list(cols)
    if not cols:
        return {}
    rows = (_category_counts(df, cols).groupBy("feature")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), "value"))["value"].alias("value")).collect())
    found = {r["feature"]: r["value"] for r in rows}
    return {c: found.get(c) for c in cols}


def _missing_counts(df: DataFrame, cols) -> dict:
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                             for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute_constants(df: DataFrame, roles: Roles) -> dict:
    """Median / mode of the columns that have missing values."""
    gaps = _missing_counts(df, roles.present(df, roles.features))
    num = [c for c in roles.present(df, roles.numeric) if gaps[c]]
    cat = [c for c in roles.present(df, roles.categorical) if gaps[c]]
    return {"median": medians(df, num), "mode": modes(df, cat)}


def apply_imputation(df: DataFrame, constants: dict) -> DataFrame:
    def one(c):
        if constants["median"].get(c) is not None:
            return F.coalesce(F.col(c).cast("double"), F.lit(constants["median"][c])).alias(c)
        if constants["mode"].get(c) is not None:
            return F.coalesce(F.col(c), F.lit(constants["mode"][c])).alias(c)
        return F.col(c)
    return df.select(*[one(c) for c in df.columns])


def impute_missing(df: DataFrame, roles: Roles, on_step=None) -> DataFrame:
    """Numeric median, categorical mode; columns without gaps are left alone."""
    constants = impute_constants(df, roles)
    note = on_step or (lambda step, details: None)
    for c, v in constants["median"].items():
        note(f"Imputed {c} with median", {"value": v})
    for c, v in constants["mode"].items():
        note(f"Imputed {c} with mode", {"value": v})
    return apply_imputation(df, constants)


# ---------------------------------------------------------------- label encoding

@dataclass(frozen=True)
class LabelEncoding:
    """Sorted classes per column, as a table (feature, value, index)."""

    classes: DataFrame
    small: dict[str, list[str]]  # columns whose classes the driver knows
    large: tuple[str, ...] = ()  # columns looked up by a join
    counts: dict[str, int] = field(default_factory=dict)  # classes per column

    def apply(self, df: DataFrame) -> DataFrame:
        for c in [c for c in df.columns if c in self.small or c in self.large]:
            text = F.coalesce(as_key_text(df, c), F.lit("nan"))
            if c in self.small:
                pairs = [F.lit(v) for i, cls in enumerate(self.small[c]) for v in (cls, i)]
                df = df.withColumn(c, F.element_at(F.create_map(*pairs), text).cast("int"))
            else:
                look = self.classes.filter(F.col("feature") == c).select(
                    F.col("value").alias("_v"), F.col("index").cast("int").alias("_i"))
                df = (df.withColumn("_t", text).join(look, F.col("_t") == F.col("_v"), "left")
                      .withColumn(c, F.col("_i")).drop("_t", "_v", "_i"))
        return df


def fit_labels(df: DataFrame, cols, limit: int = CATEGORY_LIMIT) -> LabelEncoding:
    """Class index = position among the sorted distinct values; missing becomes 'nan'."""
    cols = list(cols)
    distinct = long_text(df, cols).select("feature", F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    sizes = {r["feature"]: r["n"] for r in distinct.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    few = [c for c in cols if sizes.get(c, 0) <= limit]
    many = tuple(c for c in cols if c not in few)
    small = {c: [] for c in few}
    for r in distinct.filter(F.col("feature").isin(few)).collect():
        small[r["feature"]].append(r["value"])
    small = {c: sorted(v, key=lambda s: s.encode()) for c, v in small.items()}
    table = df.sparkSession.createDataFrame(
        [(c, v, i) for c in few for i, v in enumerate(small[c])], "feature string, value string, index bigint")
    if many:
        ranked = running_totals(distinct.filter(F.col("feature").isin(list(many))).withColumn("one", F.lit(1)),
                                ["feature"], "value", ["one"])
        table = table.unionByName(ranked.select("feature", "value", (F.col("cum_one") - 1).alias("index")))
    return LabelEncoding(table, small, many, {c: sizes.get(c, 0) for c in cols})


def encode_categorical(df: DataFrame, roles: Roles, method: str = "onehot", on_step=None):
    """('label') integer codes and the encoders; ('onehot') unchanged, the fitted model does it."""
    if method == "onehot":
        return df, None
    if method != "label":
        raise ValueError(f"unknown encoding: {method}")
    cols = roles.present(df, roles.categorical)
    enc = fit_labels(df, cols)
    for c in cols if on_step else ():
        if c in enc.small:
            on_step(f"Label encoded {c}", {"classes": enc.small[c]})
        else:  # too many for the driver: their number and their table
            on_step(f"Label encoded {c}", {"n_classes": enc.counts[c], "classes": enc.classes.filter(
                F.col("feature") == c).select("value", "index")})
    return enc.apply(df), enc


# ---------------------------------------------------------------- one-hot + scaling model

@dataclass(frozen=True)
class PreprocessModel:
    """Median + population z-score for numerics, mode + drop-first one-hot for categoricals."""

    roles: Roles
    numeric: dict[str, tuple[float, float, float]]  # median, mean, population std
    categorical: dict[str, tuple[str, tuple[str, ...]]]  # mode, sorted categories
    rows: int = 0
    missing: dict = field(default_factory=dict)
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        hot = tuple(f"{c}_{v}" for c in self.roles.categorical for v in self.categorical[c][1][1:])
        object.__setattr__(self, "names", tuple(self.roles.numeric) + hot)

    def _columns(self) -> list[Column]:
        out = []
        for c in self.roles.numeric:
            med, mean, std = self.numeric[c]
            x = F.coalesce(F.col(c).cast("double"), F.lit(med))
            out.append((x - F.lit(mean)) / F.lit(std or 1.0))
        for c in self.roles.categorical:
            mode, cats = self.categorical[c]
            v = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out += [F.when(v == cat, 1.0).otherwise(0.0) for cat in cats[1:]]
        return out

    def transform(self, df: DataFrame, flat: bool = False, keep=()) -> DataFrame:
        """(id, keep..., label if present, features VECTOR or the flat columns)."""
        cols = [F.col(self.roles.id), *[F.col(c) for c in keep]]
        if self.roles.target in df.columns:
            cols.append(F.col(self.roles.target).cast("double").alias("label"))
        if flat:
            cols += [c.alias(n) for c, n in zip(self._columns(), self.names)]
        else:
            attrs = [{"idx": i, "name": n} for i, n in enumerate(self.names)]
            meta = {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(attrs)}}
            cols.append(array_to_vector(F.array(*self._columns())).alias("features", metadata=meta))
        return df.select(*cols)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The fitted constants as a table: (column, statistic, position, number, text)."""
        rows = []
        for c, (med, mean, std) in self.numeric.items():
            rows += [(c, "median", 0, med, None), (c, "mean", 0, mean, None), (c, "std", 0, std, None)]
        for c, (mode, cats) in self.categorical.items():
            rows.append((c, "mode", 0, None, mode))
            rows += [(c, "category", i, None, v) for i, v in enumerate(cats)]
        return spark.createDataFrame(rows, "column string, statistic string, position int, number double, text string")

    @staticmethod
    def from_frame(table: DataFrame, roles: Roles) -> "PreprocessModel":
        stats = {}
        for r in sorted(table.collect(), key=lambda r: r["position"]):
            stats.setdefault(r["column"], {}).setdefault(r["statistic"], []).append(
                r["number"] if r["text"] is None else r["text"])
        num = {c: (stats[c]["median"][0], stats[c]["mean"][0], stats[c]["std"][0]) for c in roles.numeric}
        cat = {c: (stats[c]["mode"][0], tuple(stats[c].get("category", ()))) for c in roles.categorical}
        return PreprocessModel(roles, num, cat)


def fit_preprocessor(df: DataFrame, roles: Roles, known_medians: dict | None = None,
                     category_limit: int = CATEGORY_LIMIT) -> PreprocessModel:
    """Three jobs: medians (skipped if known), one wide numeric aggregate, one category count."""
    med = known_medians or medians(df, roles.numeric)
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double")) for c in roles.numeric}
    row = df.agg(F.count("*").alias("_n"), *[F.struct(
        F.avg(x[c]).alias("mean"), F.stddev_pop(x[c]).alias("std"), F.min(x[c]).alias("lo"),
        F.max(x[c]).alias("hi"), F.count(c).alias("k")).alias(c) for c in roles.numeric]).first()
    numeric = {}
    for c in roles.numeric:
        s = row[c]
        spread = s["std"] if s["lo"] is not None and s["lo"] != s["hi"] else 0.0
        numeric[c] = (0.0 if med[c] is None else med[c], s["mean"] or 0.0, spread)

    cats = {c: [] for c in roles.categorical}
    if roles.categorical:
        # every (column, category) count, or one row more than allowed
        most = category_limit * len(roles.categorical)
        for r in _category_counts(df, roles.categorical).limit(most + 1).collect():
            cats[r["feature"]].append((r["value"], r["n"]))
        for c, v in cats.items():
            if len(v) > category_limit:
                raise CardinalityError(f"{c} has more than {category_limit} categories; too many for one-hot")
    categorical = {}
    for c, counted in cats.items():
        counted = sorted(counted, key=lambda e: e[0].encode())
        mode = max(counted, key=lambda e: e[1])[0] if counted else None  # the first wins ties
        categorical[c] = (mode, tuple(v for v, _ in counted))
    gaps = {c: row["_n"] - row[c]["k"] for c in roles.numeric}
    gaps.update({c: row["_n"] - sum(n for _, n in v) for c, v in cats.items()})
    return PreprocessModel(roles, numeric, categorical, row["_n"], gaps)
