"""From raw table to train/test rows: the stateful helper with its step log, and the chained job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.fixed_values import TEST_SIZE
from loanlab.functions.scalars import nan_to_null
from loanlab.operators import preprocess as pp
from loanlab.operators import resample
from loanlab.operators.outliers import METHODS as OUTLIER_METHODS
from loanlab.operators.outliers import clip, fence_constants, handle_outliers
from loanlab.roles import LOAN_ROLES, Roles
from loanlab.session import durable


class NotFitted(ValueError):
    """Transform before fit."""


class StepLog:
    """Ordered (step, details) records."""

    def __init__(self):
        self.steps: list[tuple[str, dict]] = []

    def __call__(self, step: str, details: dict) -> None:
        self.steps.append((step, dict(details)))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, s, {str(k): str(v) for k, v in d.items()}) for i, (s, d) in enumerate(self.steps)],
            "seq int, step string, details map<string,string>")


class Preprocessor:
    """Step-by-step preprocessing of one table; every step is logged."""

    def __init__(self, roles: Roles = LOAN_ROLES):
        self.roles, self.log, self.model = roles, StepLog(), None

    def handle_outliers(self, df: DataFrame, method: str = "clip", threshold: float = 1.5) -> DataFrame:
        return handle_outliers(df, self.roles, method, threshold, self.log)

    def impute_missing(self, df: DataFrame) -> DataFrame:
        return pp.impute_missing(df, self.roles, self.log)

    def encode_categorical(self, df: DataFrame, method: str = "onehot"):
        return pp.encode_categorical(df, self.roles, method, self.log)

    def fit(self, df: DataFrame, known_medians: dict | None = None) -> pp.PreprocessModel:
        self.log("Built preprocessing pipeline", {"numerical_steps": ["median_imputation", "standard_scaling"],
                                                  "categorical_steps": ["mode_imputation", "onehot_encoding"]})
        self.model = pp.fit_preprocessor(df, self.roles, known_medians)
        self.log("Fitted and transformed data", {"original_shape": (self.model.rows, len(df.columns)),
                                                 "transformed_shape": (self.model.rows, len(self.model.names))})
        return self.model

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        return self.fit(df).transform(df), list(self.model.names)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted("fit the preprocessor before transform")
        return self.model.transform(df)

    def split(self, df: DataFrame, test_size: float = TEST_SIZE, stratify: bool = True) -> DataFrame:
        return resample.split(df, self.roles.id, test_size=test_size, stratify=stratify, on_step=self.log)

    def rebalance(self, df: DataFrame, method: str = "smote") -> DataFrame:
        return resample.rebalance(df, self.roles.id, method=method, on_step=self.log)


@dataclass
class Prepared:
    rows: DataFrame  # id, label, features, split
    names: list[str]
    model: pp.PreprocessModel
    log: StepLog


def prepare(df: DataFrame, roles: Roles = LOAN_ROLES, outliers: str = "clip", imbalance: str = "smote",
            test_size: float = TEST_SIZE, fit_on: str = "all") -> Prepared:
    """Clip, impute, encode and scale, split, rebalance the train rows.

    ``fit_on='all'`` fits every constant on the whole table before the split, which leaks
    test rows into the fit but is what the original job computes; ``'train'`` splits first.
    Removing outliers chooses rows by fences of the whole table before the split, so it cannot
    be combined with ``'train'``.

    With clipping, one quantile fit serves fences and medians: a fence never cuts into the
    inner half, so the median of the clipped column is the median of the raw one. Fences
    come first and imputation is part of the fitted projection, so no intermediate table is
    written and the row work is one narrow select over the scan.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    if outliers not in OUTLIER_METHODS:
        raise ValueError(f"unknown outlier method: {outliers}")
    if fit_on == "train" and outliers == "remove":
        raise ValueError("outliers='remove' fits fences before the split and would leak into fit_on='train'")
    df, pre, parted = nan_to_null(df), Preprocessor(roles), None
    if outliers == "remove":  # rows disappear, so this comes before any split
        df = pre.handle_outliers(df, "remove")
    fit_rows = df
    if fit_on == "train":
        parted = resample.split(df, roles.id, roles.target, test_size, on_step=pre.log)
        fit_rows = parted.filter(F.col("split") == "train").drop("split")
    medians, source = None, df if parted is None else parted
    if outliers == "clip":
        cols = roles.present(df, roles.numeric)
        fences = fence_constants(fit_rows, cols)
        for c, f in fences.items():
            pre.log(f"Clipped outliers in {c}", {"lower_bound": f["lower"], "upper_bound": f["upper"]})
        medians = {c: fences[c]["median"] if c in fences else None for c in cols}
        fit_rows, source = clip(fit_rows, fences), clip(source, fences)
    model = pre.fit(fit_rows, medians)
    at = len(pre.log.steps) - 2  # imputation is logged before the pipeline steps
    for c in roles.features:
        if model.missing.get(c):
            kind, value = ("median", model.numeric[c][0]) if c in model.numeric else ("mode", model.categorical[c][0])
            pre.log.steps.insert(at, (f"Imputed {c} with {kind}", {"value": value}))
            at += 1
    if parted is None:
        rows = pre.split(model.transform(source), test_size)
    else:
        rows = model.transform(source, keep=("split",)).select(roles.id, "label", "features", "split")
    if imbalance != "none":
        rows = durable(rows)  # read several times from here on
        train = rows.filter(F.col("split") == "train").drop("split")
        train = pre.rebalance(train, imbalance).withColumn("split", F.lit("train"))
        rows = train.unionByName(rows.filter(F.col("split") == "test"))
    return Prepared(rows, list(model.names), model, pre.log)
