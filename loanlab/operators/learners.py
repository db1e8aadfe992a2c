"""The learner registry.

Each learner fits on ``(id, label, features VECTOR)`` and gives a model with one method,
``score(df)``, that adds ``score`` (probability of class 1) and ``prediction``. The linear learner and
the single tree are Spark ML estimators; the forest (``forest.py``) and the boosted trees (``boosting.py``)
grow from binned rows. Gaussian naive Bayes and the boosted stumps are
fitted constants applied as column expressions; nearest neighbours is the distributed join.
"""

from __future__ import annotations

import logging
import math
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.fixed_values import CV_FOLDS, RANDOM_SEED, TUNING_GRIDS
from loanlab.operators import binned, boosting, forest, logistic
from loanlab.operators.binned import Packing, block_codes, block_rows, in_one_task, store_blocks, summed
from loanlab.operators.evaluate import METRICS, decide, evaluate
from loanlab.operators.neighbors import nearest_neighbors
from loanlab.operators.resample import balanced_weights, class_counts, kfold
from loanlab.session import let_go, shared_dir

log = logging.getLogger(__name__)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


class UnknownModel(ValueError):
    """Not in the registry."""


# ---------------------------------------------------------------- fitted models

@dataclass
class SparkModel:
    """A Spark ML classification model."""

    model: object
    kind: str = "spark_ml"

    def score(self, df: DataFrame) -> DataFrame:
        """Class-1 probability; else the raw score of class 1; else no score (an AUC of 0).

        Without probabilities the decision is the model's own.
        """
        out = self.model.transform(df)
        made = ("rawPrediction", "probability", "prediction")
        if "probability" in out.columns:
            out = out.withColumn("score", vector_to_array(F.col("probability"))[1])
            return out.drop(*made).withColumn("prediction", decide(F.col("score")))
        raw = vector_to_array(F.col("rawPrediction"))[1] if "rawPrediction" in out.columns else F.lit(None).cast("double")
        own = out.withColumn("score", raw).withColumn("_own", F.col("prediction").cast("int"))
        return own.drop(*made).withColumnRenamed("_own", "prediction")

    def importance(self):
        if hasattr(self.model, "featureImportances"):
            return [float(v) for v in self.model.featureImportances.toArray()]
        if hasattr(self.model, "coefficients"):
            return [abs(float(v)) for v in self.model.coefficients.toArray()]
        return None


@dataclass
class NaiveBayesModel:
    """Per-class prior, means and smoothed variances; the score is a column expression."""

    classes: dict[int, tuple[float, list[float], list[float]]]
    kind: str = "gaussian_nb"

    def score(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col("features"))

        def log_joint(c):
            prior, mean, var = self.classes[c]
            terms = [F.lit(math.log(prior) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in var))]
            for i, (m, v) in enumerate(zip(mean, var)):
                terms.append(F.pow(x[i] - F.lit(m), 2.0) * F.lit(-0.5 / v))
            return reduce(lambda a, b: a + b, terms)

        gap = log_joint(0) - log_joint(1) if len(self.classes) == 2 else F.lit(
            -math.inf if 1 in self.classes else math.inf)
        # exp is capped where the probability is 0 in double precision anyway
        p1 = 1.0 / (1.0 + F.exp(F.least(gap, F.lit(700.0))))
        return df.withColumn("score", p1).withColumn("prediction", decide(F.col("score")))

    def importance(self):
        return None


def _logit(p: float) -> float:
    eps = 2.220446049250313e-16
    a, b = max(p, eps), max(1.0 - p, eps)
    return math.log(a) - math.log(b)


@dataclass
class StumpsModel:
    """Boosted stumps: (feature, threshold, P(1) left, P(1) right) per round."""

    stumps: list[tuple[int, float, float, float]]
    importances: list[float]
    kind: str = "stumps"

    @staticmethod
    def logit(p: float) -> float:
        return _logit(p)

    def margin(self, scale: float, x):
        """Sum of the stumps' log odds times ``scale``; stumps on one cut are added first."""
        shape: dict[tuple, list[float]] = {}
        for f, t, left, right in self.stumps:
            s = shape.setdefault((f, t), [0.0, 0.0])
            s[0] += scale * self.logit(left)
            s[1] += scale * self.logit(right)
        terms = [F.when(x[f] <= F.lit(t), F.lit(a)).otherwise(F.lit(b)) for (f, t), (a, b) in shape.items()]
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    def score(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col("features"))
        d = self.margin(1.0 / max(1, len(self.stumps)), x)
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-d))).withColumn("prediction", decide(F.col("score")))

    def importance(self):
        return self.importances


@dataclass
class NeighborsModel:
    """The training points; scoring is the nearest-neighbour join."""

    points: DataFrame
    id_col: str
    k: int = 5
    kind: str = "neighbors"

    def score(self, df: DataFrame) -> DataFrame:
        q = df.select(F.col(self.id_col).alias("id"), vector_to_array("features").alias("vec"))
        near = nearest_neighbors(q, self.points, self.k)
        share = near.groupBy("query_id").agg(F.avg(F.col("label").cast("double")).alias("score"))
        return (df.join(share, F.col(self.id_col) == F.col("query_id")).drop("query_id")
                .withColumn("prediction", decide(F.col("score"))))

    def importance(self):
        return None


# ---------------------------------------------------------------- learners

def _width(df: DataFrame) -> int:
    """Vector length from the column's attributes; one row is read only if they are absent."""
    known = df.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
    return known or len(df.select("features").first()["features"])


def _binary(train: DataFrame) -> DataFrame:
    """Tell Spark ML that the label has two classes, which saves it a pass to find out."""
    two = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
    return train.withColumn("label", F.col("label").cast("double").alias("label", metadata=two))


def _weighted(train: DataFrame, balanced: bool) -> DataFrame:
    return balanced_weights(_binary(train)) if balanced else _binary(train)


def _fit_tree_family(estimator, train: DataFrame) -> SparkModel:
    shared_dir(train.sparkSession)  # tree ensembles checkpoint their node ids
    return SparkModel(estimator.fit(train))


def fit_logistic_regression(train: DataFrame, id_col: str, c: float = 1.0, l1_ratio: float = 0.0,
                            max_iter: int = 1000) -> SparkModel:
    """L2 with inverse strength C: Spark averages the loss, hence regParam = 1 / (C * sum of weights)."""
    train = _binary(train)
    counts = class_counts(train)
    n = sum(counts.values())  # balanced weights add up to the row count
    est = LogisticRegression(maxIter=max_iter, weightCol="weight", standardization=False, tol=1e-6,
                             regParam=1.0 / (c * n), elasticNetParam=l1_ratio)
    return SparkModel(est.fit(balanced_weights(train, counts=counts)))


def fit_decision_tree(train: DataFrame, id_col: str, max_depth: int = 10) -> SparkModel:
    return _fit_tree_family(DecisionTreeClassifier(maxDepth=max_depth, weightCol="weight", maxBins=128,
                                                   seed=RANDOM_SEED), _weighted(train, True))


FOREST_BINS = 32  # cuts of a feature that a forest's nodes choose from


def fit_random_forest(train: DataFrame, id_col: str, num_trees: int = 100, max_depth: int = 15,
                      min_leaf: int = 1) -> forest.ForestModel:
    """Bootstrapped trees with balanced class weights and a new draw of sqrt(features) at every node."""
    train = _binary(train)
    cuts = _cuts(train, _width(train), FOREST_BINS)
    return forest.fit(train, id_col, class_counts(train), cuts, num_trees, max_depth, min_leaf, RANDOM_SEED)


def _fit_boosting(train: DataFrame, id_col: str, bins: int, rounds: int, max_depth: int, rate: float, min_leaf: int = 1,
                  subsample: float = 1.0, balanced: bool = False) -> boosting.BoostedModel:
    train, weights = _binary(train), (1.0, 1.0)
    if balanced:
        counts = class_counts(train)
        n = sum(counts.values())
        weights = tuple(n / (len(counts) * counts[c]) if counts.get(c) else 0.0 for c in (0, 1))
    # a feature has one bin more than cuts
    return boosting.fit(train, id_col, _cuts(train, _width(train), bins - 1), weights, rounds, max_depth, rate, min_leaf,
                        subsample, RANDOM_SEED)


def fit_gradient_boosting(train: DataFrame, id_col: str, rounds: int = 100, max_depth: int = 5,
                          rate: float = 0.1) -> boosting.BoostedModel:
    """32 bins."""
    return _fit_boosting(train, id_col, 32, rounds, max_depth, rate)


def fit_regularised_boosting(train: DataFrame, id_col: str, rounds: int = 100, max_depth: int = 5,
                             rate: float = 0.1, subsample: float = 1.0) -> boosting.BoostedModel:
    """256 bins and at least 4 rows per leaf (a minimum hessian of 1 at p(1-p) <= 1/4)."""
    return _fit_boosting(train, id_col, 256, rounds, max_depth, rate, min_leaf=4, subsample=subsample)


def fit_histogram_boosting(train: DataFrame, id_col: str, rounds: int = 100, max_depth: int = 5,
                           rate: float = 0.1) -> boosting.BoostedModel:
    """255 bins, 20 rows per leaf, balanced weights."""
    return _fit_boosting(train, id_col, 255, rounds, max_depth, rate, min_leaf=20, balanced=True)


def fit_neighbors(train: DataFrame, id_col: str, k: int = 5) -> NeighborsModel:
    return NeighborsModel(train.select(F.col(id_col).alias("id"), vector_to_array("features").alias("vec"),
                                       "label"), id_col, k)


def fit_naive_bayes(train: DataFrame, id_col: str, smoothing: float = 1e-9) -> NaiveBayesModel:
    """One aggregate over the classes; the variance floor comes from the pooled moments."""
    width = _width(train)
    x = train.select("label", vector_to_array("features").alias("x"))
    stats = [F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"),
             F.array(*[F.var_pop(F.col("x")[i]) for i in range(width)]).alias("var")]
    rows = x.groupBy("label").agg(F.count("*").alias("n"), *stats).collect()
    n = sum(r["n"] for r in rows)
    pooled = []
    for i in range(width):
        mean = sum(r["n"] * r["mean"][i] for r in rows) / n
        pooled.append(sum(r["n"] * (r["var"][i] + (r["mean"][i] - mean) ** 2) for r in rows) / n)
    floor = smoothing * max(pooled)
    return NaiveBayesModel({int(r["label"]): (r["n"] / n, list(r["mean"]), [v + floor for v in r["var"]])
                            for r in rows})


BINS = 128  # cuts of a feature that a stump chooses from


def _cuts(train: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Candidate cuts by feature: quantiles of a sketch with bounded state, without the largest value."""
    x = vector_to_array("features")
    wide = train.select(*[x[i].alias(f"x{i}") for i in range(width)], *[F.lit(0.0).alias("_")])
    probs = [i / bins for i in range(bins + 1)]
    found = wide.approxQuantile([f"x{i}" for i in range(width)], probs, 1.0 / (8 * bins))
    return [sorted(set(q))[:-1] for q in found]


def _weight_kernel(packing: Packing, margins: np.ndarray):
    """Kernel: row weights summed by feature and (bin, label). ``margins[f, b]``: half the log odds that the
    stumps on feature f give to bin b so far, so a row's weight takes one look-up per group of features."""
    tables = [sum(packing.spread(f, margins[f, :packing.sizes[f]]) for f in fs) for fs in packing.groups]
    used = [g for g, t in enumerate(tables) if t.any()]

    def kernel(rows):
        sums = [np.zeros((2, s)) for s in packing.slots]
        for raw, zeros in rows:
            codes = block_codes(raw, packing)
            margin = sum((tables[g][codes[g]] for g in used), np.zeros(codes.shape[1]))
            margin[zeros:] *= -1.0
            weight = np.exp(margin)
            for g, slots in enumerate(packing.slots):
                sums[g][0] += np.bincount(codes[g, :zeros], weight[:zeros], slots)
                sums[g][1] += np.bincount(codes[g, zeros:], weight[zeros:], slots)
        return {0: packing.by_feature(np.concatenate(sums, axis=1).T)}
    return kernel


def _weight_sums(blocks: DataFrame, packing: Packing, margins: np.ndarray) -> list[np.ndarray]:
    # features x bins x classes numbers at most
    return packing.parts(np.array(summed(blocks, _weight_kernel(packing, margins), list, 1)[0]).reshape(-1, 2))


def _best_stump(sums: list[np.ndarray], cuts: list[list[float]]) -> tuple | None:
    """(feature, cut number, P(1) left, P(1) right) with the least weighted Gini impurity; None without a gain."""
    best, choice = None, None
    for f, edges in enumerate(cuts):
        left = sums[f].cumsum(axis=0)
        # the last running sum, so that a class without rows on the right has a weight of exactly 0
        left, right = left[:len(edges)], (left[-1] - left)[:len(edges)]
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        good = (n_left > 0) & (n_right > 0)
        if not good.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            purity = (left ** 2).sum(axis=1) / n_left + (right ** 2).sum(axis=1) / n_right
        # of cuts that differ by rounding only, the first: the sums come in any order
        purity = np.where(good, purity, -np.inf)
        at = int((purity >= purity.max() * (1 - 1e-12)).argmax())
        if best is None or purity[at] > best * (1 + 1e-12):
            best = purity[at]
            choice = (f, at, float(left[at, 1] / n_left[at]), float(right[at, 1] / n_right[at]))
    whole = sums[0].sum(axis=0)
    if best is None or best <= (whole ** 2).sum() / whole.sum() * (1 + 1e-12):
        return None
    return choice


def fit_adaboost(train: DataFrame, id_col: str, rounds: int = 100, rate: float = 0.1) -> StumpsModel:
    """Two-class SAMME.R over depth-1 trees, on rows binned and stored once.

    A row's weight is a function of the stumps so far, so no weight table is written and the
    lineage does not grow. A round is one pass over the stored blocks (``binned.py``) with one grouped sum
    of weights by (feature, bin, label), whatever the number of stumps; the stump is chosen from those sums.
    Up to ``LOCAL_ROWS`` rows one task holds the blocks and does all rounds.
    """
    width = _width(train)
    rows = _binary(train)
    cuts = _cuts(rows, width)
    packing = Packing(cuts)
    blocks = store_blocks(rows, id_col, packing).select("codes", "zeros")
    if 0 < block_rows(blocks, packing) <= binned.LOCAL_ROWS:
        stumps = _stumps_in_one_task(blocks, packing, cuts, rounds, rate)
    else:
        blocks = blocks.persist()
        stumps = _boosted_stumps(partial(_weight_sums, blocks, packing), cuts, rounds, rate)
        blocks.unpersist()
    gains = np.bincount([f for f, *_ in stumps], minlength=width) / max(1, len(stumps))
    return StumpsModel([(f, cuts[f][at], left, right) for f, at, left, right in stumps], [float(g) for g in gains])


def _boosted_stumps(sums, cuts: list[list[float]], rounds: int, rate: float) -> list[tuple]:
    """(feature, cut number, P(1) left, P(1) right) by round; ``sums``: those of ``_weight_sums``, by the margins."""
    stumps, margins = [], np.zeros((len(cuts), max(map(len, cuts), default=0) + 1))
    for _ in range(rounds):
        # w *= exp(-rate/2 * (ln p_true - ln p_other)); a stump does not mind the scale of w,
        # and with log odds below 37 the product stays far inside double range
        found = _best_stump(sums(margins), cuts)
        if found is None:
            break
        f, at, left, right = found
        margins[f, :at + 1] += 0.5 * rate * _logit(left)
        margins[f, at + 1:] += 0.5 * rate * _logit(right)
        stumps.append(found)
    return stumps


def _stumps_in_one_task(blocks: DataFrame, packing: Packing, cuts: list[list[float]], rounds: int, rate: float) -> list[tuple]:
    """As ``_boosted_stumps``, in a task that holds all blocks: a round is too little work for a pass of its own."""
    def work(held):
        held = sorted(held)  # the order of the sums

        def sums(margins):
            return packing.parts(_weight_kernel(packing, margins)(held)[0])
        stumps = _boosted_stumps(sums, cuts, rounds, rate)
        columns = [list(c) for c in zip(*stumps)] if stumps else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(range(len(stumps)), pa.int32()), *[
            pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))]],
            names=["round", "feature", "at", "p_left", "p_right"])
    rows = in_one_task(blocks, work, "round int, feature int, at int, p_left double, p_right double")
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["round"])]


REGISTRY = {
    "Logistic Regression": (fit_logistic_regression, "Spark ML logistic regression"),
    "Decision Tree": (fit_decision_tree, "Spark ML decision tree (binned thresholds)"),
    "Random Forest": (fit_random_forest, "random forest over binned rows"),
    "Gradient Boosting": (fit_gradient_boosting, "gradient-boosted trees over binned rows"),
    "XGBoost": (fit_regularised_boosting, "regularised boosting over binned rows"),
    "LightGBM": (fit_histogram_boosting, "histogram boosting, weighted, over binned rows"),
    "K-Nearest Neighbors": (fit_neighbors, "exact distributed nearest-neighbour join"),
    "Naive Bayes": (fit_naive_bayes, "Gaussian moments as column expressions"),
    "AdaBoost": (fit_adaboost, "SAMME.R over binned stumps"),
}


# ---------------------------------------------------------------- training

@dataclass
class TrainedModel:
    name: str
    implementation: str
    model: object
    train_seconds: float
    predictions: DataFrame
    importance: list[tuple[str, float]] | None = None
    metrics: dict = field(default_factory=dict)


def predict(name: str, model, rows: DataFrame, id_col: str) -> DataFrame:
    """(model_name, id, label, score, prediction)."""
    return model.score(rows).select(F.lit(name).alias("model_name"), F.col(id_col).alias("id"),
                                    F.col("label").cast("int").alias("label"), "score", "prediction")


def fit_model(name: str, train: DataFrame, id_col: str, **options):
    if name not in REGISTRY:
        raise UnknownModel(f"unknown model: {name}")
    return REGISTRY[name][0](train, id_col, **options)


def train_model(name: str, train: DataFrame, test: DataFrame, id_col: str, feature_names=None,
                **options) -> TrainedModel:
    """Fit, time, score the test rows, compute the five metrics and the importance."""
    started = time.monotonic()
    model = fit_model(name, train, id_col, **options)
    seconds = time.monotonic() - started
    predictions = predict(name, model, test, id_col).persist()
    row = evaluate(predictions).first()
    values = model.importance() if feature_names is not None else None
    importance = list(zip(feature_names, values)) if values is not None else None
    log.info("%s trained in %.2fs", name, seconds)
    return TrainedModel(name, REGISTRY[name][1], model, seconds, predictions, importance,
                        {m: row[m] for m in METRICS} if row else {})


def _run_jobs(spark: SparkSession, jobs, parallelism: int) -> list:
    """Run independent Spark jobs, some at a time; results in the order given."""
    if parallelism <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def train_models(train: DataFrame, test: DataFrame, id_col: str, feature_names=None, names=None,
                 options: dict | None = None, parallelism: int = 1) -> tuple[dict, dict]:
    """Train several models. A failure is logged and reported, the others go on.

    ``parallelism`` models are trained at a time; their train times then overlap.
    Returns ``({name: TrainedModel}, {name: error text})``.
    """
    def attempt(name):
        try:
            return train_model(name, train, test, id_col, feature_names, **(options or {}).get(name, {})), None
        except Exception as exc:  # one learner must not stop the job
            log.error("error training %s: %s", name, exc)
            return None, str(exc)
        finally:
            let_go(train.sparkSession)

    names = list(names or REGISTRY)
    results = dict(zip(names, _run_jobs(train.sparkSession, [partial(attempt, n) for n in names], parallelism)))
    return ({n: m for n, (m, _) in results.items() if m is not None},
            {n: e for n, (m, e) in results.items() if m is None})


def metrics_table(spark: SparkSession, models: dict) -> DataFrame:
    return spark.createDataFrame(
        [(m.name, m.implementation, float(m.train_seconds), *[m.metrics.get(k) for k in METRICS])
         for m in models.values()],
        "model_name string, implementation string, train_seconds double, "
        + ", ".join(f"{m} double" for m in METRICS))


def importance_table(spark: SparkSession, models: dict) -> DataFrame:
    return spark.createDataFrame(
        [(m.name, f, float(v)) for m in models.values() for f, v in (m.importance or [])],
        "model_name string, feature string, importance double")


def predictions_table(models: dict) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.predictions for m in models.values()])


def cross_validate(name: str, df: DataFrame, id_col: str, k: int = CV_FOLDS, parallelism: int = 1,
                   **options) -> DataFrame:
    """(fold, metric, value): one fit per fold gives all five metrics.

    The folds' logistic regressions are fitted side by side, as those of a grid: Spark's own would hold a copy of
    the rows for every fold.
    """
    if name not in REGISTRY:
        raise UnknownModel(f"unknown model: {name}")
    if name == "Logistic Regression":
        return tune(name, df, id_col, k, [options]).drop("setting")
    folded = kfold(df, id_col, k=k).persist(StorageLevel.DISK_ONLY)
    scored = _run_jobs(df.sparkSession, [partial(_score_fold, name, folded, id_col, i, options) for i in range(k)],
                       parallelism)
    by_fold = evaluate(reduce(DataFrame.unionByName, scored)).withColumnRenamed("model_name", "fold")
    return by_fold.unpivot(["fold"], list(METRICS), "metric", "value").withColumn("fold", F.col("fold").cast("int"))


def _score_fold(name, folded: DataFrame, id_col: str, i: int, options: dict, tag: str | int | None = None) -> DataFrame:
    """Predictions for one fold of a model fitted on the others, tagged in ``model_name``."""
    model = fit_model(name, folded.filter(F.col("fold") != i).drop("fold"), id_col, **options)
    part = predict(name, model, folded.filter(F.col("fold") == i).drop("fold"), id_col)
    return part.withColumn("model_name", F.lit(str(i) if tag is None else tag))


DEEPEST = 30  # Spark's tree depth limit stands for "no limit"


def setting_text(options: dict) -> str:
    return ", ".join(f"{a}={f'unlimited ({b})' if (a, b) == ('max_depth', DEEPEST) else b}"
                     for a, b in sorted(options.items()))


def grid_options(name: str) -> list[dict]:
    """Parameter sets of a model's declared grid, as options of its learner.

    Settings without a counterpart in the Spark learner (solver, minimum split size, leaf
    count) are left out; equal sets that remain are given once.
    """
    grid = TUNING_GRIDS[name]
    rename = {"n_estimators": "num_trees" if name == "Random Forest" else "rounds", "max_depth": "max_depth",
              "learning_rate": "rate", "subsample": "subsample", "min_samples_leaf": "min_leaf", "C": "c",
              "max_iter": "max_iter", "penalty": "l1_ratio"}
    sets = []
    for combo in product(*grid.values()):
        opts = {}
        for key, v in zip(grid, combo):
            if key == "penalty":
                v = 1.0 if v == "l1" else 0.0
            elif key == "max_depth":
                v = DEEPEST if v in (None, -1) else v
            if key in rename:
                opts[rename[key]] = v
        if opts not in sets:
            sets.append(opts)
    return sets


def tune(name: str, df: DataFrame, id_col: str, k: int = CV_FOLDS, sets=None, parallelism: int = 1) -> DataFrame:
    """(setting, fold, metric, value) for every parameter set of the model's grid, on the same folds.

    All scored folds are evaluated in one pass, keyed by setting and fold. The logistic regressions of a
    grid are fitted side by side (``logistic.py``).
    """
    folded = kfold(df, id_col, k=k)
    sets = list(sets if sets is not None else grid_options(name))
    texts = [setting_text(opts) for opts in sets]
    if name == "Logistic Regression":
        width = _width(df)
        blocks = logistic.store_rows(folded, width)
        scored = logistic.scored(blocks, width, k, logistic.fit_folds(blocks, width, k, sets))
    else:
        folded = folded.persist(StorageLevel.DISK_ONLY)
        jobs = [partial(_score_fold, name, folded, id_col, i, opts, n * k + i)
                for n, opts in enumerate(sets) for i in range(k)]
        scored = reduce(DataFrame.unionByName, _run_jobs(df.sparkSession, jobs, parallelism))
    at = F.col("model_name")
    return evaluate(scored).select(F.array(*[F.lit(t) for t in texts])[F.floor(at / k).cast("int")].alias("setting"),
                                   (at % k).cast("int").alias("fold"), *METRICS).unpivot(
        ["setting", "fold"], list(METRICS), "metric", "value")
