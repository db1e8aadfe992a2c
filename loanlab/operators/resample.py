"""Train/test split, k-fold assignment, undersampling, class weights, oversampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array

from loanlab.fixed_values import CV_FOLDS, RANDOM_SEED, TEST_SIZE
from loanlab.operators.neighbors import nearest_neighbors
from loanlab.operators.ranking import running_totals
from loanlab.operators.selection import below, hash_cutoffs, hash_unit, largest_remainder

METHODS = ("smote", "undersample", "none")


def class_counts(df: DataFrame, label: str = "label") -> dict:
    """Rows per class (a handful of constants)."""
    return {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}


def class_count_table(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))


def split(df: DataFrame, id_col: str, label: str = "label", test_size: float = TEST_SIZE,
          stratify: bool = True, seed: int = RANDOM_SEED, on_step=None) -> DataFrame:
    """Add ``split`` ('train' / 'test') with exactly ``ceil(n * test_size)`` test rows.

    Class quotas follow the largest remainder of the train share; test takes the rest.
    """
    def quota(counts):
        n = sum(counts.values())
        n_test = math.ceil(n * test_size)
        train = largest_remainder(counts, n - n_test)
        return {s: [counts[s] - train[s]] for s in counts}

    stratum = label if stratify else None
    counts, cuts = hash_cutoffs(df, id_col, stratum, seed, quota)
    n = sum(counts.values())
    if on_step:
        on_step("Split data", {"train_size": n - math.ceil(n * test_size), "test_size": math.ceil(n * test_size),
                               "stratified": stratify})
    return df.withColumn("split", F.when(below(id_col, stratum, seed, cuts), "test").otherwise("train"))


def fold_sizes(counts: dict, k: int) -> dict:
    """Rows of each class per fold; classes are dealt out one after the other, so fold
    totals differ by at most one row too."""
    out, start = {}, 0
    for s in sorted(counts, key=lambda v: (v is not None, v)):
        n = counts[s]
        # positions start .. start+n-1 go to fold (position mod k)
        out[s] = [len(range(start + (i - start) % k, start + n, k)) for i in range(k)]
        start += n
    return out


def kfold(df: DataFrame, id_col: str, label: str = "label", k: int = CV_FOLDS, seed: int = RANDOM_SEED) -> DataFrame:
    """Add ``fold`` (0..k-1): stratified, disjoint, exact sizes, by hash ranges."""
    def bounds(counts):
        return {s: [sum(sizes[: i + 1]) for i in range(k - 1)] for s, sizes in fold_sizes(counts, k).items()}

    _, cuts = hash_cutoffs(df, id_col, label, seed, bounds)
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(below(id_col, label, seed, cuts, i), i).otherwise(fold)
    return df.withColumn("fold", fold)


def undersample(df: DataFrame, id_col: str, label: str = "label", seed: int = RANDOM_SEED) -> DataFrame:
    """Every class down to the smallest, without replacement."""
    def quota(counts):
        return {s: [min(counts.values())] for s in counts}

    _, cuts = hash_cutoffs(df, id_col, label, seed, quota)
    return df.filter(below(id_col, label, seed, cuts))


def balanced_weights(df: DataFrame, label: str = "label", counts: dict | None = None) -> DataFrame:
    """Add ``weight`` = n / (classes * n_class), as literals of the counted classes."""
    counts = counts or class_counts(df, label)
    n, w = sum(counts.values()), F.lit(None).cast("double")
    for s, c in counts.items():
        w = F.when(F.col(label).eqNullSafe(F.lit(s)), n / (len(counts) * c)).otherwise(w)
    return df.withColumn("weight", w)


def smote(df: DataFrame, id_col: str, label: str = "label", features: str = "features",
          k: int = 5, seed: int = RANDOM_SEED) -> DataFrame:
    """Grow every smaller class to the size of the largest with interpolated rows.

    Each synthetic row lies on the segment from a base row to one of its k nearest rows of
    the same class. Draws are spread evenly: every base row gets the same number, and the
    rows with the smallest hashes one more. Neighbour and position follow from the hash of
    (seed, base id, draw number). Adds ``synthetic`` (boolean).

    Synthetic ids are a running number above the largest id (below the smallest one where
    there is no room above); text ids get the draw number appended. A class that must grow
    needs more than ``k`` rows: fewer raise ``ValueError``, and the caller may pass a smaller k.
    """
    counts = class_counts(df, label)
    top = max(counts.values())
    out = df.withColumn("synthetic", F.lit(False))
    is_vector = df.schema[features].dataType.typeName() == "vectorudt"
    vec = vector_to_array(F.col(features)) if is_vector else F.col(features)
    short = {s: (top - n, n) for s, n in counts.items() if n < top}
    for s, (_, n) in short.items():
        if n <= k:
            raise ValueError(f"class {s!r} has {n} rows; {k} neighbours need more than {k}")
    text_id = df.schema[id_col].dataType.typeName() == "string"
    free = None if text_id or not short else _free_ids(df, id_col, sum(need for need, _ in short.values()))
    for s in sorted(short, key=str):
        need, n = short[s]
        base = df.filter(F.col(label).eqNullSafe(F.lit(s)))
        pts = base.select(F.col(id_col).alias("id"), vec.alias("vec"))
        near = nearest_neighbors(pts, pts, k, exclude_self=True)
        near = near.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))).alias("near"))  # k entries per row
        each, extra = divmod(need, n)
        _, cuts = hash_cutoffs(base, id_col, None, seed, lambda c: {x: [extra] for x in c})
        draws = F.lit(each) + below(id_col, None, seed, cuts).cast("int")
        plan = base.withColumn("_bvec", vec).withColumn("_draws", draws).filter("_draws > 0")
        if free is not None:  # the number of draws before this row
            before = running_totals(plan.select(F.col(id_col).alias("_rid"), "_draws"), [], "_rid", ["_draws"])
            plan = plan.join(before.select("_rid", (F.col("cum__draws") - F.col("_draws")).alias("_before")),
                             F.col(id_col) == F.col("_rid"))
        plan = (plan.join(near, F.col(id_col) == F.col("query_id"))
                .withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
                .withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"),
                                                      F.col("_draw").cast("string")).cast("binary")))
                .withColumn("_pick", F.least(F.floor(hash_unit(F.col("_key"), 1) * F.size("near")).cast("int"),
                                             F.size("near") - 1))
                .withColumn("_nid", F.element_at("near", F.col("_pick") + 1)["neighbor_id"])
                .withColumn("_u", hash_unit(F.col("_key"), 9)))
        mates = pts.select(F.col("id").alias("_mid"), F.col("vec").alias("_nvec"))
        # _nid repeats where one point is everybody's neighbour; AQE splits such a key
        mixed = plan.join(mates, F.col("_nid") == F.col("_mid")).withColumn(
            "_new", F.expr("zip_with(_bvec, _nvec, (a, b) -> a + _u * (b - a))"))
        new_id = (F.concat(F.col(id_col), F.lit("#"), F.col("_draw").cast("string")) if text_id else
                  F.lit(free) + F.col("_before") + F.col("_draw") - 1)
        new = mixed.select(
            *[(new_id if c == id_col else
               (array_to_vector("_new") if is_vector else F.col("_new")) if c == features else
               F.col(c)).alias(c, **({"metadata": df.schema[c].metadata} if c == features else {}))
              for c in df.columns],
            F.lit(True).alias("synthetic"))
        out = out.unionByName(new)
        free = None if text_id else free + need
    return out


def _free_ids(df: DataFrame, id_col: str, wanted: int) -> int:
    """The first of ``wanted`` consecutive ids that no row has."""
    lo, hi = df.agg(F.min(F.col(id_col).cast("bigint")), F.max(F.col(id_col).cast("bigint"))).first()
    if hi + wanted < 1 << 63:
        return hi + 1
    if lo - wanted >= -(1 << 63):
        return lo - wanted
    raise ValueError(f"the ids of {id_col} leave no room for {wanted} more")


def rebalance(df: DataFrame, id_col: str, label: str = "label", method: str = "smote",
              seed: int = RANDOM_SEED, on_step=None) -> DataFrame:
    """'smote', 'undersample' or 'none'."""
    if method not in METHODS:
        raise ValueError(f"unknown resampling method: {method}")
    if method == "none":
        return df
    counts = class_counts(df, label)
    if method == "smote":
        out, after = smote(df, id_col, label, seed=seed).drop("synthetic"), max(counts.values())
    else:
        out, after = undersample(df, id_col, label, seed), min(counts.values())
    if on_step:
        on_step(f"Applied {method}", {"original_distribution": counts,
                                      "new_distribution": {s: after for s in counts}})
    return out
