"""Target, ordinal and binary encoding of text columns, with a merge of rare categories.

The fitted tables are DataFrames with one row per category (and fold), not driver values: a
column may have more categories than a driver holds. Rows meet them in equality joins, whose
strategy Spark chooses by measured size. A category that very many rows share is spread by its fold
and by Spark's split of skewed partitions; the fitted side holds each key once.

Target means are out of fold: a row's code comes from rows of other folds only, so no row sees
its own label. Folds are a function of the row's id.

Defined results: a missing value is the category ``nan``; a category unseen in the fit gets the
overall mean, or the code after the last one; repeated rows are encoded alike; an
empty table gives empty tables; columns that clash with a result column give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.functions.scalars import long_text
from loanlab.operators.ranking import running_totals
from loanlab.session import durable

MISSING, RARE = "nan", "(rare)"


def category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def category_counts(df: DataFrame, cols, keep=()) -> DataFrame:
    """(feature, value, n): partial sums first, one row per category after."""
    cells = long_text(df, cols, keep).withColumn("value", F.coalesce("value", F.lit(MISSING)))
    return cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_rare(df: DataFrame, cols, least: int) -> DataFrame:
    """Categories with fewer than ``least`` rows become ``(rare)``. Other columns stay."""
    kept = durable(category_counts(df, cols).where(F.col("n") >= least))
    for c in cols:
        names = kept.where(F.col("feature") == c).select(F.col("value").alias("_value"))
        df = (df.withColumn("_v", category(c)).join(names, F.col("_v") == F.col("_value"), "left")
              .withColumn(c, F.when(F.col("_value").isNull(), RARE).otherwise(F.col("_v"))).drop("_v", "_value"))
    return df


# ---------------------------------------------------------------- target encoding

def fold_of(id_col: str, folds: int, salt: str = "fold") -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class TargetEncoding:
    """``table``: (feature, value, fold, mean), means over the other folds; fold -1 is for new rows."""

    table: DataFrame
    priors: dict[int, float]
    folds: int
    id_col: str

    def apply(self, df: DataFrame, cols, new_rows: bool = False, suffix: str = "_te") -> DataFrame:
        """Adds ``<column><suffix>``. Rows of the fit are encoded without their fold, new rows with all folds."""
        fold = F.lit(-1) if new_rows else fold_of(self.id_col, self.folds)
        prior = F.create_map(*[F.lit(x) for f, p in self.priors.items() for x in (f, p)])
        df = df.withColumn("_fold", fold)
        for c in cols:
            codes = self.table.where(F.col("feature") == c).select(
                F.col("value").alias("_value"), F.col("fold").alias("_f"), F.col("mean").alias("_mean"))
            df = df.withColumn("_v", category(c)).join(
                codes, (F.col("_v") == F.col("_value")) & (F.col("_fold") == F.col("_f")), "left")
            df = df.withColumn(c + suffix, F.coalesce("_mean", F.element_at(prior, F.col("_fold")))).drop(
                "_v", "_value", "_f", "_mean")
        return df.drop("_fold")


def fit_target_encoding(df: DataFrame, cols, target: str, id_col: str, folds: int = 5,
                        smoothing: float = 20.0) -> TargetEncoding:
    """Mean of the target by category, drawn to the overall mean with the weight of ``smoothing`` rows.

    All sums over other folds come as total less own fold from one grouped count.
    """
    if folds < 2:
        raise ValueError("out-of-fold means need two folds or more")
    rows = df.select(*cols, F.col(target).cast("double").alias("_y"), fold_of(id_col, folds).alias("_fold")).where(
        F.col("_y").isNotNull())
    cells = long_text(rows, cols, ("_y", "_fold")).withColumn("value", F.coalesce("value", F.lit(MISSING)))
    parts = durable(cells.groupBy("feature", "value", F.col("_fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")))
    held = {r["fold"]: (r["n"], r["s"]) for r in parts.where(F.col("feature") == cols[0]).groupBy("fold").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # one row per fold
    n_all, s_all = sum(n for n, _ in held.values()), sum(s for _, s in held.values())
    priors = {-1: s_all / n_all if n_all else 0.0}
    for f in range(folds):
        n, s = held.get(f, (0, 0.0))
        priors[f] = (s_all - s) / (n_all - n) if n_all > n else priors[-1]
    total = parts.groupBy("feature", "value").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    grid = total.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
    own = grid.join(parts, ["feature", "value", "fold"], "left")
    n, s = F.col("n_all") - F.coalesce("n", F.lit(0)), F.col("s_all") - F.coalesce("s", F.lit(0.0))
    prior = F.element_at(F.create_map(*[F.lit(x) for f, p in priors.items() for x in (f, p)]), F.col("fold"))
    table = own.select("feature", "value", "fold", ((s + F.lit(smoothing) * prior) / (n + F.lit(smoothing))).alias("mean"))
    return TargetEncoding(durable(table), priors, folds, id_col)


# ---------------------------------------------------------------- ordinal and binary codes

def ordinal_codes(counts: DataFrame, order: str = "value") -> DataFrame:
    """(feature, value, code): the place of each category, by value or by descending frequency."""
    if order == "value":
        ranked = running_totals(counts.select("feature", "value").withColumn("one", F.lit(1)), ["feature"], "value", ["one"])
    elif order == "frequency":
        # one sort key per category: the more frequent first, then by value
        keyed = counts.select("feature", F.struct((-F.col("n")).alias("less"), "value").alias("key"), F.lit(1).alias("one"))
        ranked = running_totals(keyed, ["feature"], "key", ["one"]).withColumn("value", F.col("key.value"))
    else:
        raise ValueError(f"unknown order: {order}")
    return ranked.select("feature", "value", (F.col("cum_one") - 1).alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, cols, suffix: str = "_code") -> DataFrame:
    """Adds ``<column><suffix>``; categories without a code get the number of codes."""
    sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in cols:
        mine = codes.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = (df.withColumn("_v", category(c)).join(mine, F.col("_v") == F.col("_value"), "left")
              .withColumn(c + suffix, F.coalesce("_code", F.lit(sizes.get(c, 0))).cast("bigint")).drop("_v", "_value", "_code"))
    return df


def binary_columns(df: DataFrame, codes: DataFrame, cols) -> DataFrame:
    """Adds ``<column>_bit<i>``: the code plus one in binary, lowest bit first; all zero for unseen categories."""
    sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    df = apply_codes(df, codes, cols, "_ordinal_code")
    for c in cols:
        n, code = sizes.get(c, 0), F.col(f"{c}_ordinal_code")
        place = F.when(code < n, code + 1).otherwise(0)
        for bit in range(max(1, n.bit_length())):
            df = df.withColumn(f"{c}_bit{bit}", F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))
        df = df.drop(f"{c}_ordinal_code")
    return df
