"""Profile aggregates over one table: counts, missing values, statistics, segments.

Every operator is one pass (two where a statistic must be fitted first) and shuffles only
partial aggregates. Inputs mark missing values with NULL (see ``nan_to_null``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab import fixed_values as fv
from loanlab.functions.quantiles import ROW_LIMIT, exact_quantiles
from loanlab.functions.scalars import (
    adjusted_skewness, is_numeric, long_text, percent, r2, ratio, rows_from_one,
)
from loanlab.roles import Roles


def table_summary(df: DataFrame, roles: Roles, loaded_at: str | None = None) -> DataFrame:
    """(section, key, value): sizes, target distribution, missing count per column, load time if given.

    One scan: the per-class partial result carries the missing counts as well.
    """
    by_class = df.groupBy(F.col(roles.target).cast("string").alias("k")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    missing = F.array(*[F.struct(F.lit(c).alias("key"), F.sum(f"m{i}").alias("value"))
                        for i, c in enumerate(df.columns)])
    sizes = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("bigint").alias("value")) for k, v in (
        ("total_records", F.sum("n")), ("total_features", F.lit(len(df.columns))),
        ("numerical_features", F.lit(len(roles.numeric))),
        ("categorical_features", F.lit(len(roles.categorical))))])
    target = F.array(F.struct(F.lit(roles.target).alias("key"), F.lit(None).cast("bigint").alias("value")))
    sections = by_class.agg(sizes.alias("size"), target.alias("target_column"), missing.alias("missing_values"))
    names = ["size", "target_column", "missing_values"]
    if loaded_at is not None:
        stamp = F.array(F.struct(F.lit(loaded_at).alias("key"), F.lit(None).cast("bigint").alias("value")))
        sections, names = sections.withColumn("load_timestamp", stamp), names + ["load_timestamp"]

    def tag(name):
        return F.transform(name, lambda e: F.struct(F.lit(name).alias("section"), e["key"].alias("key"),
                                                    e["value"].alias("value")))

    tagged = F.flatten(F.array(*[tag(s) for s in names]))
    classes = by_class.filter(F.col("k").isNotNull()).select(
        F.lit("target_distribution").alias("section"), F.col("k").alias("key"), F.col("n").alias("value"))
    return sections.select(F.inline(tagged)).unionByName(classes)


def feature_dictionary(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fv.FEATURE_DICTIONARY),
        "feature string, description string, type string, source string, business_relevance string")


def feature_info(df: DataFrame, exact: bool = True) -> DataFrame:
    """Description, type, missing % and distinct count of every column.

    Distinct values are counted in two steps (value, then column), so no task holds a
    column's value set; ``exact=False`` uses a sketch instead of shuffling values.
    """
    spark, cols = df.sparkSession, df.columns
    base = rows_from_one(
        df.agg(F.count("*").alias("_n"),
               *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)],
               *([] if exact else [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])),
        [F.struct(F.lit(c).alias("feature"), F.lit(t).alias("dtype"),
                  percent(F.col("_n") - F.col(f"c{i}"), F.col("_n")).alias("missing_pct"),
                  (F.lit(None).cast("bigint") if exact else F.col(f"d{i}")).alias("d"))
         for i, (c, t) in enumerate(df.dtypes)])
    if exact:
        distinct = (long_text(df, cols).filter(F.col("value").isNotNull()).distinct()
                    .groupBy("feature").agg(F.count("*").alias("unique_values")))
        base = base.drop("d").join(F.broadcast(distinct), "feature", "left")  # one row per column
    else:
        base = base.withColumnRenamed("d", "unique_values")
    words = feature_dictionary(spark)  # fixed dozen rows
    return base.join(F.broadcast(words), "feature", "left").select(
        "feature",
        F.coalesce("description", F.lit("N/A")).alias("description"),
        F.coalesce("type", "dtype").alias("type"),
        F.coalesce("source", F.lit("N/A")).alias("source"),
        F.coalesce("business_relevance", F.lit("N/A")).alias("business_relevance"),
        "missing_pct",
        F.coalesce("unique_values", F.lit(0).cast("bigint")).alias("unique_values"),
    )


def describe_numeric(df: DataFrame, cols, row_limit: int = ROW_LIMIT) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max: one row per column."""
    cols = list(cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], row_limit)
    x = {c: F.col(c).cast("double") for c in cols}
    wide = df.agg(*[F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(x[c]).alias("mean"),
        F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"),
        *[F.lit(v).cast("double").alias(k) for k, v in zip(("p25", "p50", "p75"), q[c])],
        F.max(x[c]).alias("max"),
    ).alias(f"s{i}") for i, c in enumerate(cols)])
    return rows_from_one(wide, [F.col(f"s{i}") for i in range(len(cols))])


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(feature, value, n) of every categorical column, missing excluded, largest first."""
    return (long_text(df, cols).filter(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count("*").alias("n"))
            .orderBy("feature", F.desc("n"), "value"))


def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """One row per class: count, percent, label, and the imbalance figures of the table."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    known = F.when(F.col("class").isNotNull(), F.col("n"))
    label = F.lit(None).cast("string")
    for k, text in fv.CLASS_LABELS.items():
        label = F.when(F.col("class") == k, text).otherwise(label)
    # the totals are one row, taken as a scalar, so a target of many values stays spread out
    one = counts.agg(F.struct(F.min(known).alias("lo"), F.max(known).alias("hi"), F.sum("n").alias("t")).alias("s")).scalar()
    return (counts.filter(F.col("class").isNotNull()).withColumn("s", one)
            .select("class", label.alias("label"), "n", percent(F.col("n"), F.col("s.t")).alias("percent"),
                    ratio(F.col("s.lo"), F.col("s.hi")).alias("imbalance_ratio"),
                    (ratio(F.col("s.lo"), F.col("s.hi")) < 0.5).alias("is_imbalanced"),
                    F.col("s.t").alias("total_samples")))


def headline_metrics(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows, features (columns minus the target), default rate %, table-wide missing %."""
    cells = None
    for c in df.columns:
        n = F.count(F.col(c))
        cells = n if cells is None else cells + n
    n = F.count("*")
    return df.agg(
        n.alias("total_records"), F.lit(len(df.columns) - 1).alias("total_features"),
        (F.avg(F.col(roles.target).cast("double")) * 100.0).alias("default_rate_pct"),
        percent(n * len(df.columns) - cells, n * len(df.columns)).alias("missing_pct"))


def type_histogram(df: DataFrame) -> DataFrame:
    """Number of columns per type (schema only, no scan)."""
    return (df.sparkSession.createDataFrame(df.dtypes, "name string, type string")
            .groupBy("type").agg(F.count("*").alias("n_columns")))


def missing_report(df: DataFrame, roles: Roles) -> DataFrame:
    """Columns with missing values: count, % of all rows, type, suggested imputation."""
    wide = df.agg(F.count("*").alias("_n"), *[
        F.struct(F.count_if(F.col(c).isNull()).alias("missing"),
                 (adjusted_skewness(c) if c in roles.numeric and is_numeric(df, c)
                  else F.lit(None).cast("double")).alias("skew")).alias(f"s{i}")
        for i, c in enumerate(df.columns)])

    def advice(i, c):
        if c not in roles.numeric:
            return F.lit(fv.STRATEGY_MODE)
        return F.when(F.col(f"s{i}.skew") > 1, fv.STRATEGY_MEDIAN).otherwise(fv.STRATEGY_MEAN)

    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}.missing").alias("missing_count"),
                     r2(percent(F.col(f"s{i}.missing"), F.col("_n"))).alias("missing_pct"),
                     F.lit(t).alias("data_type"), advice(i, c).alias("imputation_strategy"))
            for i, (c, t) in enumerate(df.dtypes)]
    return rows_from_one(wide, rows).filter("missing_count > 0")


def missing_chart(df: DataFrame, roles: Roles) -> DataFrame:
    """Bars of the missing-values chart, smallest count first."""
    return (missing_report(df, roles).select("feature", "missing_count", "missing_pct")
            .orderBy("missing_count", "feature"))


def default_rate_by_category(df: DataFrame, roles: Roles, cols=None) -> DataFrame:
    """Sum, count and rate of the target for each category, all columns in one job.

    Rows are unpivoted and partially aggregated before the shuffle, so a category that
    holds most of the table costs one partial row per map task.
    """
    cols = list(cols or roles.present(df, roles.categorical))
    y = F.col("_y")
    return (long_text(df.withColumn("_y", F.col(roles.target)), cols, keep=("_y",))
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.sum(y.cast("bigint")).alias("defaults"), F.count(y).alias("n"))
            .withColumn("default_rate", percent(F.col("defaults"), F.col("n")))
            .orderBy("feature", F.desc("default_rate"), "value"))


GAPS_AT_ONCE = 12  # columns with gaps whose null patterns (2^12 at most) are told apart in one pass


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlation, melted to (x, y, corr); NULL for a constant side.

    Rows are grouped by which of the columns with gaps they have, because inside one pattern
    every pair sees the same rows. One pass then needs plain sums only: per column and per
    pair of columns, not per pair and column, which keeps the aggregate small enough for
    generated code. With more than ``GAPS_AT_ONCE`` such columns, the columns are cut into
    groups and every two groups get a pass of their own, so the patterns stay bounded. Values
    are taken relative to the mean of their column, so that the sums of squares do not cancel.
    """
    cols = list(cols)
    k = len(cols)
    raw = [F.col(f"`{c}`").cast("double") for c in cols]
    finite = [F.when(F.abs(x) < float("inf"), x) for x in raw]
    facts = df.agg(F.count("*").alias("n"), F.array(*[F.count(x) for x in raw]).alias("has"),
                   F.array(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in finite]).alias("mean")).first()
    gaps = {i for i in range(k) if facts["has"][i] < facts["n"]}
    size = k if len(gaps) <= GAPS_AT_ONCE else GAPS_AT_ONCE // 2
    groups = [range(a, min(a + size, k)) for a in range(0, k, size)] if k else []
    rows = None
    for g, one in enumerate(groups):
        for two in groups[g:]:
            part = _pair_sums(df, raw, facts["mean"], sorted({*one, *two}), gaps,
                              [(i, j) for i in one for j in two if i <= j])
            rows = part if rows is None else rows.unionByName(part)
    total = rows.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "p", "si", "sj", "qi", "qj")],
        (F.min("loi") < F.max("hii")).alias("vi"), (F.min("loj") < F.max("hij")).alias("vj"))
    cov = F.expr("p - si * sj / n")
    scale = F.expr("sqrt(qi - si * si / n) * sqrt(qj - sj * sj / n)")
    corr = F.when(F.col("vi") & F.col("vj"),
                  F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.try_divide(cov, scale)))
    name = F.array(*[F.lit(c) for c in cols])
    # every cell of the matrix, also where no row has both columns
    cells = df.sparkSession.range(k).selectExpr("cast(id as int) a", f"explode(sequence(0, {k - 1})) b").selectExpr(
        "a", "b", "least(a, b) i", "greatest(a, b) j")
    found = total.select("i", "j", corr.alias("corr"))  # one row per pair of columns
    return cells.join(F.broadcast(found), ["i", "j"], "left").select(
        name[F.col("a")].alias("x"), name[F.col("b")].alias("y"), "corr")


def _pair_sums(df: DataFrame, raw: list, means: list, used: list[int], gaps: set, pairs: list) -> DataFrame:
    """(i, j, n, sums of both and of their product), one row per null pattern that serves the pair."""
    at = {i: n for n, i in enumerate(used)}
    bit = {i: n for n, i in enumerate(i for i in used if i in gaps)}
    shifted = df.select(
        sum((F.when(raw[i].isNotNull(), 1 << n).otherwise(0) for i, n in bit.items()), F.lit(0)).alias("has"),
        *[(raw[i] - F.lit(means[i])).alias(f"x{i}") for i in used])

    def sums(one):
        return F.expr("array(" + ", ".join(one(i) for i in used) + ")")

    order = [(i, j) for i, j in pairs if i < j]
    per_pattern = shifted.groupBy("has").agg(
        F.count("*").cast("double").alias("n"), sums(lambda i: f"sum(x{i})").alias("s"),
        sums(lambda i: f"sum(x{i} * x{i})").alias("q"), sums(lambda i: f"min(x{i})").alias("lo"),
        sums(lambda i: f"max(x{i})").alias("hi"),
        F.expr("array(" + ", ".join(f"sum(x{i} * x{j})" for i, j in order) + ")").alias("p")
        if order else F.expr("array(cast(null as double))").alias("p"))
    # one row per pattern and pair the pattern can serve
    place = {pair: n for n, pair in enumerate(order)}
    need = [(i, j, at[i], at[j], place.get((i, j), -1),
             (1 << bit[i] if i in bit else 0) | (1 << bit[j] if j in bit else 0)) for i, j in pairs]
    rows = per_pattern.select("*", F.expr("inline(array(" + ", ".join(
        f"struct({i} AS i, {j} AS j, {a} AS ai, {b} AS aj, {n} AS at, {m} AS need)" for i, j, a, b, n, m in need) + "))"))
    rows = rows.filter("(has & need) = need")
    return rows.select(
        "i", "j", "n", *[F.col(v)[F.col(f"a{w}")].alias(f"{v}{w}") for v in ("s", "q", "lo", "hi") for w in ("i", "j")],
        F.when(F.col("at") >= 0, F.get("p", F.col("at"))).otherwise(F.col("q")[F.col("ai")]).alias("p"))


def histogram_by_class(df: DataFrame, roles: Roles, cols=None, bins: int = 20) -> DataFrame:
    """(feature, class, bin, lo, hi, n): equal-width bins over the column's range."""
    cols = list(cols or roles.present(df, roles.numeric))
    x = {c: F.col(c).cast("double") for c in cols}
    span = df.agg(*[F.struct(F.min(x[c]).alias("lo"), F.max(x[c]).alias("hi")).alias(c) for c in cols]).first()
    slots = []
    for c in cols:
        lo, hi = span[c]["lo"], span[c]["hi"]
        if lo is None:
            continue
        width = hi - lo
        raw = F.floor((x[c] - F.lit(lo)) / F.lit(width) * bins).cast("int") if width > 0 else F.lit(0)
        slot = F.least(raw, F.lit(bins - 1))
        slots.append(F.struct(
            F.lit(c).alias("feature"), F.when(x[c].isNotNull(), slot).alias("bin"),
            (F.lit(lo) + slot * F.lit(width) / bins).alias("bin_lo"),
            (F.lit(lo) + (slot + 1) * F.lit(width) / bins).alias("bin_hi")))
    cells = df.select(F.col(roles.target).alias("class"), F.explode(F.array(*slots)).alias("s"))
    return (cells.select("class", "s.*").filter("bin IS NOT NULL AND class IS NOT NULL")
            .groupBy("feature", "class", "bin", "bin_lo", "bin_hi").agg(F.count("*").alias("n")))
