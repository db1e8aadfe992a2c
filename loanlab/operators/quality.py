"""Data quality: rules, dimensions, duplicates.

A rule is a name and an SQL condition that good rows meet. All rules are checked in one
scan: as counts by one aggregate, and as an array of violated rules on each row. A condition that
is null (a value is missing) is no violation; completeness counts missing values.

Defined results: an empty table gives one row per rule with zero rows and a null share; rules on columns
that are absent raise; repeated rows count each time; extra columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlab.functions.scalars import is_float, ratio, rows_from_one


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    column: str | None = None  # the column it is about

    def broken(self) -> Column:
        return F.coalesce(~F.expr(self.condition), F.lit(False))


# fixed values: the limits that the guide names
LOAN_RULES = (
    Rule("age_range", "person_age BETWEEN 18 AND 100", "person_age"),
    Rule("income_positive", "person_income > 0", "person_income"),
    Rule("loan_within_income", "loan_amnt <= 10 * person_income", "loan_amnt"),
    Rule("history_within_age", "cb_person_cred_hist_length <= person_age - 18", "cb_person_cred_hist_length"),
)


def check_rules(df: DataFrame, rules=LOAN_RULES) -> DataFrame:
    """(rule, column, n_rows, n_checked, n_violations, violation_share): one row per rule, one aggregate."""
    rules = list(rules)
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, rule in enumerate(rules):
        aggregates += [F.count(F.expr(rule.condition)).alias(f"checked{i}"), F.count_if(rule.broken()).alias(f"broken{i}")]
    one = df.agg(*aggregates)
    return rows_from_one(one, [F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.column).cast("string").alias("column"), F.col("n_rows"),
        F.col(f"checked{i}").alias("n_checked"), F.col(f"broken{i}").alias("n_violations"),
        ratio(F.col(f"broken{i}"), F.col("n_rows")).alias("violation_share")) for i, r in enumerate(rules)])


def mark_violations(df: DataFrame, rules=LOAN_RULES, name: str = "violations") -> DataFrame:
    """Adds an array with the names of the rules that the row breaks, in rule order."""
    marks = F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules])
    return df.withColumn(name, F.array_compact(marks))


def split_by_rules(df: DataFrame, rules=LOAN_RULES) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all rules, rows that break some, with ``violations``)."""
    marked = mark_violations(df, rules)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def dimensions(df: DataFrame, cols, key, rules=LOAN_RULES) -> DataFrame:
    """(dimension, subject, score): completeness by column, uniqueness of the key, validity by rule; 1 is best.

    Uniqueness is the share of distinct keys among the rows: keys are folded before they are counted.
    """
    cols, key, rules = list(cols), list(key), list(rules)
    here = lambda c: F.when(~F.isnan(c), F.col(c)) if is_float(df, c) else F.col(c)
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(here(c)).alias(f"c{i}") for i, c in enumerate(cols)],
                   *[F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)])
    cells = [F.struct(F.lit("completeness").alias("dimension"), F.lit(c).alias("subject"),
                      ratio(F.col(f"c{i}"), F.col("n")).alias("score")) for i, c in enumerate(cols)]
    cells += [F.struct(F.lit("validity").alias("dimension"), F.lit(r.name).alias("subject"),
                       ratio(F.col("n") - F.col(f"r{i}"), F.col("n")).alias("score")) for i, r in enumerate(rules)]
    folded = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    unique = folded.agg(ratio(F.count(F.lit(1)), F.sum("n")).alias("score")).select(
        F.lit("uniqueness").alias("dimension"), F.lit(",".join(key)).alias("subject"), "score")
    return rows_from_one(facts, cells).unionByName(unique)


def duplicate_groups(df: DataFrame, key) -> DataFrame:
    """(key..., n): keys that stand more than once."""
    return df.groupBy(*list(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_duplicates(df: DataFrame, key, prefer, descending: bool = True) -> DataFrame:
    """One row per key: the one with the largest (or smallest) ``prefer``, then the largest row as a whole.

    A grouped maximum, so each task sends one row per key and a key with very many copies
    costs no more than others. Nulls in the key are equal; a null ``prefer`` loses.
    """
    key, prefer = list(key), list(prefer)
    rest = [c for c in df.columns if c not in key]
    known = F.struct(*[F.col(p).isNotNull() for p in prefer])
    wanted = F.struct(known.alias("known"), F.struct(*[F.col(p) for p in prefer]).alias("prefer"),
                      F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("row"))
    if descending:
        best = F.max(wanted)
    else:  # the smallest among those whose values are known
        best = F.min(F.struct(F.struct(*[F.col(p).isNull() for p in prefer]).alias("unknown"),
                              F.struct(*[F.col(p) for p in prefer]).alias("prefer"),
                              F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("row")))
    return df.groupBy(*key).agg(best.alias("_best")).select(
        *[F.col(c) if c in key else F.col(f"_best.row.{c}").alias(c) for c in df.columns])
