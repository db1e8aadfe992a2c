"""Column roles and the declared schema of a loan-application table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from loanlab import fixed_values as fv


@dataclass(frozen=True)
class Roles:
    """Which column plays which part. Every operator takes one of these.

    ``id`` must be unique: sampling, tie-breaks and joins are functions of it.
    """

    id: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    @property
    def expected(self) -> tuple[str, ...]:
        return self.features + (self.target,)

    def present(self, df, names) -> list[str]:
        """The given columns that the table really has (absent ones are skipped)."""
        have = set(df.columns)
        return [c for c in names if c in have]


LOAN_ROLES = Roles("app_id", fv.TARGET, fv.NUMERIC, fv.CATEGORICAL)

LOAN_SCHEMA = T.StructType([
    T.StructField("app_id", T.LongType()),
    T.StructField("person_age", T.IntegerType()),
    T.StructField("person_income", T.LongType()),
    T.StructField("person_home_ownership", T.StringType()),
    T.StructField("person_emp_length", T.DoubleType()),
    T.StructField("loan_intent", T.StringType()),
    T.StructField("loan_grade", T.StringType()),
    T.StructField("loan_amnt", T.LongType()),
    T.StructField("loan_int_rate", T.DoubleType()),
    T.StructField("loan_status", T.IntegerType()),
    T.StructField("loan_percent_income", T.DoubleType()),
    T.StructField("cb_person_default_on_file", T.StringType()),
    T.StructField("cb_person_cred_hist_length", T.IntegerType()),
])
