"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlab.sources.loan_applications import LOANS_CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL that must give the same rows."""
    def add(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def loans_sql(select: str, *ctes: str) -> str:
    """SQL over the ``loans`` table: the shared view, further CTEs, then the query."""
    return "WITH " + ",\n".join([LOANS_CTE.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()
