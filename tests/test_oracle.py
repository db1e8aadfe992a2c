"""Every registered query with a SQL twin gives the same rows as DuckDB on the smallest table."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


# The AUC floors of trees and small ensembles are meant for sf 0.01 and up (tools/check_oracle.py);
# tests/test_learners.py covers these learners on the smallest table.
LARGER = {"m2_decision_tree", "m3_random_forest", "m4_gradient_boosting", "m5_regularised_boosting",
          "m6_histogram_boosting", "m9_adaboost"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and n not in LARGER])
def test_query_matches_sql(spark, duck, sf, name):
    assert compare(QUERIES[name](spark, sf), duck, SQL[name]) == ""
    spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
