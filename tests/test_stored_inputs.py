"""Operators that read their table many times get it stored, not as a join to be made again each time."""

import pytest
from pyspark.sql import functions as F

from loanlab.operators import outliers, star
from loanlab.plans import learn_queries, prepare_job, prepare_queries, profile_queries, warehouse_queries


class Seen(Exception):
    pass


@pytest.mark.parametrize("module, owner, name, query", [
    (profile_queries, outliers, "handle_outliers", "f3"), (prepare_queries, prepare_queries, "prepare", "p10"),
    (prepare_queries, outliers, "fence_constants", "r4"), (warehouse_queries, star, "orphans", "x16_orphans")])
def test_the_table_is_stored_first(spark, sf, monkeypatch, module, owner, name, query):
    def seen(df, *_):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(owner, name, seen)
    with pytest.raises(Seen) as found:
        getattr(module, query)(spark, sf)
    assert "Join" not in str(found.value)


def test_orphans_read_the_facts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x
    counted = counted.asNondeterministic()
    facts = spark.range(6).select(counted("id").alias("a"), F.lit(1).alias("b")).withColumn("c", F.col("a"))
    lost = star.orphans(facts, {"a": spark.range(5).toDF("a"), "c": spark.range(4).toDF("c")}).collect()
    assert {(r.key, r.n) for r in lost} == {("a", 1), ("c", 2)} and read.value == 6


def test_prepared_rows_are_kept_on_disk(spark, sf, monkeypatch):
    """In memory they would fill the heap of the executors, beside the workers of the learners."""
    made = []

    def kept(*args, **options):
        made.append(prepare_job.prepare(*args, **options))
        return made[-1]
    monkeypatch.setattr(learn_queries, "prepare", kept)
    train, test, _ = learn_queries.train_test(spark, sf)
    level = made[0].rows.storageLevel
    assert level.useDisk and not level.useMemory and train.count() > test.count() > 0
    made[0].rows.unpersist()
