import random

import pytest
from pyspark.sql import functions as F

from loanlab.operators import history, star

SCHEMA = "k string, t int, a string, b double, id long"


def brute_versions(rows):
    at_once = {}
    for k, t, a, b, i in rows:
        old = at_once.get((k, t))
        if old is None or i > old[0]:
            at_once[k, t] = (i, a, b)
    out = []
    by_key = {}
    for (k, t), (_, a, b) in at_once.items():
        by_key.setdefault(k, []).append((t, a, b))
    for k, seen in by_key.items():
        seen.sort(key=lambda s: (s[0] is not None, s[0] or 0))
        starts = [s for i, s in enumerate(seen) if not i or s[1:] != seen[i - 1][1:]]
        for i, (t, a, b) in enumerate(starts):
            last = i + 1 == len(starts)
            out.append((k, a, b, t, None if last else starts[i + 1][0], last))
    return sorted(out, key=str)


def invented(seed, n=600):
    rng = random.Random(seed)
    keys = ["hot"] * 200 + [f"k{i}" for i in range(40)] + [None] * 3
    return [(rng.choice(keys), rng.choice([None, *range(30)]) if seed % 2 else rng.randrange(200), rng.choice(["x", "y", None]),
             rng.choice([1.0, None]), i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_equal_brute_force(spark, seed):
    rows = invented(seed)
    got = history.versions(spark.createDataFrame(rows, SCHEMA), "k", "t", ["a", "b"], "id")
    assert got.columns == ["k", "a", "b", "valid_from", "valid_to", "is_current"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_versions(rows)


def test_facts_as_of_equal_brute_force(spark):
    rows, rng = [r for r in invented(4) if r[1] is not None], random.Random(9)
    facts = [(i % 150, rng.choice(["hot", "hot", "k1", "k2", "other", None]), rng.choice([None, *range(-5, 210)]), 7)
             for i in range(500)]
    dimension = history.versions(spark.createDataFrame(rows, SCHEMA), "k", "t", ["a", "b"], "id")
    got = history.as_of(spark.createDataFrame(facts, "f int, k string, t int, a int"), dimension, "k", "t", ["a", "b"], ["f"])
    assert got.columns == ["f", "k", "t", "valid_from", "a", "b"]
    versions, want = brute_versions(rows), []
    for f, k, t, _ in facts:
        held = [v for v in versions if v[0] == k and t is not None and v[3] <= t and (v[4] is None or t < v[4])]
        want.append((f, k, t, *((held[0][3], *held[0][1:3]) if held else (None, None, None))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_one_key_spreads_over_partitions(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("t"),
                                      (F.col("id") % 3).cast("string").alias("a"), F.lit(1.0).alias("b"), "id")
    got = history.versions(rows, "k", "t", ["a"], "id")
    assert got.count() == 20_000
    placed = history.with_before(rows, [F.col("k"), F.col("t")], F.col("t"))
    assert placed.where("_before IS NULL").count() == 1 and placed.where("_before <> t - 1").count() == 0


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    dimension = history.versions(none, "k", "t", ["a"], "id")
    assert dimension.count() == 0
    facts = spark.createDataFrame([(1, "k", 3, 5)], "f int, k string, t int, valid_from int")
    assert [tuple(r) for r in history.as_of(facts, dimension, "k", "t", ["a"], ["f"]).collect()] == [(1, "k", 3, None, None)]


# ---------------------------------------------------------------- star schema

def test_members_and_facts_meet(spark):
    rows = [("x", 1, 10.0), ("x", 1, 20.0), ("x", None, 1.0), (None, None, 2.0), ("", 1, 3.0), (None, 1, 4.0)]
    df = spark.createDataFrame(rows, "c string, n int, amount double")
    members = star.dimension(df, "key", ["c", "n"], {"both": F.col("c").isNotNull() & F.col("n").isNotNull()})
    facts = star.fact(df, {"key": ["c", "n"]}, ["amount"])
    assert members.count() == 5 and members.where("key = 0").count() == 1   # five natural keys, one of them unknown
    joined = facts.join(members, "key")
    assert sorted((r.c, r.n, r.amount) for r in joined.where("both").collect()) == [("", 1, 3.0), ("x", 1, 10.0), ("x", 1, 20.0)]
    assert joined.count() == 6 and joined.where("key = 0").first().amount == 2.0
    assert star.orphans(facts, {"key": members}).count() == 0
    lost = star.orphans(facts, {"key": members.where("c = 'x'")}).first()
    assert (lost.key, lost.n) == ("key", 3)


def test_dimension_of_an_empty_table_and_attributes(spark):
    none = spark.createDataFrame([], "c string, kind string")
    assert [tuple(r) for r in star.dimension(none, "key", ["c"], attributes=["kind"]).collect()] == [(0, None, None)]
    twice = spark.createDataFrame([("a", "u"), ("a", "w"), ("a", None)], "c string, kind string")
    assert [(r.c, r.kind) for r in star.dimension(twice, "key", ["c"], attributes=["kind"]).where("key <> 0").collect()] == [("a", "w")]


def test_colliding_keys_raise(spark, monkeypatch):
    monkeypatch.setattr(star, "surrogate_key", lambda columns: F.lit(5).cast("bigint"))
    with pytest.raises(star.KeyCollision):
        star.dimension(spark.createDataFrame([("a",), ("b",)], "c string"), "key", ["c"])


def test_rollup_tells_subtotals_from_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    got = {(r.p, r.q, r.level): r.s for r in star.rollup(df, ["p", "q"], {"s": F.sum("v")}).collect()}
    assert got == {("a", None, 2): 1, ("a", "x", 2): 2, (None, "x", 2): 4, ("a", None, 1): 3, (None, None, 1): 4,
                   (None, None, 0): 7}
