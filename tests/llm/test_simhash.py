import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from loanlab.llm import simhash
from loanlab.llm.components import components


def plain_fingerprint(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, now = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    """Smallest id reachable, by comparing all pairs of (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, a), (j, b) in combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    expected = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{p:016x}", expected[i]) for i, p in prints}
    assert len(got) == len(rows)


def test_links_are_complete_on_both_paths(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    expected = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2)
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert expected
    for bucket in (simhash.BUCKET, 2):  # 2: nearly every shared key is cut again
        assert {tuple(r) for r in simhash.links(frame, 3, bucket).collect()} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 10
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by_print["0" * 16] == {3}                      # null, empty and blank texts link
    assert all(len(c) == 1 for c in by_print.values())
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_of_equal_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (9, "x y z u"), (9, "x y z u")],
                                 "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(rows).collect()) == ["a b c d", "x y z u"]


def test_kept_columns_give_way(spark):
    rows = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, fingerprint string")
    got = simhash.fingerprints(rows, keep=("doc_id", "fingerprint"))
    assert got.columns == ["doc_id", "fingerprint"] and got.select(F.col("fingerprint")).first()[0] != "old"


def test_signatures_are_never_broadcast(spark, monkeypatch):
    """Spark's estimate does not see that a fingerprint becomes dozens of rows, so a small table looked fit to send."""
    plans = []

    def stored(df):  # planned, not run
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df
    monkeypatch.setattr(simhash, "durable", stored)
    found = simhash.links(spark.range(50).select(F.xxhash64("id").alias("fp")))
    stored(found)
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
