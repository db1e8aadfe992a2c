import random
from collections import Counter

import pytest

from loanlab.llm import catalog, sharding, url_filters

SCHEMA = "host string, path string, verdict string"


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(8)
    urls = [None, "", "nothing", "http://", "http:///en/", "http://net", "http://net/", "HTTP://A.Net/x", "x://net?/", "a://b://net/",
            "http://example.net/en/a/b?c#d", "http://user@example.net:80/en/", "http://notexample.net/en/", "http://.net/",
            "http://net./", "http://a..net/en/", "http://exÄmple.NET/en/é", "x\n://example.org/fr/\n/y"]
    hosts, paths = ["net", "example.net", "www.example.net", "example.com", "org", "a.org", "EXAMPLE.com"], ["", "/", "/en", "/en/", "/de/x", "/fr/y/z", "?q", "#f"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(paths)}" for _ in range(200)] + ["http://hot.net/"] * 500
    rules = [*catalog.URL_RULES, ("example.net", "/en/b", "block"), ("org", "", "block"), ("org", "", "allow"), ("", "/", "block")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, SCHEMA)
    got = url_filters.judge_urls(pages, frame, keep=("page_id", "url", "rule")).collect()
    assert len(got) == len(urls)
    used = [r for r in rules if r[0]]
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_judge(r.url, used), r.url


def test_rule_lists_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/fr/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filters.judge_urls(pages, spark.createDataFrame(catalog.URL_RULES, SCHEMA)).collect()}
    assert got == {1: "net/", 2: "org/fr/"}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in url_filters.judge_urls(pages, none).collect()] == [(1, "a.net", "/x", None, "allow")]
    assert url_filters.judge_urls(pages.limit(0), spark.createDataFrame(catalog.URL_RULES, SCHEMA)).count() == 0


def test_table_is_filled_in_turns():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.fill(shards, 211)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1 and len(table) == 211
    owner = {}  # the plain rule: take turns, first free slot by preference
    turn = 0
    while len(owner) < 211:
        offset, skip = sharding.preference(shards[turn % 7], 211)
        slot = next(s for s in ((offset + k * skip) % 211 for k in range(211)) if s not in owner)
        owner[slot] = turn % 7
        turn += 1
    assert [owner[s] for s in range(211)] == table
    without = sharding.fill(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table, without) if a != 6)
    assert moved < 211 / 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 211)
    with pytest.raises(ValueError):
        sharding.fill(shards, 210)


def test_placement_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    got = sharding.place(odd_docs, catalog.SHARDS, keep=("doc_id", "text", "score"), size=2039).collect()
    assert len(got) == 10 and {r.shard for r in got} <= set(catalog.SHARDS)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.place(no_docs, catalog.SHARDS).count() == 0
    sharding.write_shards(odd_docs.select("doc_id", "text"), str(tmp_path / "out"), ["a", "b"], size=211)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 10 and set(back.columns) == {"doc_id", "text", "shard"}
