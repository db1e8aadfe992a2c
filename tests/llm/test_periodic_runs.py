import hashlib
import random
import zlib

import pytest

from loanlab.llm import catalog, periodic_runs


def brute(words, times=4, least=6):
    """Every period tried at every place."""
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(
                    all(words[k] == words[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def invented(rng):
    n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // rng.randint(3, 6)))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("times, least", [(4, 6), (3, 3), (3, 10), (5, 1)])
def test_runs_equal_brute_force(times, least):
    rng = random.Random(times * 100 + least)
    for _ in range(1500):
        words = invented(rng)
        want = brute(words, times, least)
        assert periodic_runs.word_runs(words, times, least) == want, words
        # the automaton alone, without the split at rare words
        assert sorted(periodic_runs.runs_of(words, times, least), key=lambda r: (r[0], r[2])) == want


def test_link_cut_paths_equal_plain_walks():
    """Segments of an access against colours kept node by node."""
    rng = random.Random(8)
    tree, parent, colour = periodic_runs.PathTree(), {}, {}
    nodes = [tree.add(0)]
    parent[nodes[0]] = 0
    for i in range(600):
        up = rng.choice(nodes)
        new = tree.add(up)
        parent[new] = up
        nodes.append(new)
        if rng.random() < 0.3 and parent[at := rng.choice(nodes[1:])]:
            mid = tree.put_above(at)
            parent[mid], parent[at] = parent[at], mid
            colour[mid] = colour.get(at, -1)
            nodes.append(mid)
        x = rng.choice(nodes)
        want, node = [], x
        while node:  # the deepest node of each colour on the way up
            c = colour.get(node, -1)
            if c >= 0 and (not want or want[-1][0] != c):
                want.append((c, node))
            colour[node], node = i, parent[node]
        assert tree.access(x, i) == want


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *best, None if best[2] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in catalog.op12(spark, sf).collect()}
    assert set(got) == set(docs) and sum(1 for r in got.values() if r[0]) > 10
    for doc_id, text in docs.items():
        words = planted(doc_id, text)
        if len(words) <= 2500 or doc_id % 7 == 0:  # brute force takes the square of the length
            assert got[doc_id] == expected(words), doc_id


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs.periodic_runs(odd_docs, keep=("doc_id", "text", "runs", "n tokens.x")
                                       if "runs" in odd_docs.columns else ("doc_id", "text", "n tokens.x"))
    for r in rows.collect():
        words = (r.text or "").split()
        assert r.n_words == len(words) and r.collapsed == " ".join(words) and r.runs == []
    assert rows.count() == 10 and periodic_runs.periodic_runs(no_docs).count() == 0
    clash = spark.createDataFrame([(1, "a b a b a b a b c", 7)], "doc_id long, text string, runs int")
    r, = periodic_runs.periodic_runs(clash, keep=("doc_id", "runs")).collect()
    assert [tuple(x) for x in r.runs] == [(0, 8, 2)] and r.collapsed == "a b c"


def test_white_space_and_digests_of_empty_texts(spark):
    texts = [(1, "x y\tz \x0b\x0c\n"), (2, None), (3, ""), (4, "\x1c \x85")]
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(
        spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[1].collapsed == "x y z" and rows[2].n_words == rows[3].n_words == 0 and rows[4].n_words == 2


def test_very_long_periodic_text():
    words = [i % 501 for i in range(40_000)] + list(range(1000, 1400)) + [3] * 30_000
    assert periodic_runs.word_runs(words) == [(0, 40_000, 501), (40_400, 30_000, 1)]


def test_short_exponents_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(no_docs, times=2)
