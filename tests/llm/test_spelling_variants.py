import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loanlab.llm import catalog, spelling_variants


def near(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced, tried one by one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(docs, drop_every=97, shortest=5):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and drop_every and h % drop_every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= shortest:
                out[word] += 1
    return out


def brute(words: dict) -> set:
    forms, rows, by_length = {}, [], {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w, n in words.items():
        others = [o for k in (-1, 0, 1) for o in by_length.get(len(w) + k, []) if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best
        rows.append((w, n, len(others)))
    def root(w):
        while w in forms:
            w = forms[w]
        return w
    return {(w, n, k, forms.get(w), words[forms[w]] if w in forms else None, root(w)) for w, n, k in rows}


def as_set(rows):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect()}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {w: n for w, n in counts(docs).items() if n >= 3}
    got = catalog.op11(spark, sf)
    assert got.columns[:6] == ["word", "n", "n_near", "form", "form_n", "root"]
    assert got.count() == len(want) and as_set(got) == brute(want)


def invented():
    rng = np.random.default_rng(4)
    words = {}
    for _ in range(250):
        word = "".join(rng.choice(list("abcdeéßz÷"), rng.integers(5, 9)))
        words[word] = int(rng.integers(1, 400))
        for _ in range(2):  # one edit of it
            i, c = rng.integers(0, len(word)), rng.choice(list("abéz×"))
            words[rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]])] = int(
                rng.integers(1, 400))
    return words


@pytest.mark.parametrize("size", [1, 7, 512])
def test_slices_lose_no_pair(spark, size, monkeypatch):
    words = invented()
    near_words = spelling_variants.near_words
    monkeypatch.setattr(spelling_variants, "near_words", lambda w: near_words(w, size))
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert as_set(spelling_variants.spelling_variants(rows)) == brute(words)


def test_ties_chains_and_very_long_words(spark):
    long_word = "a" * 300
    words = {"house": 8, "houses": 8, "housed": 8, "housey": 3, "horse": 4, "morse": 2, "norse": 1, "lonely": 5,
             long_word: 9, long_word + "a": 4, long_word[1:] + "b": 2, long_word[2:] + "bb": 1}
    got = {r.word: r for r in spelling_variants.spelling_variants(
        spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.values()} == brute(words)
    assert got["housey"].form == "house" and got["norse"].root == "house" and got["lonely"].n_near == 0
    assert got["houses"].form is None  # an equal count is no form


def test_odd_rows_are_counted(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = spelling_variants.word_counts(odd_docs, 97, 5).collect()
    assert {r.word: r.n for r in got} == dict(counts(docs)) and len(got) > 5
    none = spelling_variants.spelling_variants(spelling_variants.word_counts(no_docs))
    assert none.count() == 0 and none.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_counts_handed_on_in_parts(spark, odd_docs, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    monkeypatch.setattr(spelling_variants, "TABLE", 3)
    got = {r.word: r.n for r in spelling_variants.word_counts(odd_docs, 3, 1).collect()}
    assert got == dict(counts(docs, 3, 1))


def test_circles_are_refused(spark):
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n bigint"), ratio=1)
