import random

from loanlab.llm import catalog, decontamination, substring_dedup


def plain_tiles(doc, item, least):
    """Greedy tiling by looking at all pairs of places for the longest free run, again and again."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n]
                       and doc[d + n] and doc[d + n] == item[i + n]):
                    n += 1
                if n >= least and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return sorted(out)
        n, i, d = -best[0], best[1], best[2]
        free_doc[d:d + n] = free_item[i:i + n] = [False] * n
        out.append((d, i, n))


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        doc = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        item = [rng.randint(1, 3) for _ in range(rng.randint(0, 25))]
        assert sorted(decontamination.tile(doc, item, 3)) == plain_tiles(doc, item, 3)


def plain_coverages(docs, items, least):
    out = {}
    for doc_id, text in docs:
        words = decontamination.words_of(text or "")
        for item_id, item_text in items:
            item = decontamination.words_of(item_text or "")
            share = sum(n for _, _, n in plain_tiles(words, item, min(least, len(item)))) / len(item) if item else 0
            if share:
                out.setdefault((doc_id, item_id), []).append(round(share, 12))
    return out


def test_reordered_passages_and_odd_rows(spark, odd_docs, no_docs):
    words = "the quick brown fox jumps over the lazy dog while seven small boats sail across the quiet bay".split()
    halves = " ".join(words[9:]) + ", then " + " ".join(words[:9])
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, halves.upper()), (2, halves.upper()), (3, " ".join(words[:6])), (4, None), (None, " ".join(words)),
         (5, "nothing of it here at all today"), (6, "x " * 3000 + " ".join(words[2:16]) + " y" * 3000)],
        "doc_id long, text string")
    items = [(7, " ".join(words)), (7, " ".join(words)), (8, "Lazy DOG"), (8, "seven large boats"), (9, None), (None, "one two three four five six")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain_coverages([tuple(r) for r in docs.collect() if r.doc_id != 6], list(dict.fromkeys(items)), 5)
    for size in (decontamination.BLOCK_WORDS, 1):  # 1: every item a block of its own
        got = {}
        for r in decontamination.overlaps(docs, bench, block_words=size).collect():
            got.setdefault((r.doc_id, r.item_id), []).append(round(r.coverage, 12))
        assert got.pop((6, 7)) == [round(14 / 18, 12)] and got.pop((6, 8)) == [1.0]
        assert got == expected
    found = decontamination.contaminated(docs, bench)
    assert sorted({r.doc_id or 0 for r in found.collect()}) == [0, 1, 2, 6]
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    assert decontamination.overlaps(no_docs, bench).count() == 0
    assert decontamination.overlaps(odd_docs, bench.limit(0)).count() == 0
    assert decontamination.clean(odd_docs, bench).count() == 10


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 1500]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    small = {d for d, _ in docs}
    expected = {k for k, v in plain_coverages(docs, items[:12], 5).items() if v[0] >= 0.5}
    got = {(r.doc_id, r.item_id) for r in catalog.op10(spark, sf).collect()}
    names = {i for i, _ in items[:12]}
    assert {g for g in got if g[0] in small and g[1] in names} == expected


def plain_removed(docs):
    """Covered sentences per (id, text), by comparing every span's words with all others."""
    seen, spans = {}, []
    for key in sorted(set(docs), key=lambda k: (k[0] is None, k[0] or 0)):
        sentences = [s.encode().lower().split() for s in substring_dedup.cut(key[1])]
        for i, j in substring_dedup.spans([len(s) for s in sentences], 3, 20, 40):
            words = b" ".join(b" ".join(s) for s in sentences[i:j])
            spans.append((words, key, i, j))
            seen.setdefault(words, (key, i))
    gone = {}
    for words, key, i, j in spans:
        if seen[words] != (key, i):
            gone.setdefault(key, set()).update(range(i, j))
    return gone


def test_spans_cover_a_passage_to_both_ends():
    rng = random.Random(5)
    for _ in range(500):
        counts = [rng.choice([1, 2, 3, 5, 8, 15, 30, 60]) for _ in range(rng.randint(1, 12))]
        if sum(counts) <= 50:
            continue
        covered = {k for i, j in substring_dedup.spans(counts, 3, 20, 40) for k in range(i, j)}
        assert covered == set(range(len(counts))), counts


def test_repeated_passages(spark, odd_docs, no_docs):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices(["amber", "birch", "cedar", "delta", "ember", "fjord", "grove"], k=n))
    passage = ". ".join(say(9) for _ in range(7)) + "."
    long_one = say(55) + "."
    docs = [(i, f"{say(12)}. {say(15)}.\n{passage}\n{say(11)}. {say(8)}!") for i in (3, 1, 2)]
    docs += [(4, long_one + "\n" + say(30)), (5, say(14) + ".\n" + long_one), (6, "Clean text. Short. Here."),
             (7, "Clean text. Short. Here."), (None, docs[0][1]), (8, docs[1][1]), (8, docs[1][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_removed", substring_dedup.F.lit("old"))
    got = substring_dedup.remove_repeated(frame).collect()
    assert len(got) == len(docs)
    gone = plain_removed(docs)
    texts = dict(docs)
    for r in got:
        whole = docs[0][1] if r.doc_id is None else texts[r.doc_id]
        pieces = substring_dedup.cut(whole)
        lost = gone.get((r.doc_id, whole), set())
        assert r.n_removed == len(lost) and r.n_sentences == len(pieces)
        assert r.text == ("".join(s for i, s in enumerate(pieces) if i not in lost).rstrip() if lost else whole)
    kept = {r.doc_id: r.text for r in got}
    assert passage in kept[1] and passage not in kept[2] and passage not in kept[3]
    assert long_one in kept[4] and long_one not in kept[5] and kept[6] == kept[7] == "Clean text. Short. Here."
    odd = substring_dedup.remove_repeated(odd_docs)
    assert odd.columns == [*odd_docs.columns, "n_sentences", "n_removed"] and odd.count() == 10
    assert substring_dedup.remove_repeated(no_docs).count() == 0


def test_sentences_join_to_the_text():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choices(["a", "B b", ".", "!", " ", "\n", "\t", "\xa0", "é"], k=rng.randint(0, 25)))
        pieces = substring_dedup.cut(text)
        assert "".join(pieces) == text
        assert all(p.encode().split() for p in pieces[1:])  # no sentence without words but an empty text's
