import hashlib
import os
import sys

import public_tokenizers
import tiktoken

import corpus_pipeline
from loanlab.llm import byte_bpe, catalog, decontamination, simhash, substring_dedup, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_simhash import plain_components, plain_fingerprint  # noqa: E402
from test_text_overlap import plain_coverages, plain_removed  # noqa: E402


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    memo = toxicity.Memo(toxicity._codes)
    scores = {i: model.score(model.encode(r.text, memo)) for i, r in rows.items()}
    one = corpus_pipeline.drop_toxic(spark, docs, sf)
    left = {i for i, r in rows.items() if scores[i] < model.thresholds.get(r.lang, model.threshold)}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(left)

    two = corpus_pipeline.drop_near_duplicates(spark, one, sf)
    roots = plain_components([(i, plain_fingerprint(rows[i].text)) for i in left])
    left = {i for i in left if roots[i] == i}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(left)

    three = corpus_pipeline.drop_repeated_passages(spark, two, sf)
    gone = plain_removed([(i, rows[i].text) for i in left])
    texts = {}
    for r in three.collect():
        pieces, lost = substring_dedup.cut(rows[r.doc_id].text), gone.get((r.doc_id, rows[r.doc_id].text), set())
        texts[r.doc_id] = "".join(p for k, p in enumerate(pieces) if k not in lost).rstrip() if lost else rows[r.doc_id].text
        assert r.text == texts[r.doc_id] and (not lost or r.n_chars == len(r.text))
    assert three.columns == columns and set(texts) == left

    four = corpus_pipeline.drop_benchmark_leaks(spark, three, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontamination.Index(items, 5)
    leaks = {i for i, t in texts.items() if any(sum(n for *_, n in tiles) * 2 >= len(index.items[k])
                                                for k, tiles in index.overlaps(t))}
    sample = sorted(texts)[:25]
    short = [(i, texts[i]) for i in sample if len(texts[i]) < 1200]
    slow = {d for (d, _), v in plain_coverages(short, items[:10], 5).items() if v[0] >= 0.5}
    assert slow <= leaks
    assert four.columns == columns and {r.doc_id for r in four.collect()} == set(texts) - leaks

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.tokenize(spark, four, sf).collect():
        ids = b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(texts[r.doc_id]))
        assert bytes(r.ids) == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.round_trip
        assert (r.n_tokens, r.n_bytes) == (len(ids) // 4, len(texts[r.doc_id].encode()))
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(run) == set(texts) - leaks


def test_stages_of_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "tokenize":
                assert out.columns == docs.columns
            else:
                assert out.count() == docs.count()
                assert all(r.round_trip for r in out.collect())
            out.count()


def test_queries_and_names():
    numbers = sorted(int(q[2:].split("_")[0]) for q in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert simhash.near_duplicates.__module__ == "loanlab.llm.simhash"


def test_sql_twins(spark, sf):
    import check_oracle
    con = check_oracle.connect(sf)
    for name, sql in catalog.ORACLES.items():
        assert check_oracle.compare(catalog.QUERIES[name](spark, sf), con, sql) == "", name
